"""Best-fit packing of tokenised documents, certified by dual-feasible functions.

Each partition packs its pieces by best-fit decreasing and computes a lower
bound on any packing of them.  Where the count equals the bound the partition is
done.  Partitions with a gap hand the pieces of their unfilled sequences over;
these are dealt out anew and packed again, and the result is kept if it saves
sequences.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismal.llm.common import map_rows, ship, written

CAPACITY = 2048
#: Pieces that one partition packs, about.
PARTITION_PIECES = 60_000
#: Pre-tokens a worker keeps in each of two generations.
CACHE = 600_000
#: Recurring ones from which it stops adding to those kept between tasks.
CORE = 150_000


class WordEncoder:
    """Ids of whole texts as the tokenizer gives them, pre-token by pre-token.

    For texts within a safe alphabet the normaliser and the pre-tokenizer are
    a lower-casing and a pattern, and every pre-token is encoded on its own, so
    each distinct one is encoded once; its last id bears the word's end, which
    splits the ids of many encoded together.  Other texts, and texts with a
    special token's opening, are encoded by the library as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(self.tok.get_vocab().values()) + 1, bool)
        for piece, i in vocab.items():
            self.ends[i] = piece.endswith("</w>")
        self.unsafe = re.compile("[^\\t\\n\\r -~¡«»¿À-ÖØ-öø-įĲ-ȳ]|<\\|")
        # letters first: only an apostrophe begins both a suffix and a run of signs
        self.split = re.compile(r"[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d|\d|(?:[^\s\w]|_)+")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.core: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        out: list[bytes] = [b""] * len(texts)
        whole, cut = [], []
        for i, text in enumerate(texts):
            if self.unsafe.search(text):
                whole.append(i)
            elif text:
                cut.append((i, self.split.findall(text.lower())))
        self._learn(set().union(*(ws for _, ws in cut)))
        get, join = self.known.__getitem__, b"".join
        for i, ws in cut:
            out[i] = join(map(get, ws))
        for i in whole:
            out[i] = array("I", self.tok.encode(texts[i], add_special_tokens=False).ids).tobytes()
        return out

    def forget(self) -> None:
        """Keep only pre-tokens that came in several batches."""
        self.known, self.older = dict(self.core), {}

    def _learn(self, words: set[str]) -> None:
        # two generations: what was used since the last turn survives it, rare words do not
        if len(self.known) > CACHE:
            self.older, self.known = self.known, {}
        if len(self.core) < CORE:
            self.core.update((w, self.known[w]) for w in words.intersection(self.known))
        new = words.difference(self.known)
        again = new.intersection(self.older)
        self.known.update(zip(again, map(self.older.__getitem__, again)))
        new = list(new - again)
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            # the fast form keeps no offsets
            ids = np.array(self.tok.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):
                for w in some:
                    self.known[w] = array("I", self.tok.encode(w, add_special_tokens=False).ids).tobytes()
                continue
            raw, first = ids.tobytes(), 0
            for w, stop in zip(some, (stops * 4).tolist()):
                self.known[w] = raw[first:stop]
                first = stop


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise whole texts, end each with id 0 and cut those over ``capacity``: ``doc_id, piece, start, length, ids_crc32``."""

    def run(cols: list[list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for key, ids in zip(cols[0], encoder(tokenizer).encode([t or "" for t in cols[1]])):
            ids += b"\0\0\0\0"
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                for name, v in zip(out, (key, k, at // 4, len(part) // 4, zlib.crc32(part))):
                    out[name].append(v)
        return out

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, piece int, start long, length long, ids_crc32 long", done=lambda: encoder(tokenizer).forget())


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, offset) of every piece and the number of sequences; ties keep their order."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_rest: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n = 0, 0  # bit r of mask: a sequence with room for exactly r more is open
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> size
        if fits:
            rest = size + (fits & -fits).bit_length() - 1
            at = by_rest[rest].pop()
            if not by_rest[rest]:
                mask ^= 1 << rest
        else:
            rest, at, n = capacity, n, n + 1
        where[i], offset[i] = at, capacity - rest
        left = rest - size
        if left:
            by_rest[left].append(at)
            mask |= 1 << left
    return where, offset, n


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs at least, the best of two families of dual-feasible functions."""
    if not len(lengths):
        return 0
    hist = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    sizes = np.arange(capacity + 1)
    count, total = np.cumsum(hist), np.cumsum(hist * sizes)
    cut = np.arange(capacity // 2 + 1)
    # sizes below the cut count nothing, those above capacity - cut a whole sequence
    middle = total[capacity - cut] - np.where(cut > 0, total[cut - 1], 0)
    best = int(np.max(-(-((count[-1] - count[capacity - cut]) * capacity + middle) // capacity)))
    for k in range(1, 33):
        whole, part = np.divmod((k + 1) * sizes, capacity)
        scaled = np.where(part == 0, sizes * k, whole * capacity)  # k times the function
        best = max(best, int(-(-int(hist @ scaled) // (k * capacity))))
    return best


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, bin long, offset long, fill long, bins long, bound long"


def _pack_parts(items: DataFrame, capacity: int, seed: int) -> DataFrame:
    """Deal pieces to partitions by hash and pack each; every row says its partition's count and bound.

    ``items`` is a written table: a row's number there keeps repeated rows apart.
    """
    n = items.count()
    parts = max(1, -(-n // PARTITION_PIECES))
    dealt = items.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id(), F.lit(seed)), F.lit(parts)))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "piece", "start", "ids_crc32")])
        lengths = table["length"].to_numpy()
        where, offset, bins = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(where, lengths, bins).astype(np.int64)[where]
        more = {"bin": where, "offset": offset, "fill": fill, "bins": np.full(len(lengths), bins), "bound": np.full(len(lengths), lower_bound(lengths, capacity))}
        for k, v in more.items():
            table = table.append_column(k, pa.array(v, pa.int64()))
        return table

    return written(dealt.groupBy("part").applyInArrow(pack, _PACKED), "packed")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    Returns a row per piece: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset, certified``; the last says whether the count of the
    partition that packed the piece equals its lower bound.  Partitions with a gap
    exchange their unfilled sequences, dealt anew, until none has one or two
    exchanges in turn save nothing; at last the unfilled sequences of all
    partitions are packed together.  Null and empty
    texts are one token, the end mark.  Null and repeated ids are packed row by
    row like others; other columns are ignored; an empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    ship(spark)
    names, gap = ["doc_id", "piece", "start", "length", "ids_crc32"], F.col("bins") > F.col("bound")
    held = _pack_parts(written(pieces(docs, tokenizer, capacity, id_col, text_col), "pieces"), capacity, 0).withColumn("round", F.lit(0))
    turn, unfilled = 0, F.col("fill") < capacity

    def exchange(rows: DataFrame, released: Column) -> DataFrame | None:
        """``rows`` with the released sequences packed anew, or None where that saves none."""
        free = written(rows.filter(released), "released")
        again = _pack_parts(free.select(names), capacity, turn).withColumn("round", F.lit(turn))
        if again.select("part", "bin").distinct().count() >= free.select("round", "part", "bin").distinct().count():
            return None
        return rows.filter(~released).unionByName(again)

    vain = 0
    while vain < 2 and held.filter(gap & unfilled).select("round", "part").distinct().limit(2).count() == 2:
        turn += 1
        better = exchange(held, gap & unfilled)
        held, vain = (held, vain + 1) if better is None else (better, 0)
    if held.select("round", "part").distinct().limit(2).count() == 2:
        turn += 1
        held = exchange(held, unfilled) or held
    sequence = F.col("round") * F.lit(1 << 56) + F.col("part") * F.lit(1 << 24) + F.col("bin")
    return held.select(*names, sequence.alias("sequence_id"), "offset", (~gap).alias("certified"))
