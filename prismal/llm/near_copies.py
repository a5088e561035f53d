"""Near copies by Jaccard similarity of word shingles, found exactly by prefix filtering.

Two sets of a and b shingles with similarity ``share`` or more have at least
ceil(share * n) shingles in common, n being the larger size, so the first
n - ceil(share * n) + 1 shingles of each set under any one order have one in
common.  The order puts shingles that few texts have first, counted over all
texts by the hash shards of ``buckets``: a text that has enough shingles of its
own meets no other and is left alone at once.

Sets that meet are compared by sizes, places and parity bitmaps, whose distance is
never over the symmetric difference, where they meet; pairs that remain are
verified on the shingles' words.  In the first rounds each set tries the nearest
one that is not in its component; what is then not linked is tried as a whole.  A
large group so gives spanning links, never all its pairs, and a shingle of
many sets is dealt by pairs of blocks of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismal.llm import buckets
from prismal.llm.buckets import Bucket
from prismal.llm.common import BROADCAST_IDS, _arrow_schema, connected_components, map_rows, release, written

#: Bytes of text in a bucket, hashed at once, and for a task of meetings.
BUCKET_BYTES, STRETCH, TASK_BYTES = 4 << 20, 1 << 18, 8 << 20
#: Bits of the parity bitmap that travels with a set; larger sets are only filtered less.
BITS = 1024
#: Sets of one meeting beyond which it is dealt by pairs of blocks; never a change of result.
BLOCK = 1 << 14
#: Sets up to which bitmaps and roots are broadcast (about 180 bytes each).
BROADCAST_SETS = 250_000
#: Rounds in which each set tries its nearest one, before all that are not yet linked are tried.
NEAREST_ROUNDS = 2
_POSTING = np.dtype([("sig", np.uint64), ("k", np.int64), ("n", np.int32), ("pos", np.int32)])
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_BASE = 0x100000001B3
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_SENT = "task int, rows binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    return x ^ (x >> np.uint64(29))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if n > len(_POWERS.get(0, ((), ()))[0]):
        _POWERS[0] = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b)])) for b in (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))))
    return _POWERS[0]


def word_hashes(data: bytes, ends: np.ndarray, stretch: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every word of the concatenated texts: runs of bytes between ASCII white space, A-Z lower-cased."""
    step = stretch or STRETCH
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    a, whole = 0, np.frombuffer(data, np.uint8)
    while a < len(data):
        b, wide = min(a + step, len(data)), step
        while True:
            c = whole[a:b]
            blank = (c == 32) | ((c >= 9) & (c <= 13))
            lo, hi = np.searchsorted(ends, [a, b], side="right")
            cut = np.flatnonzero(blank)[-1:] + a + 1
            stop = max([*cut.tolist(), *ends[max(lo, hi - 1) : hi].tolist(), 0])
            if b == len(data):
                stop = b
            # a word longer than the stretch is taken whole
            if stop > a:
                break
            wide *= 2
            b = min(a + wide, len(data))
        c, blank = c[: stop - a].astype(np.uint64), blank[: stop - a]
        c += np.where((c >= 65) & (c <= 90), 32, 0).astype(np.uint64)
        gap = np.zeros(stop - a + 1, bool)
        marks = ends[np.searchsorted(ends, a, side="right") : np.searchsorted(ends, stop, side="right")] - a
        gap[marks] = gap[0] = gap[-1] = True
        in_word = ~blank
        begin = np.flatnonzero(in_word & (gap[:-1] | ~np.concatenate([[False], in_word[:-1]])))
        end = np.flatnonzero(in_word & (gap[1:] | ~np.concatenate([in_word[1:], [False]]))) + 1
        up, down = _powers(max(step, stop - a))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((c + np.uint64(1)) * up[: stop - a], dtype=np.uint64)])
        out.append((_mix((total[end] - total[begin]) * down[begin]), np.searchsorted(ends, begin + a, side="right")))
        a = stop
    return tuple(np.concatenate(x) for x in zip(*out))


def shingle_sets(data: bytes, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all documents, one after another, and how many each has.

    A text of fewer words is one shingle; texts without words have one in common.
    """
    words, doc = word_hashes(data, ends)
    n = len(ends)
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    salt = [np.uint64((_BASE * (2 * j + 3) ** 9) % (1 << 64) | 1) for j in range(size)]
    many = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for j in range(size):
        many += words[j : j + len(many)] * salt[j]
    many = _mix(many)
    out, sizes = [], np.zeros(n, np.int64)
    for d, (a, c) in enumerate(zip(first.tolist(), count.tolist())):
        if c >= size:
            h = np.unique(many[a : a + c - size + 1])
        else:
            h = _mix((words[a : a + c] * np.array(salt[:c], np.uint64)).sum(dtype=np.uint64, keepdims=True) + np.uint64(c + 1))
        out.append(h)
        sizes[d] = len(h)
    return np.concatenate(out) if out else many, sizes


def shingle_words(text: str | None, size: int) -> set[bytes]:
    """The shingles themselves, cut as ``shingle_sets`` cuts them."""
    words = (text or "").encode("utf-8").lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def least_shared(n: np.ndarray, share: float) -> np.ndarray:
    """Shingles a set of ``n`` has at least in common with a set as similar as ``share``."""
    return np.ceil(n * share - 1e-9).astype(np.int64)


def parity(hashes: np.ndarray) -> np.ndarray:
    """A bit for each remainder of the hashes: whether an odd number of them has it."""
    return np.packbits((np.bincount((hashes & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8))


def _task(sig: np.ndarray, tasks: int) -> np.ndarray:
    # prefixes take small hashes first, so tasks go by other bits
    return ((sig * _C) >> np.uint64(33)) % np.uint64(tasks)


def postings(docs: DataFrame, share: float, size: int, id_col: str, text_col: str) -> DataFrame:
    """``task, rows``: for tasks the prefixes' shingles that other texts have too; under -1 the sets they are of."""
    dealt, text_at, total = buckets.deal(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", BUCKET_BYTES)
    shards, block = buckets.hash_shards(total), BLOCK
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), round(total / TASK_BYTES))
    schema = _arrow_schema(docs.sparkSession, _SENT)

    def send_hashes(table: pa.Table) -> pa.Table:
        bucket = Bucket(table["rows"].to_pylist(), text_at)
        h, sizes = shingle_sets(bucket.data, bucket.ends, size)
        out = buckets.ask(table["bucket"][0].as_py(), buckets.hash_keys(h, shards), np.repeat(np.arange(len(sizes)), sizes))
        del bucket, h
        release()
        return out

    def send_postings(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        bucket = Bucket(left["rows"].to_pylist(), text_at)
        number = left["bucket"][0].as_py()
        h, sizes = shingle_sets(bucket.data, bucket.ends, size)
        key, spot = np.unique(buckets.hash_keys(h, shards), return_inverse=True)
        of = buckets.classes(key, right)[spot]
        doc = np.repeat(np.arange(len(sizes)), sizes)
        first = np.cumsum(sizes) - sizes
        by = np.lexsort((h, of, doc))
        pos = np.arange(len(h)) - first[doc]
        sent = by[(of[by] > 0) & (pos < (sizes - least_shared(sizes, share) + 1)[doc])]
        p = np.empty(len(sent), _POSTING)
        p["sig"], p["k"], p["n"] = h[sent], (number << 24) + doc[sent], sizes[doc[sent]]
        rank = np.empty(len(h), np.int64)
        rank[by] = pos
        p["pos"] = rank[sent]
        # a class c stands for up to 2^c sets; beyond a block, two half blocks meet at a time
        most = 1 << of[sent].astype(np.int64)
        blocks = np.where(most <= block, 1, -(-2 * most // block))
        some = [p[blocks == 1]]
        for i in np.flatnonzero(blocks > 1).tolist():
            n, row = int(blocks[i]), p[i : i + 1]
            mine = int(_mix(row["k"].view(np.uint64) * _B)[0] % np.uint64(n))
            other = np.array([j for j in range(n) if j != mine], np.uint64)
            more = np.repeat(row, n - 1)
            more["sig"] = _mix(more["sig"] + np.minimum(other, mine) * _B + np.maximum(other, mine) * _C)
            some.append(more)
        p = np.concatenate(some)
        rows: dict[str, list] = {"task": [], "rows": []}
        task = _task(p["sig"], tasks).astype(np.int64)
        by = np.argsort(task, kind="stable")
        for t, at in buckets.parts(task[by]):
            rows["task"].append(t)
            rows["rows"].append(p[by[at]].tobytes())
        used = np.unique(doc[sent])
        if len(used):
            sink = pa.BufferOutputStream()
            sets = pa.table({
                "k": (number << 24) + used, "doc_id": pa.array([None if bucket.ids[d] == buckets.NO_ID else int(bucket.ids[d]) for d in used], pa.int64()), "n": sizes[used].astype(np.int32),
                "bits": pa.array([parity(h[first[d] : first[d] + sizes[d]]).tobytes() for d in used], pa.binary()),
                "text": pa.array([bucket.data[bucket.ends[d - 1] if d else 0 : bucket.ends[d]].decode("utf-8") for d in used], pa.string()),
            })
            with pa.ipc.new_stream(sink, sets.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(sets)
            rows["task"].append(-1)
            rows["rows"].append(sink.getvalue().to_pybytes())
        del bucket, h, by, pos, doc, spot
        release()
        return pa.table(rows, schema=schema)

    replies = buckets.answers(dealt.groupBy("bucket").applyInArrow(send_hashes, buckets.ASKED))
    return dealt.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(send_postings, _SENT)


def sets_of(posted: DataFrame) -> DataFrame:
    """``k, doc_id, n, bits, text`` of the sets that may meet others."""
    schema = "k long, doc_id long, n int, bits binary, text string"

    def grow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                yield from pa.ipc.open_stream(blob)
        release()

    return posted.filter("task = -1").select("rows").mapInArrow(grow, schema)


def meetings(posted: DataFrame) -> DataFrame:
    """``task, sig, k, n, pos``: the sets that share a shingle of their prefixes."""

    def meet(table: pa.Table) -> pa.Table:
        p = np.concatenate([np.frombuffer(r, _POSTING) for r in table["rows"].to_pylist()])
        order = np.argsort(p["sig"], kind="stable")
        sig = p["sig"][order]
        same = sig[1:] == sig[:-1]
        p = p[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
        release()
        return pa.table({"task": np.full(len(p), table["task"][0].as_py(), np.int32), "sig": p["sig"].view(np.int64), "k": p["k"], "n": p["n"], "pos": p["pos"]})

    return posted.filter("task >= 0").groupBy("task").applyInArrow(meet, "task int, sig long, k long, n int, pos int")


def candidates(met: DataFrame, share: float, nearest: bool) -> DataFrame:
    """Pairs ``a, b`` of sets that meet and whose sizes, places, bitmaps and roots (column ``root``) let them be a new link.

    With ``nearest`` only the one whose bitmap is closest, for each set and task.
    """

    def run(table: pa.Table) -> pa.Table:
        sig, k, n, pos, root = (table[c].to_numpy() for c in ("sig", "k", "n", "pos", "root"))
        # a set's bitmap is kept once, however often it meets
        which, at, spot = np.unique(k, return_index=True, return_inverse=True)
        raw = table["bits"].combine_chunks().take(pa.array(at))
        bits = np.frombuffer(b"".join(raw.to_pylist()), np.uint64).reshape(len(which), -1)
        size = n[at]
        del table, raw
        order = np.lexsort((k, n, sig))
        sig, n, pos, root, spot = (x[order] for x in (sig, n, pos, root, spot))
        found = [np.zeros((0, 2), np.int64)]
        best, partner = np.full(len(which), np.inf), np.full(len(which), -1)

        def keep(i: np.ndarray, j: np.ndarray) -> None:
            both = np.minimum(pos[i], pos[j]) + 1 + np.minimum(n[i] - pos[i], n[j] - pos[j]) - 1
            ok = (root[i] != root[j]) & (both >= share / (1 + share) * (n[i] + n[j]) - 1e-9)
            i, j = spot[i[ok]], spot[j[ok]]
            for a in range(0, len(i), 1 << 16):
                x, y = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
                apart = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64) / (size[x] + size[y])
                near = apart <= (1 - share) / (1 + share) + 1e-9
                x, y, apart = x[near], y[near], apart[near]
                if not nearest:
                    found.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0))
                    continue
                ends, others, apart = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([apart, apart])
                by = np.lexsort((others, apart, ends))
                by = by[np.flatnonzero(np.diff(ends[by], prepend=-1))]
                by = by[apart[by] < best[ends[by]]]
                best[ends[by]], partner[ends[by]] = apart[by], others[by]
            if len(found) > 64:
                found[:] = [np.unique(np.concatenate(found), axis=0)]

        # sets of a meeting stand by size: beyond one that is too large all are
        i, d = np.arange(len(sig)), 1
        while len(i):
            i = i[i + d < len(sig)]
            i = i[(sig[i + d] == sig[i]) & (n[i] >= least_shared(n[i + d], share))]
            keep(i, i + d)
            d += 1
        if nearest:
            some = np.flatnonzero(partner >= 0)
            found = [np.sort(np.stack([some, partner[some]], 1), axis=1)]
        pairs = which[np.unique(np.concatenate(found), axis=0)]
        release()
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return met.select("task", "sig", "k", "n", "pos", "bits", "root").groupBy("task").applyInArrow(run, "a long, b long").distinct()


def similar(pairs: DataFrame, sets: DataFrame, share: float, size: int) -> DataFrame:
    """Pairs ``src, dst`` whose shingles are as similar as ``share``, compared word by word."""
    ta, tb = (sets.select(F.col("k").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")

    def equal(cols: list[list]) -> dict[str, list]:
        out: dict[str, list] = {"src": [], "dst": []}
        last, q = None, set()
        for x, y, s, t in zip(*cols):
            if y != last:
                last, q = y, shingle_words(t, size)
            p = shingle_words(s, size)
            shared = len(p & q)
            if shared >= share * (len(p) + len(q) - shared) - 1e-9:
                out["src"].append(x)
                out["dst"].append(y)
        return out

    return map_rows(pairs.join(ta, "a").join(tb, "b").select("a", "b", "text_a", "text_b"), equal, "src long, dst long")


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["t"] == b["t"])


def near_copy_groups(
    docs: DataFrame, share: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None
) -> DataFrame:
    """``doc_id, t, grp`` of rows that are linked to another: by texts of Jaccard similarity ``share`` or more, or by further ones.

    Similarity is over the distinct shingles of ``size`` words, ASCII lower-cased
    and parted by white space; a text of fewer words is one shingle, texts without
    words are alike.  ``t`` is the text's XXH64 (a null text as empty), so that
    ``doc_id`` and ``t`` name a row.  Rows equal in id and text count once; rows
    that are like no other are not returned.  Rows that ``known`` (``doc_id, t,
    root``, a written table) has under one root are linked beforehand, and the
    search goes on from there.
    """
    posted = written(postings(docs, share, size, id_col, text_col), "postings")
    sets = written(sets_of(posted), "sets")
    met = written(meetings(posted), "meetings")
    few = sets.count() <= BROADCAST_SETS

    def with_roots(roots: DataFrame | None) -> DataFrame:
        side = sets.select("k", "bits")
        side = side.withColumn("root", F.col("k")) if roots is None else side.join(roots, "k", "left").withColumn("root", F.coalesce("root", "k"))
        return met.join(F.broadcast(side) if few else side, "k")

    links, roots = None, None
    if known is not None:
        own = sets.select("k", "doc_id", F.xxhash64("text").alias("t"))
        seeds = written(own.join(known, _same_row(own, known)).select("k", "root"), "seeds")
        heads = seeds.groupBy("root").agg(F.min("k").alias("head"))
        links = written(seeds.join(heads, "root").filter("k <> head").select(F.col("k").alias("src"), F.col("head").alias("dst")), "links")
        roots = links.select(F.col("src").alias("k"), F.col("dst").alias("root"))
    for nearest in [True] * NEAREST_ROUNDS + [False]:
        new = similar(candidates(with_roots(roots), share, nearest), sets, share, size)
        links = written(new if links is None else links.unionByName(new), "links")
        roots = written(connected_components(links), "roots").withColumnRenamed("node", "k")
    found = sets.join(roots, "k").select("doc_id", F.xxhash64("text").alias("t"), F.col("root").alias("grp"))
    if known is None:
        return found
    # sets of one root are in one group; its rows that meet none in a shingle follow them
    found = written(found, "found")
    both = known.join(found, _same_row(known, found), "full").select(*(F.coalesce(known[c], found[c]).alias(c) for c in ("doc_id", "t")), "root", "grp")
    both = written(both, "both")
    whole = both.filter("root is not null").groupBy("root").agg(F.min("grp").alias("_g"))
    grp = F.coalesce("grp", "_g")
    return both.join(whole, "root", "left").select("doc_id", "t", F.struct(grp.alias("k"), F.when(grp.isNull(), F.col("root")).alias("root")).alias("grp"))


def keep_first(
    docs: DataFrame, share: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text", known: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """One row of each group of near copies: that with the smallest id; columns stay as they are.

    Of rows equal in text the first stays, so repeated rows become one; differing
    texts under one id are decided each by its own group.  Rows without an id
    come after all others, by their text's hash; a null text is an empty one.
    An empty table stays empty.  ``known`` gives groups of rows found by other
    means, which the search starts from (``near_copy_groups``).
    """
    own, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    longest = "_" * max(len(c) for c in docs.columns)
    c_id, c_t, c_u, c_first, c_again = (f"{longest}{x}" for x in ("id", "t", "u", "first", "again"))
    # copies first: only rows of digests go through the shuffle
    named = docs.select(own.alias(c_id), F.xxhash64(text).alias(c_t), F.md5(text.cast("binary")).alias(c_u))
    counted = named.groupBy(c_id, c_t, c_u).agg(F.count("*").alias("n"))
    key = F.struct(F.col(c_id).isNull().alias("none"), F.col(c_id).alias("id"))
    copies = counted.groupBy(c_t, c_u).agg(F.min(key).alias(c_first), (F.min_by("n", key) > 1).alias(c_again), F.sum("n").alias("n")).filter("n > 1").drop("n")
    copies = written(copies, "copies")
    few = copies.count() <= BROADCAST_IDS
    tagged = docs.withColumns({c_id: own, c_t: F.xxhash64(text), c_u: F.md5(text.cast("binary"))}).join(F.broadcast(copies) if few else copies, [c_t, c_u], "left")
    one = tagged.filter(F.col(c_first).isNull() | F.col(c_id).eqNullSafe(F.col(f"{c_first}.id")))
    if copies.filter(F.col(c_again)).limit(1).count():
        again = F.coalesce(F.col(c_again), F.lit(False))
        one = one.filter(~again).unionByName(one.filter(again).dropDuplicates([c_id, c_t, c_u]))
    rows = one.select(own.alias("doc_id"), text.alias("text"))
    groups = near_copy_groups(rows, share, size, known=known(rows) if known else None)
    groups = written(groups, "groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("t"))
    first = groups.groupBy("grp").agg(F.min(order).alias("first"))
    gone = groups.join(first, "grp").filter(~order.eqNullSafe(F.col("first"))).select(F.col("doc_id").alias(f"{c_id}_gone"), F.col("t").alias(f"{c_t}_gone"))
    gone = written(gone, "gone")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    kept = one.join(side, F.col(c_id).eqNullSafe(F.col(f"{c_id}_gone")) & (F.col(c_t) == F.col(f"{c_t}_gone")), "left_anti")
    return kept.select(docs.columns)
