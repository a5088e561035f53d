"""Exact repeated-substring removal through suffix order and longest-previous-factor arrays.

A byte goes if a string of ``size`` bytes that covers it also starts in a
document with a smaller id.  Texts are cut into runs of windows that share their
smallest hashed ``kmer``; equal windows share it, so they meet wherever it is sent.

1. Documents are dealt to buckets by id and text, which three steps read again.
2. Buckets send the hashes of their runs; the hash shards reply which ones occur
   in several documents and which are frequent.
3. Buckets send the runs that may have a partner, equal runs once, under the
   smallest id.  Windows of a frequent hash go one by one, dealt by their bytes,
   so that no shard holds all that surrounds a passage which is everywhere.
4. A shard folds what it is sent into distinct runs, sorts the suffixes that
   begin at their windows, each up to its run's end, takes common prefixes of
   neighbours and finds, by the previous and next suffix of a smaller document,
   the longest previous factor at every window; ``LPF`` bytes go where it is
   ``size`` or more.  Ranges return to the buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismal.llm import buckets
from prismal.llm.buckets import Bucket
from prismal.llm.common import _arrow_schema, release

SIZE = 50
#: Bytes hashed at each position: long ones are rarely shared by texts that share nothing longer.
KMER = 24
#: Windows of a run at most; only periodic text has longer ones.
LONGEST = 32
#: Bytes of text in a bucket, and of text for a shard of runs.
BUCKET_BYTES, SHARD_BYTES = 4 << 20, 4 << 20
#: Bytes cut into runs at once, and of runs whose suffixes are sorted at once.
STRETCH, SORT_BYTES = 1 << 18, 1 << 19
#: Class of hashes beyond which windows are dealt by their bytes (2^14 runs or more); never a change of result.
FREQUENT = 14
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_LOW = np.uint64(0xFFFFFFFF)


def _words(data: bytes) -> np.ndarray:
    """The eight bytes from every position as little-endian integers."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def kmer_of(size: int) -> int:
    """Bytes hashed at a position for windows of ``size`` bytes."""
    if size < 8:
        raise ValueError(f"size is {size}; strings of 8 bytes or more can be searched")
    return min(KMER, max(8, size // 2))


def window_hashes(data: bytes, size: int) -> np.ndarray:
    """The smallest hash of the ``kmer_of(size)``-grams in every window of ``size`` bytes."""
    k = kmer_of(size)
    places = [*range(0, k - 7, 8), *([k - 8] if k % 8 else [])]
    words, n = _words(data), len(data) - k + 1
    h = words[:n] * _A
    for i, p in enumerate(places[1:], 1):
        h = (h << np.uint64(7)) ^ (h >> np.uint64(57)) ^ (words[p : p + n] * (_B if i % 2 else _C))
        h *= _A
    h ^= h >> np.uint64(32)
    h *= _C
    h ^= h >> np.uint64(29)
    span, wide = 1, size - k + 1
    while span * 2 <= wide:
        h, span = np.minimum(h[:-span], h[span:]), span * 2
    return np.minimum(h[: len(h) - (wide - span)], h[wide - span :]) if span < wide else h


def runs(data: bytes, ends: np.ndarray, size: int = SIZE, stretch: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, first window, windows) of every run in the concatenated texts ``data`` that stop at ``ends``.

    Stretches of text are cut one after another, so a long text takes no more memory than short ones.
    """
    step = stretch or STRETCH
    first = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    stops = np.maximum(ends - size + 1, first)
    none = np.zeros(0, np.int64)
    out = [(none.view(np.uint64), none, none, none)]
    for a in range(0, len(data) - size + 1, step):
        h = window_hashes(data[a : a + step + size - 1], size)
        n = len(h)
        edge = np.zeros(n + 1, bool)
        edge[0] = edge[-1] = True
        edge[1:-1] = h[1:] != h[:-1]
        for marks in (first, stops):
            lo, hi = np.searchsorted(marks, [a, a + n])
            edge[marks[lo:hi] - a] = True
        at = np.flatnonzero(edge)
        long = np.flatnonzero(np.diff(at) > LONGEST)
        if len(long):
            more = [np.arange(at[i] + LONGEST, at[i + 1], LONGEST) for i in long.tolist()]
            at = np.sort(np.concatenate([at, *more]))
        begin, count = at[:-1] + a, np.diff(at)
        doc = np.searchsorted(ends, begin, side="right")
        # windows that begin in a document's last size - 1 bytes run into the next one
        good = begin < stops[doc]
        out.append((h[at[:-1][good]], doc[good], begin[good], count[good]))
    return tuple(np.concatenate(x) for x in zip(*out))


def sorted_suffixes(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes ``data[start : start + length]``, and what each has in common with the one before it.

    Words of eight bytes are compared one after another, each only where suffixes are still tied.
    """
    n = len(starts)
    words, one = _words(data + bytes(8)), np.uint64(1)

    def word(k: int, which: np.ndarray) -> np.ndarray:
        left = lengths[which] - 8 * k
        w = words[np.where(left > 0, starts[which] + 8 * k, 0)].byteswap()
        # bytes behind a suffix's end read as zero
        return np.where(left >= 8, w, np.where(left > 0, w & ~((one << (np.uint64(8) * (8 - np.clip(left, 1, 8)).astype(np.uint64))) - one), np.uint64(0)))

    def shared(x: np.ndarray) -> np.ndarray:
        # zero bytes before the highest one set
        high = (x >> np.uint64(32)) != 0
        half = np.where(high, x >> np.uint64(32), x & _LOW)
        return (np.where(high, 32, 64) - np.frexp(half.astype(np.float64))[1]) // 8

    order = np.arange(n)
    common, apart = np.zeros(n, np.int64), np.zeros(n, bool)
    apart[:1] = True
    tied = np.arange(n)
    for k in range(-(-int(lengths.max(initial=0)) // 8)):
        group = np.cumsum(apart)[tied]
        w = word(k, order[tied])
        by = np.lexsort((w, group))
        order[tied], w = order[tied][by], w[by]
        differ = np.flatnonzero((w[1:] != w[:-1]) & (group[1:] == group[:-1])) + 1
        common[tied[differ]] = 8 * k + shared(w[differ] ^ w[differ - 1])
        apart[tied[differ]] = True
        both = ~apart
        tied = np.flatnonzero(both | np.concatenate([both[1:], [False]]))
        if not len(tied):
            break
    least = np.minimum(lengths[order[1:]], lengths[order[:-1]])
    common[1:] = np.minimum(np.where(apart[1:], common[1:], least), least)
    return order, common


def previous_smaller(order_doc: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """Common prefix with the nearest earlier suffix of a smaller document, where it is ``least`` or more; else 0.

    ``lcp[i]`` is the common prefix of suffixes i - 1 and i.  Pointers jump over
    suffixes of no smaller document, taking the smaller prefix along.
    """
    n = len(order_doc)
    to, best, out = np.arange(-1, n - 1), lcp.copy(), np.zeros(n, lcp.dtype)
    best[:1] = 0
    open_ = np.flatnonzero(best >= least)
    while len(open_):
        p = to[open_]
        smaller = order_doc[p] < order_doc[open_]
        out[open_[smaller]] = best[open_[smaller]]
        rest, q = open_[~smaller], p[~smaller]
        # best[q] already is the least prefix on the way from q to where it points
        step_best, step_to = np.minimum(best[rest], best[q]), to[q]
        best[rest], to[rest] = step_best, step_to
        open_ = rest[(step_best >= least) & (step_to >= 0)]
    return out


def previous_factors(data: bytes, starts: np.ndarray, lengths: np.ndarray, docs: np.ndarray, least: int) -> np.ndarray:
    """Longest prefix of each suffix that also begins a suffix of a smaller document; 0 where it is under ``least``."""
    order, common = sorted_suffixes(data, starts, lengths)
    d = docs[order]
    back = previous_smaller(d, common, least)
    # the next smaller is the previous smaller of the order read backwards
    ahead = previous_smaller(d[::-1], np.concatenate([common[:1] * 0, common[:0:-1]]), least)[::-1]
    out = np.zeros(len(starts), np.int64)
    out[order] = np.maximum(back, ahead)
    return out


def earlier_ranges(data: bytes, ends: np.ndarray, docs: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, begin, end) of what earlier documents' runs hold of the concatenated runs ``data``, counted from a run's start."""
    first = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    windows = np.maximum(ends - first - size + 1, 0)
    which = np.repeat(np.arange(len(ends)), windows)
    starts = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows) + first[which]
    factor = previous_factors(data, starts, ends[which] - starts, docs[which], size)
    hit = np.flatnonzero(factor >= size)
    if not len(hit):
        return hit, hit, hit
    new = np.concatenate([[True], (np.diff(starts[hit]) != 1) | (np.diff(which[hit]) != 0)])
    lo = np.flatnonzero(new)
    run = which[hit[lo]]
    return run, starts[hit[lo]] - first[run], np.maximum.reduceat(starts[hit] + factor[hit], lo) - first[run]


_RUNS, _RANGES = "shard int, bucket int, data binary, places binary", "bucket int, ranges binary"


def _ranges(number: np.ndarray, doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Table:
    """A row for each bucket: documents, begins and ends."""
    by = np.argsort(number, kind="stable")
    rows: dict[str, list] = {"bucket": [], "ranges": []}
    for bucket, at in buckets.parts(number[by]):
        rows["bucket"].append(bucket)
        rows["ranges"].append(np.stack([x[by[at]] for x in (doc, begin, end)]).astype(np.uint32).tobytes())
    return pa.table(rows, schema=pa.schema([("bucket", pa.int32()), ("ranges", pa.binary())]))


def removed_ranges(dealt: DataFrame, text_at: int, total: int, size: int) -> DataFrame:
    """``bucket, ranges`` of what goes, over the dealt documents of ``total`` bytes."""
    hash_shards, shards = buckets.hash_shards(total), max(1, round(total / SHARD_BYTES))
    frequent, sort_bytes = FREQUENT, SORT_BYTES
    run_schema = _arrow_schema(dealt.sparkSession, _RUNS)

    def send_hashes(table: pa.Table) -> pa.Table:
        bucket = Bucket(table["rows"].to_pylist(), text_at)
        h, doc, _, _ = runs(bucket.data, bucket.ends, size)
        out = buckets.ask(table["bucket"][0].as_py(), buckets.hash_keys(h, hash_shards), bucket.ids[doc])
        del bucket, h, doc
        release()
        return out

    def send_runs(left: pa.Table, right: pa.Table) -> pa.Table:
        import xxhash
        import zstandard

        if not left.num_rows or not right.num_rows:
            return run_schema.empty_table()
        squeeze = zstandard.ZstdCompressor(level=3).compress
        number = left["bucket"][0].as_py()
        bucket = Bucket(left["rows"].to_pylist(), text_at)
        h, doc, begin, count = runs(bucket.data, bucket.ends, size)
        key, spot = np.unique(buckets.hash_keys(h, hash_shards), return_inverse=True)
        known = buckets.classes(key, right)[spot]
        sent, often = known > 0, known > frequent
        alone = np.flatnonzero(sent & often)
        sent = np.flatnonzero(sent & ~often)
        # windows of frequent hashes are runs of their own
        more = np.repeat(alone, count[alone])
        step = np.arange(len(more)) - np.repeat(np.cumsum(count[alone]) - count[alone], count[alone])
        begin, end = np.concatenate([begin[sent], begin[more] + step]), np.concatenate([(begin + count)[sent] + size - 1, begin[more] + step + size])
        doc, h = np.concatenate([doc[sent], doc[more]]), np.concatenate([h[sent], h[more]])
        by = np.argsort(begin, kind="stable")
        single = np.arange(len(begin)) >= len(sent)
        # documents stand by id: the first of equal runs has the smallest one, and speaks for those of larger ids
        data, seen = bucket.data, {}
        stay, late, shard = [], [], []
        for i, a, b, owner, one, x in zip(by.tolist(), begin[by].tolist(), end[by].tolist(), bucket.ids[doc[by]].tolist(), single[by].tolist(), (h[by] % np.uint64(shards)).tolist()):
            piece = data[a:b]
            if seen.setdefault(piece, owner) < owner:
                late.append(i)
            else:
                stay.append(i)
                shard.append(xxhash.xxh64_intdigest(piece) % shards if one else x)
        first = np.concatenate([[0], bucket.ends[:-1]])
        rows: dict[str, list] = {"shard": [], "bucket": [], "data": [], "places": []}
        if late:
            # what is decided travels along under negative shards
            d = doc[late]
            rows["shard"].append(-1 - number % shards)
            rows["bucket"].append(number)
            rows["data"].append(squeeze(np.stack([d, begin[late] - first[d], end[late] - first[d]]).astype(np.uint32).tobytes()))
            rows["places"].append(b"")
        shard, stay = np.array(shard, np.int64), np.array(stay, np.int64)
        by = np.argsort(shard, kind="stable")
        stay = stay[by]
        for at, part in buckets.parts(shard[by]):
            mine = stay[part]
            a, b, d = begin[mine], end[mine], doc[mine]
            rows["shard"].append(at)
            rows["bucket"].append(number)
            rows["data"].append(squeeze(b"".join([data[x:y] for x, y in zip(a.tolist(), b.tolist())])))
            rows["places"].append(squeeze(buckets.pack(np.diff(bucket.ids[d], prepend=0)) + buckets.pack(d.astype(np.uint32)) + buckets.pack((a - first[d]).astype(np.uint32)) + (b - a).astype(np.uint8).tobytes()))
        release()
        return pa.table(rows, schema=run_schema)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        grow = zstandard.ZstdDecompressor().decompress
        seen: dict[bytes, int] = {}
        held: list[tuple[bytes, int, int, int, int]] = []
        for batch in batches:
            gone: list[tuple[int, int, int, int]] = []
            for shard, bucket, data, places in zip(*(c.to_pylist() for c in batch.columns)):
                if shard < 0:
                    yield from pa.table({"bucket": pa.array([bucket], pa.int32()), "ranges": pa.array([grow(data)], pa.binary())}).to_batches()
                    continue
                data, raw = grow(data), grow(places)
                n = len(raw) // 17
                owners = np.cumsum(buckets.unpack(raw[: 8 * n], np.int64)).tolist()
                docs, local = (buckets.unpack(raw[a * n : (a + 4) * n], np.uint32).tolist() for a in (8, 12))
                at = 0
                for owner, doc, begin, wide in zip(owners, docs, local, raw[16 * n :]):
                    piece = data[at : at + wide]
                    at += wide
                    i = seen.get(piece)
                    if i is None or held[i][1] == owner:
                        seen.setdefault(piece, len(held))
                        held.append((piece, owner, bucket, doc, begin))
                    elif held[i][1] < owner:
                        gone.append((bucket, doc, begin, begin + wide))
                    else:
                        _, _, b, d, x = held[i]
                        gone.append((b, d, x, x + wide))
                        held[i] = (piece, owner, bucket, doc, begin)
            if gone:
                yield from _ranges(*np.array(gone, np.int64).T).to_batches()
        seen.clear()
        yield from settle_distinct(held)
        held.clear()
        release()

    def settle_distinct(held: list[tuple[bytes, int, int, int, int]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        ends = np.cumsum([len(x[0]) for x in held], dtype=np.int64)
        owner, bucket, doc, begin = (np.array([x[k] for x in held], np.int64) for k in range(1, 5))
        # a run's first window has the hash of all
        data = b"".join(x[0] for x in held)
        h, of, _, _ = runs(data, ends, size)
        h = h[np.flatnonzero(np.diff(of, prepend=-1))]
        by = np.lexsort((owner, h))
        new = np.concatenate([[True], h[by][1:] != h[by][:-1]])
        group, at = np.cumsum(new) - 1, np.flatnonzero(new)
        some = owner[by][at] != owner[by][np.append(at[1:], len(by)) - 1]
        by, group = by[some[group]], group[some[group]]
        # whole groups of one hash are sorted together
        load = np.cumsum([len(held[i][0]) for i in by.tolist()], dtype=np.int64)
        whole = np.flatnonzero(np.diff(group, append=-1)) + 1
        cuts, last = [0], 0
        for stop, size_then in zip(whole.tolist(), load[whole - 1].tolist()):
            if size_then - last >= sort_bytes or stop == len(by):
                cuts.append(stop)
                last = size_then
        for a, b in zip(cuts[:-1], cuts[1:]):
            mine = by[a:b]
            pieces = [held[i][0] for i in mine.tolist()]
            run, lo, hi = earlier_ranges(b"".join(pieces), np.cumsum([len(p) for p in pieces], dtype=np.int64), owner[mine], size)
            if len(run):
                r = mine[run]
                yield from _ranges(bucket[r], doc[r], begin[r] + lo, begin[r] + hi).to_batches()

    replies = buckets.answers(dealt.groupBy("bucket").applyInArrow(send_hashes, buckets.ASKED))
    sent = dealt.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(send_runs, _RUNS)
    return sent.groupBy("shard").applyInArrow(settle, _RANGES)


def merge(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by ranges; ranges that touch become one."""
    order = np.argsort(begin, kind="stable")
    b, e = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], b[1:] > e[:-1]])
    last = np.append(np.flatnonzero(new)[1:], len(b)) - 1
    return b[new], e[last]


def _dedup(docs: DataFrame, id_col: str, text_col: str, finish: Callable, schema: str, size: int) -> DataFrame:
    """Cogroup documents with their ranges and let ``finish(table, texts, spans)`` make the output."""
    kmer_of(size)
    dealt, text_at, total = buckets.deal(docs, id_col, text_col, BUCKET_BYTES)
    schema_out = _arrow_schema(docs.sparkSession, schema)

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema_out.empty_table()
        bucket = Bucket(left["rows"].to_pylist(), text_at)
        found = [np.frombuffer(x, np.uint32).reshape(3, -1).astype(np.int64) for x in right["ranges"].to_pylist()]
        doc, begin, end = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        by = np.argsort(doc, kind="stable")
        doc, begin, end = doc[by], begin[by], end[by]
        spans = []
        for a, b in zip(np.searchsorted(doc, bucket.place).tolist(), np.searchsorted(doc, bucket.place, side="right").tolist()):
            spans.append(merge(begin[a:b], end[a:b]) if a < b else (begin[:0], end[:0]))
        table = finish(bucket.table.select(list(range(bucket.table.num_columns - 1))), bucket.texts, spans)
        del bucket
        release()
        return table

    ranges = removed_ranges(dealt, text_at, total, size)
    return dealt.groupBy("bucket").cogroup(ranges.groupBy("bucket")).applyInArrow(join, schema)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """What is removed from every document.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row.
    A null text is empty.  Rows with a null id count as later than all others
    and not as earlier than each other.  Rows of one id, repeated or not, do
    not remove from each other.  Other columns are ignored; an empty table gives an
    empty result.
    """

    def finish(table: pa.Table, texts: list[bytes], spans) -> pa.Table:
        sha, removed = [], []
        for t, (a, b) in zip(texts, spans):
            at, h = 0, hashlib.sha256()
            for x, y in zip(a.tolist(), b.tolist()):
                h.update(t[at:x])
                at = y
            h.update(t[at:])
            sha.append(h.hexdigest())
            removed.append(int((b - a).sum()))
        return pa.table({
            "doc_id": table.column(0).cast(pa.int64()), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array([len(a) for a, _ in spans], pa.int64()), "kept_sha256": pa.array(sha, pa.string()),
        })

    pairs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _dedup(pairs, "doc_id", "text", finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", size)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """Documents with later copies of repeated strings cut out of their texts; every row and column stays.

    Cuts begin and end at characters: a character goes when all its bytes go.
    A text that goes as a whole is empty; a null text stays null.
    """
    names = docs.columns
    text_at = names.index(text_col)

    def finish(table: pa.Table, texts: list[bytes], spans) -> pa.Table:
        kept = []
        for t, (a, b), was in zip(texts, spans, table.column(text_at).to_pylist()):
            out, at = [], 0
            for x, y in zip(a.tolist(), b.tolist()):
                while x < y and t[x] & 0xC0 == 0x80:
                    x += 1
                while y > x and y < len(t) and t[y] & 0xC0 == 0x80:
                    y -= 1
                out.append(t[at:x])
                at = y
            kept.append(None if was is None else (b"".join(out) + t[at:]).decode("utf-8"))
        return table.set_column(text_at, table.schema.field(text_at), pa.array(kept, table.schema.field(text_at).type))

    return _dedup(docs, id_col, text_col, finish, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), size)


def repeated_spans_sql(size: int = SIZE) -> str:
    """The same for table ``documents`` as DuckDB SQL, over the hex digits of the bytes; ids are distinct there."""
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, substr(x, CAST(2 * i + 1 AS BIGINT), {2 * size}) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - {size - 1})) AS i FROM d WHERE length(x) >= {2 * size})),
m AS (SELECT s, min(doc_id) AS f FROM w GROUP BY s),
g AS (SELECT doc_id, i FROM w JOIN m USING (s) WHERE f < doc_id),
r AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {size} THEN 0 ELSE 1 END AS n FROM g),
k AS (SELECT doc_id, i, sum(n) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM r),
sp AS (SELECT doc_id, min(i) AS a, max(i) + {size} AS b FROM k GROUP BY doc_id, run),
e AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM sp UNION ALL SELECT doc_id, max(b), NULL FROM sp GROUP BY doc_id),
kept AS (SELECT e.doc_id, string_agg(CASE WHEN e.e IS NULL THEN substr(x, 2 * s + 1) ELSE substr(x, 2 * s + 1, 2 * (e.e - s)) END, '' ORDER BY s) AS kx FROM e JOIN d USING (doc_id) GROUP BY e.doc_id),
t AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM sp GROUP BY doc_id)
SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kx, x))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN kept USING (doc_id)"""
