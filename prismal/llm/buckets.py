"""Documents dealt to buckets, and what a bucket learns of all others by asking hash shards.

Steps that read the same dealt documents see equal buckets: what rows hold, and
nothing else, decides bucket and order.  In one plan their exchange is shared.
A bucket sends its hashes, 32 bits each, to the shards of the hashes; a shard
replies with a class for each: 0 where only one document has it, else one more
than the binary logarithm of its count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismal.llm.common import BATCH_BYTES, _arrow_schema, release, ship, slices

#: Bytes of text for a shard of hashes.
HASH_SHARD_BYTES = 8 << 20
ASKED, ANSWERS = "shard int, bucket int, hashes binary", "bucket int, shard int, known binary"
_LOW = np.uint64(0xFFFFFFFF)
NO_ID = np.iinfo(np.int64).max
#: Counts from here on do not fit their byte.
MANY = 127


def pack(a: np.ndarray) -> bytes:
    """Bytes of an array, plane by plane, which compresses better."""
    return a.view(np.uint8).reshape(len(a), -1).T.tobytes()


def unpack(raw: bytes, kind) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(wide, -1).T).view(kind).ravel()


def parts(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(key, slice) of equal neighbours."""
    stops = np.flatnonzero(np.diff(keys)) + 1
    for a, b in zip([0, *stops.tolist()], [*stops.tolist(), len(keys)]):
        if b > a:
            yield int(keys[a]), slice(a, b)


def deal(docs: DataFrame, id_col: str, text_col: str, bucket_bytes: int) -> tuple[DataFrame, int, int]:
    """``bucket, rows`` (compressed Arrow streams of the documents, their id as a long last), the text's place, all bytes of text."""
    ship(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first().n or 0
    buckets = max(1, round(total / bucket_bytes))
    own_id = F.col(id_col).cast("long")
    # the new columns stand last, under names that no other column has
    longest = "_" * max(len(c) for c in docs.columns)
    number = F.pmod(F.xxhash64(own_id, text_col), F.lit(buckets)).cast("int")
    placed = docs.select("*", own_id.alias(f"{longest}id"), number.alias(f"{longest}bucket"))
    dealt_to = pa.schema([("bucket", pa.int32()), ("rows", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            for part in slices(batch, BATCH_BYTES):
                bucket = part.column(part.num_columns - 1).to_numpy()
                part = part.select(list(range(part.num_columns - 1)))
                by = np.argsort(bucket, kind="stable")
                rows: dict[str, list] = {"bucket": [], "rows": []}
                for b, at in parts(bucket[by]):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema, options=options) as w:
                        w.write_batch(part.take(pa.array(by[at])))
                    rows["bucket"].append(b)
                    rows["rows"].append(sink.getvalue().to_pybytes())
                yield pa.RecordBatch.from_pydict(rows, dealt_to)
        release()

    return placed.mapInArrow(send, "bucket int, rows binary"), docs.columns.index(text_col), total


class Bucket:
    """The rows of a bucket: distinct pairs of id and text, by id, then text, are its documents.

    ``ids``, ``ends`` and ``data`` hold the documents, a null id as the largest;
    ``place`` is the document of each row of ``table``, ``texts`` the rows' texts.
    Rows equal in id and text all meet in one bucket.
    """

    def __init__(self, blobs: list[bytes], text_at: int):
        tables = [pa.ipc.open_stream(b).read_all() for b in blobs]
        self.table = pa.concat_tables(tables) if tables else None
        texts = [t.encode("utf-8") if t else b"" for t in self.table.column(text_at).to_pylist()] if tables else []
        named = [NO_ID if i is None else i for i in self.table.column(self.table.num_columns - 1).to_pylist()] if tables else []
        order = sorted(range(len(texts)), key=lambda r: (named[r], texts[r]))
        self.texts, self.place = texts, np.zeros(len(texts), np.int64)
        ids, distinct = [], []
        for r in order:
            if not ids or ids[-1] != named[r] or distinct[-1] != texts[r]:
                ids.append(named[r])
                distinct.append(texts[r])
            self.place[r] = len(ids) - 1
        self.ids = np.array(ids, np.int64)
        self.ends = np.cumsum([len(t) for t in distinct], dtype=np.int64) if distinct else np.zeros(0, np.int64)
        self.data = b"".join(distinct)


def hash_shards(total: int) -> int:
    return max(1, round(total / HASH_SHARD_BYTES))


def hash_keys(h: np.ndarray, shards: int) -> np.ndarray:
    """Hash shard and the 32 bits that stand for a hash there; two hashes under one key count as one."""
    return ((h >> np.uint64(32)) % np.uint64(shards)) << np.uint64(32) | (h & _LOW)


def ask(number: int, key: np.ndarray, owner: np.ndarray) -> pa.Table:
    """A row for each hash shard: the distinct keys of a bucket, how often each occurs and whether under several owners.

    A count is a byte's lower bits; those of ``MANY`` and more follow at the end, 32 bits each.
    """
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3).compress
    by = np.argsort(key, kind="stable")
    key, owner = key[by], owner[by]
    rows: dict[str, list] = {"shard": [], "bucket": [], "hashes": []}
    if len(key):
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        several = np.minimum.reduceat(owner, at) < np.maximum.reduceat(owner, at)
        whole = np.diff(np.append(at, len(key)))
        count = np.minimum(whole, MANY).astype(np.uint8) | (several.astype(np.uint8) << 7)
        key = key[at]
        for shard, part in parts((key >> np.uint64(32)).astype(np.int64)):
            rows["shard"].append(shard)
            rows["bucket"].append(number)
            own = whole[part]
            more = own[own >= MANY].astype(np.uint32)
            steps = np.diff((key[part] & _LOW).astype(np.uint32), prepend=np.uint32(0))
            rows["hashes"].append(squeeze(np.uint32(len(own)).tobytes() + pack(steps) + count[part].tobytes() + more.tobytes()))
    return pa.table(rows, schema=pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("hashes", pa.binary())]))


def answers(asked: DataFrame) -> DataFrame:
    """Classes for every bucket that asked and has a hash in common with another document."""
    schema = _arrow_schema(asked.sparkSession, ANSWERS)

    def reply(table: pa.Table) -> pa.Table:
        import zstandard

        grow, squeeze = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress
        keys, counts, heavy = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint8)], [np.zeros(0, np.uint32)]
        for raw in map(grow, table["hashes"].to_pylist()):
            n = int(np.frombuffer(raw, np.uint32, 1)[0])
            keys.append(np.cumsum(unpack(raw[4 : 4 + 4 * n], np.uint32), dtype=np.uint32))
            counts.append(np.frombuffer(raw, np.uint8)[4 + 4 * n : 4 + 5 * n])
            heavy.append(np.frombuffer(raw[4 + 5 * n :], np.uint32))
        sizes = [len(k) for k in keys[1:]]
        count = np.concatenate(counts)
        _, spot, buckets = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        del keys, counts
        repeated = (buckets > 1) | (np.bincount(spot, count >> 7, len(buckets)) > 0)
        few = count & 127
        times = np.bincount(spot, few, len(buckets))
        at = np.flatnonzero(few == MANY)
        times += np.bincount(spot[at], np.concatenate(heavy) - float(MANY), len(buckets))
        # the exponent of 2^c <= n < 2^(c + 1) is c + 1
        of = np.where(repeated, np.frexp(times)[1], 0).astype(np.uint8)
        rows: dict[str, list] = {"bucket": [], "shard": [], "known": []}
        at = 0
        for bucket, n in zip(table["bucket"].to_pylist(), sizes):
            mine = of[spot[at : at + n]]
            at += n
            if mine.any():
                rows["bucket"].append(bucket)
                rows["shard"].append(table["shard"][0].as_py())
                rows["known"].append(squeeze(mine.tobytes()))
        release()
        return pa.table(rows, schema=schema)

    return asked.groupBy("shard").applyInArrow(reply, ANSWERS)


def classes(key: np.ndarray, answered: pa.Table) -> np.ndarray:
    """The class of each of a bucket's distinct keys, in their order."""
    import zstandard

    grow = zstandard.ZstdDecompressor().decompress
    out = np.zeros(len(key), np.uint8)
    for shard, raw in zip(answered["shard"].to_pylist(), answered["known"].to_pylist()):
        a, b = np.searchsorted(key, np.array([shard, shard + 1], np.uint64) << np.uint64(32))
        known = np.frombuffer(grow(raw), np.uint8)
        if len(known) != b - a:
            raise RuntimeError("a bucket's documents changed between two steps")
        out[a:b] = known
    return out
