"""Ranked lexical search by windowed bucket scoring.

Queries are taken in blocks of bounded bytes.  For a block, documents are cut
into windows: at most ``WINDOW`` documents of a task, in ``doc_id`` order, so a
slot of a window stands for one document, and sparse or repeated ids cost
nothing.  A window keeps the posting lists of the block's terms (slots and
counts).  Collection statistics are sums over the windows.  Scoring traverses a
window's lists: every list's contributions are added into an array of the
window's slots, which fits a processor's cache, a bitset marks the occupied
ones, and what they hold is harvested into a heap of a query's best documents.
A task gives at most ``k`` rows a query to the shuffle.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prismal.llm.common import _arrow_schema, release, ship, slices, written

#: Documents of a window at most: 128 KB of scores.
WINDOW = 1 << 14
#: Bytes of Arrow data of a window at most, or one document.
WINDOW_BYTES = 8 << 20
#: Bytes of query text that one pass over the documents serves, or one query.
BLOCK_BYTES = 4 << 20
#: Digits, letters and all beyond ASCII, of a text in UTF-8 whose A-Z are lower-cased. A fixed pattern.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")

INDEX = "n_docs long, n_terms long, ids binary, named binary, sizes binary, df array<int>, slots binary, tf binary"
FOUND = "query int, doc_id long, score long"


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order: ``bytes.lower`` changes A-Z only."""
    return TERM.findall(text.encode("utf-8").lower()) if text else []


class Postings:
    """Posting lists of one window: ``slots`` and ``tf`` in the order of terms, ``df`` entries a term."""

    def __init__(self, ids: list, texts: list, vocabulary: dict[bytes, int]):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        term, slot, sizes = [], [], np.zeros(len(ids), np.int64)
        for at, i in enumerate(order):
            words = terms(texts[i])
            sizes[at] = len(words)
            own = [v for v in map(vocabulary.get, words) if v is not None]
            term.append(np.array(own, np.int64))
            slot.append(np.full(len(own), at, np.int64))
        key = np.concatenate(term) * max(1, len(ids)) + np.concatenate(slot)
        key, tf = np.unique(key, return_counts=True)
        self.ids = np.array([ids[i] or 0 for i in order], np.int64)
        self.named = np.array([ids[i] is not None for i in order], np.uint8)
        self.sizes = sizes
        self.df = np.bincount(key // max(1, len(ids)), minlength=len(vocabulary)).astype(np.int32)
        self.slots = (key % max(1, len(ids))).astype(np.uint16)
        self.tf = tf.astype(np.int32)


def index_windows(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each window of documents: how many have a term, their terms, ids, sizes and the posting lists of ``vocabulary``."""
    ship(docs.sparkSession)
    schema = _arrow_schema(docs.sparkSession, INDEX)
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, WINDOW_BYTES):
                for at in range(0, part.num_rows, WINDOW):
                    p = Postings(*(c.to_pylist() for c in part.slice(at, WINDOW).columns), known.value)
                    row = [int((p.sizes > 0).sum()), int(p.sizes.sum()), p.ids.tobytes(), p.named.tobytes(), p.sizes.tobytes(), p.df, p.slots.tobytes(), p.tf.tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)
        release()

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(build, INDEX)


class Best:
    """A heap of the ``k`` highest scores, of equal ones the smallest ids, ids that are null last."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def harvest(self, score: np.ndarray, ids: np.ndarray, named: np.ndarray) -> None:
        if len(self.heap) == self.k:
            keep = score >= self.heap[0][0]
            score, ids, named = score[keep], ids[keep], named[keep]
        if len(score) > self.k:
            keep = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, ids, named = score[keep], ids[keep], named[keep]
            # slots are in id order: of equal scores the first k are enough
            first = np.argsort(-score, kind="stable")[: self.k]
            score, ids, named = score[first], ids[first], named[first]
        for s, i, name in zip(score.tolist(), ids.tolist(), named.tolist()):
            entry = (s, name, -i)
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, entry)
            elif entry > self.heap[0]:
                heapq.heapreplace(self.heap, entry)


def _scored(index: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``query, doc_id, score``: the best ``k`` documents of every query in each task."""
    schema = _arrow_schema(index.sparkSession, FOUND)
    sent = index.sparkSession.sparkContext.broadcast((queries, weight))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, heavy = sent.value
        best = [Best(k) for _ in asked]
        for batch in batches:
            for row in batch.to_pylist():
                read = {c: np.frombuffer(row[c], t) for c, t in (("ids", np.int64), ("named", np.uint8), ("sizes", np.int64), ("slots", np.uint16), ("tf", np.int32))}
                df = np.array(row["df"], np.int64)
                ends = np.cumsum(df)
                spread = 100 - 75 + 75 * read["sizes"] * n_docs // max(1, n_terms)
                tf = read["tf"].astype(np.int64)
                gain = np.repeat(heavy, df) * (1_000_000_000 * tf // (1000 * tf + 8 * spread[read["slots"]]))
                bucket = np.zeros(len(read["ids"]), np.int64)
                occupied = np.zeros(len(bucket), bool)
                for mine, (term, times) in zip(best, asked):
                    bucket[:] = 0
                    occupied[:] = False
                    for t, n in zip(term.tolist(), times.tolist()):
                        if df[t]:
                            own = slice(ends[t] - df[t], ends[t])
                            # a document has one slot in a list, so no addition is lost
                            bucket[read["slots"][own]] += n * gain[own]
                            occupied[read["slots"][own]] = True
                    at = np.flatnonzero(occupied)
                    at = at[bucket[at] > 0]
                    mine.harvest(bucket[at], read["ids"][at], read["named"][at])
        rows = [(q, -i if name else None, s) for q, b in enumerate(best) for s, name, i in b.heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        release()

    return index.mapInArrow(score, FOUND)


def _block(docs: DataFrame, asked: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """Ranks of the documents for one block of queries ``item_id, text``, which is small enough for the driver."""
    spark = docs.sparkSession
    items = asked.orderBy("item_id", "text").toArrow().to_pylist()
    found = [terms(r["text"]) for r in items]
    vocabulary = {t: i for i, t in enumerate(sorted({t for ts in found for t in ts}))}
    queries = [np.unique(np.array([vocabulary[t] for t in ts], np.int64), return_counts=True) for ts in found]
    index = written(index_windows(docs, vocabulary, id_col, text_col), "windows")
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in index.select(F.posexplode("df").alias("t", "n")).filter("n > 0").groupBy("t").agg(F.sum("n").alias("n")).toLocalIterator():
        df[r.t] = r.n
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    scored = _scored(index, queries, weight, n_docs, n_terms, k)
    names = spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(items)], "query int, item_id long")
    # a row with a null id comes after those of its score
    order = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return written(ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"), "ranked")


def search(
    docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``k`` highest-scoring documents of every query: ``item_id, rank, doc_id, score``.

    Terms are runs of digits, letters and all characters beyond ASCII, A-Z
    lower-cased, over whole texts; repeats in a query count.  Weights and length
    norms are of all documents; scores are 64-bit integers.  Equal scores are
    ranked by ascending id, a null id last; rows that share an id are ranked each.
    Documents without a term, null and empty texts among them, are in no
    statistic and no result.  Only scores above 0 are returned, fewer than ``k``
    where there are no more.  Equal rows of ``queries`` are one; differing texts
    under one id are ranked each; a query without a term gives no row, nor does
    an empty table.  Other columns are ignored, whatever their names.
    """
    asked = queries.select(F.col(query_id).cast("long").alias("item_id"), F.coalesce(F.col(query_text), F.lit("")).alias("text")).distinct()
    asked = written(asked, "queries")
    size = asked.agg(F.sum(F.octet_length("text") + 8).alias("n")).first().n or 0
    blocks = max(1, math.ceil(size / block_bytes))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    found = [_block(docs, dealt.filter(F.col("block") == b).drop("block"), k, id_col, text_col) for b in range(blocks)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def search_sql(k: int = 10) -> str:
    """The same over tables ``documents`` and ``benchmark`` as DuckDB SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    split = f"unnest(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
    return f"""
WITH words AS (SELECT row, doc_id, {split} AS term FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)),
tf AS (SELECT row, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY row),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), whole),
asked AS (SELECT item_id, text, term, count(*) AS times FROM (SELECT item_id, text, {split} AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
scores AS (
  SELECT a.item_id, a.text, t.row, t.doc_id,
         CAST(sum(a.times * w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (100 - 75 + (75 * s.n * docs) // terms)))) AS BIGINT) AS score
  FROM asked a JOIN tf t USING (term) JOIN weights w USING (term) JOIN sizes s USING (row), whole
  GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scores WHERE score > 0)
WHERE rank <= {k}"""
