"""Shared plumbing: code shipping, written intermediates, text batches, graph components."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prismal import session
from prismal.session import release  # noqa: F401

_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()

#: Bytes of an Arrow batch at most: Spark's default of 64 MB stands in memory in several copies.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per SparkContext, and bound the session's Arrow batches."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int("".join(c for c in spark.conf.get(key) if c.isdigit()))
    if now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    session.ship(spark)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder; where none is named, a local one, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), "prismal-shared")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _paths.setdefault(spark.sparkContext, []).append(path)
    return path


def discard_scratch(spark: SparkSession) -> int:
    """Delete what this session has written to the shared folder, once its results are stored; returns the number of paths."""
    hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    paths = _paths.pop(spark.sparkContext, [])
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(hadoop).delete(where, True)
    return len(paths)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    A lost executor then costs a re-read, not a recomputation.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Ids up to which a set of them is broadcast (8 bytes each); beyond, the rows are shuffled.
BROADCAST_IDS = 1_000_000


def without_ids(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id is not among ``ids`` (one column of the same name); rows with a null id stay.

    The ids are written first, so their number is known before the join is
    planned: rows with whole texts move only where the ids are too many to send.
    """
    ids = written(ids.select(id_col).distinct(), "ids")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return rows.join(side, id_col, "left_anti").select(rows.columns)


#: Rows of one key beyond which they are joined without a shuffle.
HOT_ROWS = 100_000


def join_split(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """Inner join with ``side``, one row a key with the key's number of ``rows`` as ``n``; ``n`` is dropped.

    Keys of more than ``HOT_ROWS`` rows are broadcast, one for each so many rows
    at most, so no task gathers them; ``side`` should be a written table.
    """
    hot = side.filter(F.col("n") > HOT_ROWS).drop("n")
    if not hot.limit(1).count():
        return rows.join(side.drop("n"), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(side.drop("n"), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def ranked(df: DataFrame, key: str) -> DataFrame:
    """Add ``rank``, the place from 0 of each row by ``key``, of which no two rows have the same; a null comes first.

    Rows are cut into ranges, ordered within, and counted before, so no task orders all.
    """
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    cut = written(df.repartitionByRange(int(parts), key).withColumn("_part", F.spark_partition_id()), "ranges")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = cut.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(F.col(key).asc_nulls_first())) - 1
    return cut.withColumn("rank", inside).join(F.broadcast(starts), "_part").select(*df.columns, (F.col("rank") + F.col("_start")).alias("rank"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_rows(
    df: DataFrame,
    fn: Callable[[list[list]], dict[str, list]],
    schema: str,
    max_bytes: int = 8 << 20,
    done: Callable[[], None] | None = None,
) -> DataFrame:
    """Apply ``fn`` to column lists of consecutive rows, at most ``max_bytes`` of Arrow data at once.

    ``fn`` gets one list per column of ``df`` and returns a dict of output
    columns.  One row larger than the bound is passed alone, whole.  ``done``
    is called at a task's end, to let go of what the worker keeps.
    """
    ship(df.sparkSession)
    out_schema = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, max_bytes):
                out = fn([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in out_schema], schema=out_schema)
        if done:
            done()
        release()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch of at most ``max_bytes`` each, or one row."""
    n = batch.num_rows
    if not n:
        return
    if batch.nbytes <= max_bytes or n == 1:
        yield batch
        return
    half = n // 2
    # nbytes of a slice counts only the sliced buffers
    yield from slices(batch.slice(0, half), max_bytes)
    yield from slices(batch.slice(half), max_bytes)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Component root (smallest id) of every node that has an edge: columns ``node``, ``root``.

    Alternating large-star and small-star rounds over edge tables written to
    the shared folder; nothing but two counters per round reaches the driver.
    Self links and repeated links are ignored; null ends are dropped.
    """
    u, v = F.col("u"), F.col("v")

    def tidy(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(u != v).distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)).first())

    e = written(tidy(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()), "links")
    before = state(e)
    while before[0]:
        both = e.unionByName(e.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(v > u).join(low, "u").select(v.alias("u"), F.col("m").alias("v")).filter(u != v).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").filter(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        e = written(tidy(small.unionByName(low2.select("u", F.col("m").alias("v")))), "links")
        now = state(e)
        if now == before:
            break
        before = now
    return e.select(u.alias("node"), v.alias("root")).unionByName(e.select(v.alias("node"), v.alias("root")).distinct())
