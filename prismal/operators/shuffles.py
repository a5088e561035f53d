"""Label shuffles of whole groups as a function, so that no table of rows times shuffles exists.

Groups of a stratum have places 0 to n - 1.  Shuffle ``p`` maps a place to
another by a keyed bijection (a Feistel network on two numbers whose product
covers n, walked until it lands below n), and a group gets label 1 where the
place lies below the number of groups with label 1.  A task that holds a group's
place, n and that number makes its labels of all shuffles by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismal.operators import metrics as M
from prismal.operators import resample as R
from prismal.session import settled, ship

#: A Mersenne prime: squares of residues fit 64 bits.
PRIME = (1 << 31) - 1
ROUNDS = 6
#: Labels that a task makes at once; making them takes some twenty times their number in bytes of 8.
CHUNK = 200_000
#: Labels that a task makes in all.
TASK = 20_000_000
PLACE = ("pos", "n", "ones", "z")


def _keys(perms: np.ndarray, seed: int, turn: int, z: np.ndarray) -> np.ndarray:
    k = (perms * 69069 + (turn + 1) * 362437 + seed * 521288629 + z) % PRIME
    return (k * k + 1) % PRIME


def shuffled(pos: np.ndarray, n: np.ndarray, perms: np.ndarray, seed: int, z: np.ndarray | int = 0) -> np.ndarray:
    """Place of every group (rows) in every shuffle (columns): a bijection of 0 to n - 1 for each shuffle."""
    n = np.broadcast_to(np.asarray(n, np.int64), pos.shape)[:, None]
    z = np.broadcast_to(np.asarray(z, np.int64), pos.shape)[:, None]
    a = np.ceil(np.sqrt(n)).astype(np.int64)
    b = -(-n // a)
    keys = [_keys(perms[None, :].astype(np.int64), seed, t, z) for t in range(ROUNDS)]

    def once(x: np.ndarray, at: tuple | slice) -> np.ndarray:
        aa, bb = (np.broadcast_to(v, keys[0].shape)[at] for v in (a, b))
        left, right = x // bb, x % bb
        for t, k in enumerate(keys):
            k = k[at]
            f = ((right if t % 2 == 0 else left) + k) % PRIME
            f = (f * f % PRIME + k) % PRIME
            f = f * f % PRIME
            if t % 2 == 0:
                left = (left + f) % aa
            else:
                right = (right + f) % bb
        return left * bb + right

    out = once(np.broadcast_to(pos[:, None].astype(np.int64), keys[0].shape), (slice(None), slice(None)))
    while True:
        away = np.nonzero(out >= n)
        if not len(away[0]):
            return out
        out[away] = once(out[away], away)


def labels_of(pos: np.ndarray, n: np.ndarray, ones: np.ndarray, z: np.ndarray, perms: np.ndarray, seed: int) -> np.ndarray:
    """0/1 labels, rows by shuffles; made by stretches of rows, so that only the labels themselves grow with both."""
    out = np.empty((len(pos), len(perms)), bool)
    step = max(1, CHUNK // max(1, len(perms)))
    for at in range(0, len(pos), step):
        part = slice(at, at + step)
        out[part] = shuffled(pos[part], n[part], perms, seed, z[part]) < ones[part, None]
    return out


def label_bits(placed: DataFrame, group: str, first: int, last: int, seed: int) -> DataFrame:
    """``<group>, bits``: a group's labels in the shuffles ``first`` to ``last - 1``, -1 being the true ones, eight to a byte.

    Labels are made once a group, and ``unpacked`` where rows are read.
    """
    ship(placed.sparkSession)
    perms = np.arange(max(0, first), last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CHUNK // max(1, last - first))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                y, pos, n, ones, z = (c.to_numpy(zero_copy_only=False) for c in part.columns[1:])
                drawn = labels_of(pos, n, ones, z, perms, seed)
                bits = np.packbits(np.column_stack([y > 0, drawn]) if first < 0 else drawn, axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([b.tobytes() for b in bits], pa.binary())], [group, "bits"])

    rows = placed.select(group, "y", *PLACE)
    return rows.mapInArrow(run, T.StructType([T.StructField(group, rows.schema[group].dataType), T.StructField("bits", T.BinaryType())]))


def packed(bits: pa.Array, n: int) -> np.ndarray:
    """Bytes of ``bits``, a row each, that hold ``n`` labels."""
    return np.frombuffer(b"".join(bits.to_pylist()), np.uint8).reshape(len(bits), -(-n // 8))


def places(df: DataFrame, group: str, label: str, strata: str | None = None) -> DataFrame:
    """``<group>, y, pos, n, ones, z``: the place of every group in its stratum, the stratum's groups, those with label 1, and its key.

    A label that varies within a group raises when the result is read.  Rows
    whose group or label is null are left out; a null stratum is one of its own.
    """
    s = F.col(strata) if strata else F.lit(None).cast("string")
    rows = df.filter(F.col(group).isNotNull() & F.col(label).isNotNull())
    y = F.col(label).cast("int")
    g = rows.groupBy(group).agg(F.min(y).alias("_l"), F.max(y).alias("_h"), F.first(s.cast("string"), True).alias("_s"))
    fixed = F.when(F.col("_l") == F.col("_h"), F.col("_l")).otherwise(F.raise_error(F.lit("a label varies within a group")).cast("int"))
    g = g.select(group, fixed.alias("y"), "_s")
    order = F.shiftleft(F.conv(F.substring(F.md5(F.col(group).cast("string")), 1, 15), 16, 10).cast("long"), 3)
    z = F.when(F.col("_s").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("_s"), F.lit(PRIME)))
    sizes = g.groupBy(F.col("_s").alias("_t")).agg(F.count("*").alias("n"), F.sum("y").alias("ones"))
    placed = R.numbered(g, ["_s"], order, group, "pos").join(sizes, F.col("_s").eqNullSafe(F.col("_t")))
    return placed.select(group, "y", (F.col("pos") - 1).cast("long").alias("pos"), F.col("n").cast("long").alias("n"), F.col("ones").cast("long").alias("ones"), z.cast("long").alias("z"))


def doubled_ranks(df: DataFrame, score: str, keep: list[str]) -> DataFrame:
    """``*keep, ranks, rows``: twice the sum of the mid-ranks of a key's rows, whole numbers, and how many they are; null and NaN scores are left out."""
    rows = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    levels = rows.groupBy(F.col(score).alias("_s")).agg(F.count("*").cast("double").alias("p"), F.lit(0.0).alias("n"))
    levels = M._running(levels, [], {"below": "p"}, before=True).select(F.col("_s").alias("_level"), (2 * F.col("below") + F.col("p") + 1).alias("_rank"))
    each = rows.groupBy(*keep, F.col(score).alias("_level")).agg(F.count("*").alias("rows"))
    return each.join(levels, "_level").groupBy(*keep).agg(F.sum(F.col("_rank") * F.col("rows")).alias("ranks"), F.sum("rows").alias("rows"))


def null_areas(df: DataFrame, group: str, label: str, score: str, n_perm: int = 1000, strata: str | None = None, seed: int = 0) -> DataFrame:
    """``perm, auroc`` of fixed scores under shuffled labels; ``perm`` -1 has the true ones.

    Mid-ranks do not change when labels are shuffled, so an area is a sum over
    groups: rows are ranked once, a task adds up a vector of ``n_perm`` sums, and
    what is shuffled is one such vector a task, whatever the number of rows.
    """
    ship(df.sparkSession)
    rows = df.filter(F.col(label).isNotNull())
    groups = doubled_ranks(rows, score, [group]).join(places(rows, group, label, strata), group).select("y", *PLACE, "ranks", "rows")
    groups = settled(groups, "groups")
    # rows are small and their shuffles many: tasks by labels, not by bytes
    groups = groups.repartition(max(1, -(-groups.count() * (n_perm + 1) // TASK)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perms = np.arange(n_perm)
        total = np.zeros((4, n_perm + 1))
        for batch in batches:
            step = max(1, CHUNK // max(1, n_perm))
            for at in range(0, batch.num_rows, step):
                y, pos, n, ones, z, ranks, size = (c.to_numpy(zero_copy_only=False) for c in batch.slice(at, step).columns)
                on = np.column_stack([y > 0, labels_of(pos, n, ones, z, perms, seed)]).astype(float)
                total[0] += ranks @ on
                total[1] += size @ on
                total[2] += size.sum()
        yield pa.RecordBatch.from_arrays([pa.array([0, 1, 2], pa.int32()), pa.array([list(v) for v in total[:3]], pa.list_(pa.float64()))], ["what", "v"])

    sums = groups.mapInArrow(add, "what int, v array<double>").groupBy("what").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    one = sums.agg(*(F.max(F.when(F.col("what") == i, F.col("v"))).alias(c) for i, c in enumerate(("r", "p", "all"))))
    each = one.select(F.explode(F.arrays_zip("r", "p", "all", F.sequence(F.lit(-1), F.lit(n_perm - 1)).alias("perm"))).alias("s")).select("s.*")
    n1, n0 = F.col("p"), F.col("all") - F.col("p")
    return each.select("perm", F.try_divide(F.col("r") / 2 - n1 * (n1 + 1) / 2, n1 * n0).alias("auroc"))


def against_null(areas: DataFrame) -> DataFrame:
    """``auroc, p, null_mean, n_perm`` of ``perm, auroc``, the true one under -1; areas that are null are no draws."""
    real = F.max(F.when(F.col("perm") < 0, F.col("auroc")))
    one = areas.agg(real.alias("auroc"), F.array_sort(F.collect_list(F.when(F.col("perm") >= 0, F.col("auroc")))).alias("null"))
    n, above = F.size("null"), F.size(F.filter("null", lambda a: a >= F.col("auroc") - 1e-12))
    mean = F.try_divide(F.aggregate("null", F.lit(0.0), lambda s, x: s + x), n)
    return one.select("auroc", ((1 + above) / (1 + n)).alias("p"), mean.alias("null_mean"), n.alias("n_perm"))


def null_areas_sql(rows: str, n_perm: int, seed: int, walks: int = 12) -> str:
    """``null_areas`` without strata as DuckDB SQL over a query of ``grp, y, score``, a row a group."""
    square = lambda x: f"(({x}) * ({x}))"

    def turn(x: str) -> str:
        """One application of the network to column ``x`` as a chain of selects."""
        steps = f"SELECT *, {x} // b AS l0, {x} % b AS r0 FROM src"
        for t in range(ROUNDS):
            key = f"(({square(f'(perm * 69069 + {(t + 1) * 362437} + {seed * 521288629}) % {PRIME}')} + 1) % {PRIME})"
            half = f"r{t}" if t % 2 == 0 else f"l{t}"
            steps = f"SELECT *, {key} AS k{t} FROM ({steps})"
            steps = f"SELECT *, {square(f'({half} + k{t}) % {PRIME}')} % {PRIME} AS f{t} FROM ({steps})"
            steps = f"SELECT *, {square(f'(f{t} + k{t}) % {PRIME}')} % {PRIME} AS g{t} FROM ({steps})"
            l, r = (f"(l{t} + g{t}) % a", f"r{t}") if t % 2 == 0 else (f"l{t}", f"(r{t} + g{t}) % b")
            steps = f"SELECT *, {l} AS l{t + 1}, {r} AS r{t + 1} FROM ({steps})"
        return f"SELECT perm, grp, n, ones, a, b, rk, l{ROUNDS} * b + r{ROUNDS} AS x FROM ({steps})"

    walk = []
    for w in range(1, walks):
        walk.append(f"w{w} AS (SELECT * FROM w{w - 1} WHERE x < n UNION ALL ({turn('x').replace('FROM src', f'FROM w{w - 1} WHERE x >= n')}))")
    return f"""
WITH data AS ({rows}),
g AS (SELECT grp, y, row_number() OVER (ORDER BY substr(md5(CAST(grp AS VARCHAR)), 1, 15), grp) - 1 AS pos, count(*) OVER () AS n, sum(y) OVER () AS ones,
             rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM data),
src AS (SELECT perm, grp, pos AS x, n, CAST(ones AS BIGINT) AS ones, rk, CAST(ceil(sqrt(n)) AS BIGINT) AS a, CAST(ceil(n / ceil(sqrt(n))) AS BIGINT) AS b FROM g, range({n_perm}) r(perm)),
w0 AS ({turn('x')}),
{", ".join(walk)},
drawn AS (SELECT perm, CAST(x < ones AS INTEGER) AS y, rk FROM w{walks - 1} UNION ALL SELECT -1, y, rk FROM g),
areas AS (SELECT perm, (sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auroc FROM drawn GROUP BY perm)
SELECT perm, auroc FROM areas"""
