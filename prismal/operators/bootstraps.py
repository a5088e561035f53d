"""Grouped bootstrap of ranking areas without a table of rows times replicates.

Rows are counted by score and group, put in score order over ranges, and every
task weighs its stretch by all replicates at once: how often a replicate draws a
group is a function of seed, replicate and draw, so a task makes those numbers by
itself.  What is shuffled besides the counts is three numbers a replicate and stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prismal.operators import metrics as M
from prismal.operators import resample as R
from prismal.session import settled, ship

#: Weights that a task holds at once.
CHUNK = 4_000_000
#: Levels of a stretch, and groups of which a task makes all draws by itself; of more groups, replicates are a table.
LEVELS, GROUPS = 500_000, 1_000_000


def multiplicities(n: int, reps: np.ndarray, seed: int) -> np.ndarray:
    """How often each replicate (rows) draws each of ``n`` groups (columns)."""
    at = R.drawn(reps.astype(np.int64)[:, None], np.arange(n, dtype=np.int64)[None, :], n, seed)
    return np.bincount((at + np.arange(len(reps))[:, None] * n).ravel(), minlength=len(reps) * n).reshape(len(reps), n)


def _firsts(columns: list[pa.ChunkedArray], size: int) -> np.ndarray:
    """Where any of the columns differs from the row before; a null equals a null."""
    new = np.zeros(size, bool)
    new[:1] = True
    for c in columns:
        code = pc.dictionary_encode(c.combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return new


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _stretches(levels: DataFrame, by: list[str], n: int, n_boot: int, seed: int) -> DataFrame:
    """``*by, at, first, p, n, u`` of ``*by, _s, pos, p, n`` in order: a stretch's lowest score, its first replicate, and weights of positives, negatives and won pairs by replicate."""
    fields = [f for f in levels.schema.fields if f.name in by]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "_at double, _first int, _p array<double>, _n array<double>, _u array<double>"])
    names = [f.name for f in fields]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if x.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        s, pos, p, q = (t.column(c).to_numpy() for c in ("_s", "pos", "p", "n"))
        key = _firsts([t.column(c) for c in names], len(s))
        level = key.copy()
        level[1:] |= s[1:] != s[:-1]
        level_at, key_at = np.nonzero(level)[0], np.nonzero(key)[0]
        # levels of a key are next to each other
        first = np.searchsorted(level_at, key_at)
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(level_at))))
        head = [t.column(c).take(pa.array(key_at)).combine_chunks() for c in names]
        step = max(1, CHUNK // max(len(s), n))
        for r in range(0, n_boot, step):
            w = multiplicities(n, np.arange(r, min(n_boot, r + step)), seed).T[pos].astype(float)
            wp, wn = (np.add.reduceat(x[:, None] * w, level_at, axis=0) for x in (p, q))
            below = np.cumsum(wn, axis=0) - wn
            below -= below[first][of]
            sums = [np.add.reduceat(x, first, axis=0) for x in (wp, wn, wp * (below + wn / 2))]
            yield pa.RecordBatch.from_arrays(
                [*head, pa.array(s[key_at]), pa.array(np.full(len(first), r, np.int32)), *(_lists(x) for x in sums)], [*names, "_at", "_first", "_p", "_n", "_u"])

    return levels.select(*names, "_s", "pos", "p", "n").mapInArrow(weigh, schema)


def area_replicates(df: DataFrame, group: str, label: str, score: str, n_boot: int = 1000, seed: int = 0, by=None) -> DataFrame:
    """``*by, rep, auroc`` of ``n_boot`` resamples of the groups, the same ones for every key; null where a resample has one class only.

    Scores are doubles, ties count half.  Rows whose group, label or score is
    null, or whose score is NaN, are left out; a null in ``by`` is a key.  Groups
    are those of all rows, whatever their labels.  Repeated rows count as often as
    they come; an empty table gives no row.
    """
    by = [by] if isinstance(by, str) else list(by or [])
    ship(df.sparkSession)
    place = settled(R.places(df, group), "places")
    n = place.count()
    s, y = F.col(score).cast("double"), F.col(label).cast("double") >= 0.5
    rows = df.filter(F.col(group).isNotNull() & F.col(label).isNotNull() & s.isNotNull() & ~F.isnan(s))
    # -0.0 and 0.0 are one score
    levels = rows.groupBy(*by, group, (s + F.lit(0.0)).alias("_s")).agg(F.count_if(y).cast("double").alias("p"), F.count_if(~y).cast("double").alias("n"))
    if n > GROUPS:
        side = levels.join(R.replicates(df, group, n_boot, seed), group)
        each = F.array(*(F.struct(F.lit(float(v)).alias("y"), (F.col(c) * F.col("mult")).alias("w")) for v, c in ((1, "p"), (0, "n"))))
        rows = side.select(*by, "rep", "_s", F.explode(each).alias("e")).select(*by, "rep", F.col("_s").alias("_score"), "e.y", "e.w").filter("w > 0")
        return M.auroc(rows, "y", "_score", [*by, "rep"], "w").select(*by, "rep", "auroc")
    levels = settled(levels.join(place, group).select(*by, "_s", "pos", "p", "n"), "levels")
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-levels.count() // LEVELS))
    cut = levels.repartitionByRange(parts, *by, "_s").sortWithinPartitions(*by, "_s")
    each = _stretches(cut, by, n, n_boot, seed).select(*by, "_at", "_first", F.posexplode(F.arrays_zip("_p", "_n", "_u")).alias("_i", "_z"))
    each = each.select(*by, "_at", (F.col("_first") + F.col("_i")).alias("rep"), "_z.*")
    ahead = W.partitionBy(*by, "rep").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    each = each.withColumn("_u", F.col("_u") + F.col("_p") * F.coalesce(F.sum("_n").over(ahead), F.lit(0.0)))
    sums = each.groupBy(*by, "rep").agg(*(F.sum(c).alias(c) for c in ("_p", "_n", "_u")))
    return sums.select(*by, "rep", F.try_divide("_u", F.col("_p") * F.col("_n")).alias("auroc"))


def area_interval(df: DataFrame, group: str, label: str, score: str, n_boot: int = 1000, seed: int = 0, alpha: float = 0.05, by=None) -> DataFrame:
    """Percentile interval of the area over resampled groups: ``*by, lo, hi, n_ok``."""
    return R.interval(area_replicates(df, group, label, score, n_boot, seed, by), "auroc", n_boot, alpha, by)


def area_interval_sql(rows: str, n_boot: int, seed: int, alpha: float = 0.05) -> str:
    """``area_interval`` of one key as DuckDB SQL over a query of ``grp, y, score``; at least max(10, n_boot / 10) areas taken for granted."""
    return f"""
WITH data AS ({rows}),
g AS (SELECT grp, row_number() OVER (ORDER BY substr(md5(CAST(grp AS VARCHAR)), 1, 15), grp) - 1 AS place, count(*) OVER () AS n_groups FROM (SELECT DISTINCT grp FROM data WHERE grp IS NOT NULL)),
tries AS (SELECT rep, place AS draw, n_groups FROM g, range({n_boot}) r(rep)),
picks AS (SELECT rep, {", ".join(R.drawn_sql("n_groups", seed))} FROM tries),
mult AS (SELECT rep, pos, count(*) AS mult FROM picks GROUP BY rep, pos),
lv AS (SELECT rep, score, sum(CASE WHEN y >= 0.5 THEN mult ELSE 0 END) AS p, sum(CASE WHEN y >= 0.5 THEN 0 ELSE mult END) AS n
       FROM data JOIN g USING (grp) JOIN mult ON pos = place WHERE y IS NOT NULL AND score IS NOT NULL GROUP BY rep, score),
won AS (SELECT rep, p, n, p * (sum(n) OVER (PARTITION BY rep ORDER BY score) - n / 2) AS u FROM lv),
areas AS (SELECT rep, sum(u) / nullif(sum(p) * sum(n), 0) AS auroc FROM won GROUP BY rep)
SELECT quantile_cont(auroc, {alpha / 2}) AS lo, quantile_cont(auroc, {1 - alpha / 2}) AS hi, count(auroc) AS n_ok FROM areas"""
