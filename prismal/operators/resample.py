"""Grouped bootstrap, permutation, folds and splits.

Replicates are tables: a group's multiplicity or shuffled label is a function of
the seed, the replicate and the group, drawn on executors, so that a rerun gives
the same table at any cluster size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prismal.session import settled


def draw(*parts, seed: int = 0) -> Column:
    """A uniform number in [0, 1) that depends on the parts and the seed only."""
    return F.pmod(F.xxhash64(*parts, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


#: A Mersenne prime: squares of residues fit 64 bits.
PRIME = (1 << 31) - 1


def drawn(rep, draw, n, seed: int = 0):
    """Place below ``n`` that draw number ``draw`` of replicate ``rep`` takes; for whole numbers, arrays and columns alike."""
    for turn in (1, 2):
        key = (rep * 69069 + turn * 362437 + seed * 521288629) % PRIME
        key = (key * key + 1) % PRIME
        draw = (draw + key) % PRIME
        draw = (draw * draw + key) % PRIME
        draw = (draw * draw + key) % PRIME
    return draw % n


def drawn_sql(n: str, seed: int) -> list[str]:
    """``drawn`` of columns ``rep`` and ``draw`` as DuckDB select items, each reading those before; the last is ``pos``."""
    items, last = [], "draw"
    for turn in (1, 2):
        first = f"((rep * 69069 + {turn * 362437 + seed * 521288629}) % {PRIME})"
        items += [f"({first} * {first} + 1) % {PRIME} AS k{turn}", f"({last} + k{turn}) % {PRIME} AS a{turn}"]
        items += [f"(a{turn} * a{turn} + k{turn}) % {PRIME} AS b{turn}", f"(b{turn} * b{turn} + k{turn}) % {PRIME} AS c{turn}"]
        last = f"c{turn}"
    return [*items, f"{last} % {n} AS pos"]


def places(df: DataFrame, group: str) -> DataFrame:
    """``<group>, pos``: distinct groups, null left out, numbered from 0 in the order of their digests."""
    g = df.select(group).filter(F.col(group).isNotNull()).distinct().withColumn("_z", F.lit(0))
    order = F.shiftleft(F.conv(F.substring(F.md5(F.col(group).cast("string")), 1, 15), 16, 10).cast("long"), 3)
    return numbered(g, ["_z"], order, group, "pos").select(group, (F.col("pos") - 1).cast("long").alias("pos"))


def replicates(groups: DataFrame, group: str, n_boot: int, seed: int = 0) -> DataFrame:
    """``rep, <group>, mult``: resamples of the groups with replacement; groups not drawn are left out.

    Every replicate draws as many groups as there are, each draw a place in the
    groups' order.  A null group is no group.  The table has a row a replicate and drawn group.
    """
    place = settled(places(groups, group), "places")
    n = place.count()
    reps = place.sparkSession.range(n_boot).withColumnRenamed("id", "rep")
    draws = reps.crossJoin(place.select(F.col("pos").alias("_draw")))
    picked = draws.withColumn("pos", drawn(F.col("rep"), F.col("_draw"), F.lit(max(1, n)).cast("long"), seed)).groupBy("rep", "pos").agg(F.count("*").alias("mult"))
    return picked.join(place, "pos").select(F.col("rep").cast("int").alias("rep"), group, "mult")


def interval(found: DataFrame, value: str, n_boot: int, alpha: float = 0.05, by=None) -> DataFrame:
    """Percentile interval over replicates: ``*by, lo, hi, n_ok``; null bounds unless max(10, n_boot / 10) give a number."""
    by = [by] if isinstance(by, str) else list(by or [])
    found = found.filter(F.col(value).isNotNull() & ~F.isnan(value))
    agg = (F.percentile(value, F.lit(alpha / 2)).alias("lo"), F.percentile(value, F.lit(1 - alpha / 2)).alias("hi"), F.count("*").alias("n_ok"))
    out = found.groupBy(*by).agg(*agg) if by else found.agg(*agg)
    enough = F.col("n_ok") >= max(10, n_boot / 10)
    return out.select(*by, F.when(enough, F.col("lo")).alias("lo"), F.when(enough, F.col("hi")).alias("hi"), "n_ok")


def bootstrap_ci(
    df: DataFrame, group: str, metric: Callable[[DataFrame, list[str], str], DataFrame], value: str, n_boot: int = 1000, seed: int = 0, alpha: float = 0.05, by=None
) -> DataFrame:
    """Percentile interval of a metric over resampled groups: ``*by, lo, hi, n_ok``.

    ``metric(df, by, weight)`` gives a column ``value`` for each key.  Every row
    meets its group's replicates: give it rows that are counts by group.  For areas
    ``operators.bootstraps`` makes no such table.
    """
    by = [by] if isinstance(by, str) else list(by or [])
    rows = df.join(replicates(df, group, n_boot, seed), group)
    return interval(metric(rows, [*by, "rep"], "mult"), value, n_boot, alpha, by)


def paired_difference_ci(df: DataFrame, group: str, metric, value: str, method: str, first: str, second: str, n_boot: int = 1000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Interval of ``first`` minus ``second`` with the same groups drawn for both: ``diff, lo, hi, n_ok``."""
    pick = lambda t: F.max(F.when(F.col(method) == t, F.col(value)))
    here = metric(df.withColumn("_w", F.lit(1)), [method], "_w").agg((pick(first) - pick(second)).alias("diff"))
    rows = df.join(replicates(df, group, n_boot, seed), group)
    gaps = metric(rows, [method, "rep"], "mult").groupBy("rep").agg((pick(first) - pick(second)).alias("d")).filter("d is not null")
    ci = gaps.agg(F.percentile("d", F.lit(alpha / 2)).alias("lo"), F.percentile("d", F.lit(1 - alpha / 2)).alias("hi"), F.count("*").alias("n_ok"))
    return here.crossJoin(ci)


def numbered(df: DataFrame, by: list[str], order: Column, then: str, name: str) -> DataFrame:
    """Add ``name``: each row's number from 1 within ``by``, in the order of a 64-bit hash, then of a column.

    Rows are numbered in 256 cells of the hash's high bits and by the cells' sizes, so no task orders a whole key.
    """
    rows = df.withColumn("_h", order).withColumn("_cell", F.shiftright("_h", 56))
    sizes = rows.groupBy(*by, "_cell").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*by).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_cell").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_in", F.row_number().over(W.partitionBy(*by, "_cell").orderBy("_h", then)))
    same = F.col("_cell") == F.col("_at")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return rows.join(sizes, same).select(*df.columns, (F.col("_before") + F.col("_in")).alias(name))


def permutations(df: DataFrame, group: str, label: str, n_perm: int, strata: str | None = None, seed: int = 0) -> DataFrame:
    """``perm, <group>, <label>``: labels of whole groups shuffled within strata.

    A label that varies within a group raises when the result is read.  Groups
    in the order of a hash of the permutation are matched with the labels in the
    order of a hash of their own.
    """
    s = F.col(strata) if strata else F.lit(0)
    g = df.groupBy(group).agg(F.first(s).alias("_s"), F.min(label).alias("_l"), F.max(label).alias("_h"))
    same = F.when(F.col("_l").eqNullSafe(F.col("_h")), F.col("_l")).otherwise(F.raise_error(F.lit("a label varies within a group")).cast(df.schema[label].dataType))
    g = g.select(group, "_s", same.alias(label))
    own = numbered(g, ["_s"], F.xxhash64(group, F.lit(seed)), group, "_k").select(F.col("_s").alias("_own"), F.col("_k").alias("_place"), label)
    perms = df.sparkSession.range(n_perm).select(F.col("id").cast("int").alias("perm"))
    shuffled = numbered(perms.crossJoin(g.select(group, "_s")), ["perm", "_s"], F.xxhash64(group, "perm", F.lit(seed)), group, "_k")
    return shuffled.join(own, F.col("_s").eqNullSafe(F.col("_own")) & (F.col("_k") == F.col("_place"))).select("perm", group, label)


def p_value(null: DataFrame, value: str, real: float, by=None) -> DataFrame:
    """(1 + nulls not below the real value) / (1 + nulls), with a slack of 1e-12."""
    by = [by] if isinstance(by, str) else list(by or [])
    agg = ((1 + F.sum((F.col(value) >= real - 1e-12).cast("int"))) / (1 + F.count(value))).alias("p")
    return null.groupBy(*by).agg(agg) if by else null.agg(agg)


def group_folds(df: DataFrame, group: str, label: str, k: int = 5, seed: int = 0) -> DataFrame:
    """``<group>, fold``: groups of each label dealt to folds in a shuffled order; no row if a label has fewer than two groups.

    A group with several labels counts under its smallest.
    """
    g = df.groupBy(group).agg(F.min(label).alias("_y"))
    sizes = g.groupBy("_y").count()
    least = sizes.agg(F.min("count").alias("m"), F.count("*").alias("c"))
    placed = numbered(g, ["_y"], F.xxhash64(group, F.lit(seed)), group, "_r").withColumn("_r", F.col("_r") - 1)
    dealt = placed.crossJoin(F.broadcast(least)).filter((F.col("m") >= 2) & (F.col("c") >= 2))
    return dealt.select(group, F.pmod(F.col("_r"), F.least(F.col("m"), F.lit(k))).cast("int").alias("fold"))


def group_split(df: DataFrame, group: str, label: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """``<group>, split``: of each label's groups round(share) go to test, at least one and not all; a lone group trains.

    A null label is a stratum of its own; a group under two labels goes by its last in their order.
    """
    g = df.groupBy(group).agg(F.max(label).alias("_y"))
    sizes = g.groupBy(F.col("_y").alias("_z")).agg(F.count("*").alias("_n"))
    g = numbered(g, ["_y"], F.xxhash64(group, F.lit(seed)), group, "_r").join(sizes, F.col("_y").eqNullSafe(F.col("_z")))
    n_test = F.when(F.col("_n") < 2, 0).otherwise(F.least(F.greatest(F.rint(F.col("_n") * test_share), F.lit(1)), F.col("_n") - 1))
    return g.select(group, F.when(F.col("_r") <= n_test, "test").otherwise("train").alias("split"))


def in_order(df: DataFrame, by: str, key: str, name: str) -> DataFrame:
    """Add ``name``: each row's number from 1 within ``by``, in the order of ``key``, a null first.

    Rows are cut into ranges of both, counted, and numbered within a range, so no task orders a whole key.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = settled(df.repartitionByRange(n, by, key).withColumn("_part", F.spark_partition_id()), "ranges")
    before = W.partitionBy(by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = cut.groupBy(by, "_part").agg(F.count("*").alias("_n")).select(by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy(by, "_part").orderBy(F.col(key).asc_nulls_first()))
    return cut.withColumn("_in", inside).join(starts, [by, "_part"]).select(*df.columns, (F.col("_start") + F.col("_in")).alias(name))


def set_split(df: DataFrame, key: str, test_share: float = 0.2) -> DataFrame:
    """``<key>, split``: whole sets by falling size fill train to its share; a smaller later set may still fit.

    Sets of one size are alike, and the first by key are taken, so the greedy
    choice runs over the distinct sizes, of which there are at most the square
    root of twice the rows; keys stay on executors.
    """
    sets = df.groupBy(key).agg(F.count("*").alias("_size"))
    counts = sets.groupBy("_size").agg(F.count("*").alias("n")).orderBy(F.desc("_size")).collect()
    room, fits = (1 - test_share) * sum(r["_size"] * r.n for r in counts), []
    for r in counts:
        # sizes are taken off one by one, as a fill set by set would round
        taken = 0
        while taken < r.n and r["_size"] <= room:
            step = max(1, min(r.n - taken, int(room // r["_size"]) - 1))
            room -= r["_size"] * step
            taken += step
        fits.append((r["_size"], taken))
    few = df.sparkSession.createDataFrame(fits, "_size long, _fits long")
    placed = in_order(sets, "_size", key, "_at").join(F.broadcast(few), "_size")
    return placed.select(key, F.when(F.col("_at") <= F.col("_fits"), "train").otherwise("test").alias("split"))


def leave_pair_out(df: DataFrame, analyte: str, label: str) -> DataFrame:
    """Every pair of a positive and a negative analyte: ``pos, neg``."""
    a = df.groupBy(analyte).agg(F.max(F.col(label).cast("int")).alias("y"))
    return a.filter("y = 1").select(F.col(analyte).alias("pos")).crossJoin(a.filter("y = 0").select(F.col(analyte).alias("neg")))


def pair_wins(scores: DataFrame, pos: str = "pos_score", neg: str = "neg_score") -> DataFrame:
    """1 where the positive scores higher, 0.5 within 1e-12, else 0: column ``win``."""
    gap = F.col(pos) - F.col(neg)
    return scores.withColumn("win", F.when(F.abs(gap) <= 1e-12, 0.5).when(gap > 0, 1.0).otherwise(0.0))


def pair_ci(wins: np.ndarray, n_boot: int = 1000, seed: int = 0, alpha: float = 0.05) -> tuple[float, float, float]:
    """(mean, lo, hi) of a win matrix with its rows and columns resampled."""
    rng = np.random.default_rng(seed)
    a, b = wins.shape
    means = [wins[np.ix_(rng.integers(0, a, a), rng.integers(0, b, b))].mean() for _ in range(n_boot)]
    return float(wins.mean()), float(np.quantile(means, alpha / 2)), float(np.quantile(means, 1 - alpha / 2))
