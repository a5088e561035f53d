"""Exact quantiles per key in bounded memory.

Keys of few rows are sorted in one buffer each.  For larger ones the places that
a quantile lies between are found by histograms: the interval of a place is cut
in bins, the bin that holds the place becomes the interval, between the least and
the greatest value in it, until it holds few rows or one value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prismal.session import settled

#: Rows that one buffer holds, and bins of a histogram.
FEW, BINS = 1 << 16, 1024


def quantiles(df: DataFrame, value: str, by: list[str], probs: tuple[float, ...], name: str = "q") -> DataFrame:
    """``*by, name``: an array of the quantiles, interpolated between places; nulls and NaN are left out, a key of nothing else has no row.

    ``df`` is read once for the keys' sizes and, where one has more than ``FEW``
    rows, once a round for all of them.  A null key is a key.
    """
    keys = by or ["_all"]
    base = df.select(*(by or [F.lit(0).alias("_all")]), F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    sizes = settled(base.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "sizes")
    array = F.array(*(F.lit(float(p)) for p in probs))
    large = sizes.filter(F.col("_n") > FEW)
    if not large.limit(1).count():
        return base.groupBy(*keys).agg(F.percentile("_v", array).alias(name)).select(*by, name)
    small = _matched(base, sizes.filter(F.col("_n") <= FEW), keys).groupBy(*keys).agg(F.percentile("_v", array).alias(name))
    # the places on both sides of each quantile
    at = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(F.lit(float(p)) * (F.col("_n") - 1)), F.ceil(F.lit(float(p)) * (F.col("_n") - 1))) for p in probs))))
    state = large.select(*keys, "_lo", "_hi", F.col("_n").alias("_in"), F.lit(0).cast("long").alias("_before"), F.explode(at).alias("_place"))
    done = []
    while True:
        state = settled(state, "places")
        done.append(state.filter((F.col("_in") <= FEW) | (F.col("_lo") == F.col("_hi"))))
        state = state.filter((F.col("_in") > FEW) & (F.col("_lo") < F.col("_hi")))
        if not state.limit(1).count():
            break
        # halves first: the width of the widest interval does not overflow
        share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        inside = _matched(base, state, keys).filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        bins = inside.groupBy(*keys, "_place", "_before", F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("_b")).agg(F.count("*").alias("_in"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        w = W.partitionBy(*keys, "_place").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
        bins = bins.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_in").over(w), F.lit(0)))
        state = bins.filter((F.col("_place") >= F.col("_before")) & (F.col("_place") < F.col("_before") + F.col("_in"))).drop("_b")
    found = reduce(lambda a, b: a.unionByName(b), done)
    same = found.filter(F.col("_lo") == F.col("_hi")).select(*keys, "_place", F.col("_lo").alias("_x"))
    rest = _matched(base, found.filter(F.col("_lo") < F.col("_hi")), keys).filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
    rest = rest.groupBy(*keys, "_place", "_before").agg(F.sort_array(F.collect_list("_v")).alias("_s")).select(*keys, "_place", F.get("_s", (F.col("_place") - F.col("_before")).cast("int")).alias("_x"))
    spots = same.unionByName(rest).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_place", "_x"))).alias("_at"))
    both = _matched(spots, large.select(*keys, "_n"), keys)

    def one(p: float):
        h = F.lit(float(p)) * (F.col("_n") - 1)
        low = F.col("_at")[F.floor(h)]
        return low + (h - F.floor(h)) * (F.col("_at")[F.ceil(h)] - low)

    return small.select(*by, name).unionByName(both.select(*by, F.array(*(one(p) for p in probs)).alias(name)))


def _matched(rows: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with a null matching a null; the side has a row or a few for each key of many rows."""
    other = side.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in side.columns if c not in keys))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return rows.join(other, on).drop(*(f"_k{i}" for i in range(len(keys))))
