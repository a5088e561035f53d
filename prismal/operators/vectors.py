"""Operators on vectors in long form: ``id, k, v`` with one row a component.

Long form keeps means, deviations and centring in plain partial aggregation,
whatever the number of rows; ``explode_vector`` and ``gather_vector`` convert.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prismal.functions import arrays as A
from prismal.operators import near as N
from prismal.operators.near import link_counts, near_pairs  # noqa: F401


def _by(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by or [])


def explode_vector(df: DataFrame, vector: str, keep: list[str]) -> DataFrame:
    """``*keep, k, v``; a null or empty vector gives no row."""
    return df.select(*keep, F.posexplode(A.doubles(F.col(vector))).alias("k", "v"))


def gather_vector(long: DataFrame, keys: list[str], name: str = "v") -> DataFrame:
    """One array a key, components in order of ``k``; a vector has few components, so the list is bounded."""
    return long.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias(name))


def mean_vectors(df: DataFrame, vector: str, by, size: int | None = None) -> DataFrame:
    """Mean of vectors per key, as arrays: ``*by, mean, n``."""
    by = _by(by)
    long = explode_vector(df, vector, by).groupBy(*by, "k").agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    keys = by or [F.lit(1).alias("_one")]
    out = long.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("mean"), F.max("n").alias("n"))
    return out.drop("_one")


def standardise(train: DataFrame, other: DataFrame, vector: str, out: str = "z", floor: float = 1e-6) -> DataFrame:
    """Add to ``other`` its vectors less the training mean over the training population deviation (1 where that is at most ``floor``).

    The statistics are one row, so they are broadcast whatever the data's size.
    """
    stats = explode_vector(train, vector, []).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    packed = stats.agg(F.array_sort(F.collect_list(F.struct("k", "m", F.when(F.col("s") <= floor, 1.0).otherwise(F.col("s")).alias("s")))).alias("_st"))
    z = F.zip_with(A.doubles(F.col(vector)), F.col("_st"), lambda x, t: (x - t["m"]) / t["s"])
    return other.crossJoin(F.broadcast(packed)).withColumn(out, z).drop("_st")


def centre_by_domain(df: DataFrame, vector: str, domain: str, group: str | None = None, out: str = "centred") -> DataFrame:
    """Subtract each domain's mean, of its groups' means where ``group`` is given. A null domain is one of its own."""
    long = explode_vector(df, vector, [domain] + ([group] if group else []))
    if group:
        long = long.groupBy(domain, group, "k").agg(F.avg("v").alias("v"))
    means = gather_vector(long.groupBy(domain, "k").agg(F.avg("v").alias("v")), [domain], "_m").withColumnRenamed(domain, "_d")
    return df.join(means, df[domain].eqNullSafe(means["_d"])).withColumn(out, A.minus(A.doubles(F.col(vector)), F.col("_m"))).drop("_m", "_d")


def subtract_controls(df: DataFrame, controls: DataFrame, vector: str, key: str, out: str = "v") -> DataFrame:
    """Subtract the mean of the controls of the same key; a key without controls raises when read."""
    means = mean_vectors(controls, vector, key).select(F.col(key), F.col("mean").alias("_c"))
    joined = df.join(means, key, "left")
    missing = F.raise_error(F.concat(F.lit("no controls for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("array<double>")
    return joined.withColumn(out, F.when(F.col("_c").isNull(), missing).otherwise(A.minus(A.doubles(F.col(vector)), F.col("_c")))).drop("_c")


def lookup(ids: DataFrame, store: DataFrame, id_col: str = "id") -> DataFrame:
    """Stored rows of the given ids; one that is missing raises when read."""
    kept = ids.select(id_col).join(store.withColumn("_there", F.lit(True)), id_col, "left")
    check = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("missing id "), F.col(id_col).cast("string"))).cast("boolean")).otherwise(True)
    return kept.filter(check).drop("_there")


def mass_mean_probe(train: DataFrame, test: DataFrame, vector: str, label: str, id_col: str) -> DataFrame:
    """One-against-rest direction of each label, the difference of class means: ``id, label, y, score``.

    The score is the product with the direction less that of the midpoint.
    Weights are one row a label, tiny beside the data.
    """
    long = explode_vector(train, vector, [label])
    by_class = long.groupBy(label, "k").agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    every = by_class.groupBy("k").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    means = by_class.join(every, "k").withColumn("p", F.col("s") / F.col("n")).withColumn("q", F.try_divide(F.col("ts") - F.col("s"), F.col("tn") - F.col("n")))
    w = means.groupBy(F.col(label).alias("label")).agg(F.array_sort(F.collect_list(F.struct("k", (F.col("p") - F.col("q")).alias("w"), ((F.col("p") + F.col("q")) / 2).alias("m")))).alias("_w"))
    score = A.total(F.zip_with(A.doubles(F.col(vector)), F.col("_w"), lambda x, t: (x - t["m"]) * t["w"]))
    # one row a label against the test rows: labels are few, not a cross product of data
    scored = test.crossJoin(F.broadcast(w))
    return scored.select(F.col(id_col).alias("id"), scored["label"] if label != "label" else w["label"], (test[label] == w["label"]).cast("int").alias("y"), score.alias("score"))


def nearest_centroid(train: DataFrame, test: DataFrame, vector: str, label: str, id_col: str) -> DataFrame:
    """Class whose mean has the largest cosine after the training mean is taken off: ``id, truth, pred, sim, prob``.

    Ties go to the smallest class; ``prob`` is the softmax of ten times the cosines.
    """
    means = mean_vectors(train, vector, label).select(F.col(label).alias("pred"), "mean")
    centre = mean_vectors(train, vector, []).select(F.col("mean").alias("_centre"))
    c = means.crossJoin(F.broadcast(centre)).select("pred", A.unit(A.minus(F.col("mean"), F.col("_centre"))).alias("_m"))
    rows = test.crossJoin(F.broadcast(centre)).select(F.col(id_col).alias("id"), F.col(label).alias("truth"), A.unit(A.minus(A.doubles(F.col(vector)), F.col("_centre"))).alias("_x"))
    sims = rows.crossJoin(F.broadcast(c)).select("id", "truth", "pred", A.dot(F.col("_x"), F.col("_m")).alias("sim"))
    best = sims.groupBy("id", "truth").agg(F.min(F.struct((-F.round("sim", 12)).alias("s"), F.col("pred"), F.col("sim"))).alias("b"), F.sum(F.exp(10 * F.col("sim"))).alias("z"))
    return best.select("id", "truth", F.col("b.pred").alias("pred"), F.col("b.sim").alias("sim"), (F.exp(10 * F.col("b.sim")) / F.col("z")).alias("prob"))


def cosine_neighbours(queries: DataFrame, base: DataFrame, vector: str, id_col: str, k: int, carry: list[str] | None = None, apart: str | None = None) -> DataFrame:
    """The ``k`` rows of ``base`` with the largest cosine for every query row, itself left out: ``query_id, id, sim, rank``.

    With ``apart`` only rows that differ in that column, such as a fold, are compared.

    Exact, both sides of any size: pairs of blocks are compared as tasks of their
    own and give ``k`` rows a query each.  The work is the product of both sides.
    """
    near = N.nearest(queries, base, vector, id_col, k, apart)
    w = W.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    best = near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.join(base.select(F.col(id_col).alias("id"), *carry), "id") if carry else best


def neighbour_vote(neighbours: DataFrame, label: str) -> DataFrame:
    """Class with the largest sum of inverse cosine distances: ``query_id, pred``; ties to the smallest class.

    A neighbour at distance zero outweighs every other.
    """
    weight = 1 / F.greatest(1 - F.col("sim"), F.lit(1e-12))
    votes = neighbours.groupBy("query_id", F.col(label).alias("pred")).agg(F.sum(weight).alias("w"))
    w = W.partitionBy("query_id").orderBy(F.desc(F.round("w", 6)), "pred")
    return votes.withColumn("r", F.row_number().over(w)).filter("r = 1").select("query_id", "pred")
