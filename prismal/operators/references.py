"""Reference lookup: condition means, same-index pairs and fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prismal.functions import ids as I
from prismal.operators import vectors as V


def condition_means(refs: DataFrame, vector: str, id_col: str = "id") -> DataFrame:
    """Mean reference of every condition: ``condition, mean, n``."""
    return V.mean_vectors(refs.withColumn("condition", I.condition(F.col(id_col))), vector, "condition")


def find_reference(samples: DataFrame, refs: DataFrame, vector: str, pair_by: str = "condition_mean", id_col: str = "id") -> DataFrame:
    """Add ``ref`` and ``ref_label``: the condition's mean if there is one, else the reference of the paired id, else nulls."""
    own = refs.select(F.col(id_col).alias("_rid"), F.col(vector).cast("array<double>").alias("_own"))
    out = samples.withColumn("_pair", I.pair_name(F.col(id_col))).join(own, F.col("_pair") == F.col("_rid"), "left")
    ref, label = F.col("_own"), F.when(F.col("_own").isNotNull(), F.col("_rid"))
    if pair_by == "condition_mean":
        means = condition_means(refs, vector, id_col).select(F.col("condition").alias("_c"), F.col("mean").alias("_m"), F.col("n").alias("_n"))
        out = out.withColumn("_cond", I.condition(F.col(id_col))).join(means, F.col("_cond") == F.col("_c"), "left")
        ref = F.coalesce("_m", ref)
        label = F.coalesce(F.when(F.col("_m").isNotNull(), F.format_string("mean(%s, n=%d)", "_c", "_n")), label)
    return out.withColumn("ref", ref).withColumn("ref_label", label).drop("_rid", "_own", "_pair", "_c", "_m", "_n", "_cond")


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(order))).filter("_r = 1").drop("_r")


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: a later duplicate wins."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).filter("_r = 1").drop("_r")


def complete_keys(df: DataFrame, key: str, side: str, n_sides: int | None = None) -> DataFrame:
    """Rows of keys that occur on every side, or on ``n_sides`` of them."""
    n = F.lit(n_sides) if n_sides else None
    counts = df.groupBy(key).agg(F.countDistinct(side).alias("_k"))
    if n is None:
        total = df.agg(F.countDistinct(side).alias("_t"))
        keys = counts.crossJoin(F.broadcast(total)).filter("_k = _t").select(key)
    else:
        keys = counts.filter(F.col("_k") == n).select(key)
    return df.join(keys, key, "left_semi")


def only_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of the left table that the right one lacks."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


#: The candidate keys of the row alignment, as name and expression over a molecule row.
CANDIDATES = {"number": "number", "number+1": "number + 1", "number-1": "number - 1", "list_pos": "list_pos", "list_pos+1": "list_pos + 1", "row": "row"}


def candidate_joins(molecules: DataFrame) -> DataFrame:
    """Every way a molecule row may map to a signal id: ``candidate, key, list_pos`` in one pass."""
    pairs = F.array(*(F.struct(F.lit(n).alias("candidate"), F.expr(e).cast("bigint").alias("key")) for n, e in CANDIDATES.items()))
    return molecules.select("*", F.explode(pairs).alias("c")).select("c.candidate", "c.key", *molecules.columns)


def evaluate_joins(molecules: DataFrame, signals: DataFrame, markers: dict[str, str], min_coverage: float = 0.99, min_auroc: float = 0.90) -> DataFrame:
    """Coverage and marker areas of every candidate: ``candidate, coverage, auroc_<marker>..., passes, signature``.

    ``markers`` maps a 0/1 column of the molecules to a score column of the
    signals.  Signatures are equal for candidates that assign the same rows.
    """
    from prismal.operators.metrics import auroc

    total = signals.count()
    joined = candidate_joins(molecules).join(signals, F.col("key") == signals["id"])
    out = joined.groupBy("candidate").agg(
        (F.countDistinct("id") / F.lit(max(1, total))).alias("coverage"), F.sum(F.xxhash64("id", "list_pos").cast("decimal(38,0)")).cast("string").alias("signature"))
    for flag, score in markers.items():
        out = out.join(auroc(joined, flag, score, "candidate").select("candidate", F.col("auroc").alias(f"auroc_{flag}")), "candidate", "left")
    good = F.col("coverage") >= min_coverage
    for flag in markers:
        good = good & (F.coalesce(F.col(f"auroc_{flag}"), F.lit(0.0)) >= min_auroc)
    return out.withColumn("passes", good)


def one_alignment(evaluated: DataFrame) -> DataFrame:
    """One row ``n_mappings, ok``: exactly one distinct passing mapping is wanted."""
    return evaluated.filter("passes").agg(F.countDistinct("signature").alias("n_mappings")).withColumn("ok", F.col("n_mappings") == 1)
