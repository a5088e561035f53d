"""Metrics of predictions on overlapping subsets, by row and by vote of a group, with intervals over each subset's own groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismal.operators import bootstraps as B
from prismal.operators import metrics as M
from prismal.operators import resample as R
from prismal.session import settled


def votes(pred: DataFrame, group: str, by: list[str], binary: bool = True) -> DataFrame:
    """One row a key and group, ``*by, grp, y, pred, score``: mean score, and label and prediction at a mean of 0.5 or more.

    With classes the commonest prediction, ties to the smallest, the smallest
    label, and no score.  Rows without a group are left out.
    """
    rows = pred.filter(F.col(group).isNotNull()).withColumn("_g", F.col(group).cast("string"))
    if binary:
        half = lambda c: (F.avg((F.col(c).cast("double") >= 0.5).cast("double")) >= 0.5).cast("double")
        return rows.groupBy(*by, "_g").agg(half("y").alias("y"), half("pred").alias("pred"), F.avg("score").alias("score")).withColumnRenamed("_g", "grp")
    counts = rows.groupBy(*by, "_g", "pred").agg(F.count("*").alias("_k"), F.min("y").alias("y"))
    first = counts.groupBy(*by, "_g").agg(F.min("y").alias("y"), F.min(F.struct(-F.col("_k"), F.col("pred"))).alias("_f"))
    return first.select(*by, F.col("_g").alias("grp"), "y", F.col("_f.pred").alias("pred"), F.lit(None).cast("double").alias("score"))


def class_metrics(counts: DataFrame, by: list[str], binary: bool = True) -> DataFrame:
    """``*by, accuracy, balanced_accuracy, macro_f1`` of weighted counts ``y, pred, w``, over the classes of the truth.

    With ``binary`` balanced accuracy is null where a class is missing.
    """
    named = lambda c, to: F.col(c).alias(to)
    hit = F.sum(F.when(F.col("y") == F.col("pred"), F.col("w")).otherwise(0.0))
    truth = counts.groupBy(*by, named("y", "_c")).agg(F.sum("w").alias("n"), hit.alias("hit")).filter("n > 0")
    said = counts.groupBy(*by, named("pred", "_c")).agg(F.sum("w").alias("said"))
    keys = [*by, "_c"]
    said = said.select(*(F.col(c).alias(f"_k_{c}") for c in keys), "said")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys])
    both = truth.join(said, same, "left").select(*keys, "n", "hit", F.coalesce("said", F.lit(0.0)).alias("said"))
    balanced = F.avg(F.col("hit") / F.col("n"))
    agg = (
        (F.sum("hit") / F.sum("n")).alias("accuracy"),
        (F.when(F.count("*") > 1, balanced) if binary else balanced).alias("balanced_accuracy"),
        F.avg(2 * F.col("hit") / (F.col("n") + F.col("said"))).alias("macro_f1"),
    )
    return both.groupBy(*by).agg(*agg) if by else both.agg(*agg)


def _long(df: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names))
    return df.select(*by, F.explode(pairs).alias("_p")).select(*by, "_p.metric", "_p.value")


def _names(binary: bool) -> list[str]:
    return ["balanced_accuracy"] if binary else ["accuracy", "balanced_accuracy", "macro_f1"]


def _counts(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, "grp", "y", "pred").agg(F.count("*").cast("double").alias("w"))


def _values(rows: DataFrame, by: list[str], binary: bool) -> DataFrame:
    """``*by, metric, value`` of rows ``*by, grp, y, pred, score``."""
    found = [_long(class_metrics(_counts(rows, by), by, binary), by, _names(binary))]
    if binary:
        found += [_long(M.auroc(rows, "y", "score", by), by, ["auroc"]), _long(M.average_precision(rows, "y", "score", by), by, ["auprc"])]
    return reduce(lambda a, b: a.unionByName(b), found)


def _intervals(rows: DataFrame, by: list[str], binary: bool, n_boot: int, seed: int) -> DataFrame:
    """``*by, metric, lo, hi, n_ok``: counts by group meet the replicates, rows never do."""
    drawn = _counts(rows, by).join(R.replicates(rows, "grp", n_boot, seed), "grp").groupBy(*by, "rep", "y", "pred").agg(F.sum(F.col("w") * F.col("mult")).alias("w"))
    ci = R.interval(_long(class_metrics(drawn, [*by, "rep"], binary), [*by, "rep"], _names(binary)), "value", n_boot, by=[*by, "metric"])
    if not binary:
        return ci
    return ci.unionByName(B.area_interval(rows, "grp", "y", "score", n_boot, seed, by=by).withColumn("metric", F.lit("auroc")))


def subset_metrics(
    pred: DataFrame, subsets: dict[str, Column], by: list[str], n_boot: int = 1000, seed: int = 0, binary: bool = True, vote: tuple[str, str] | None = None,
    vote_subsets: list[str] | None = None, with_ece: bool = False,
) -> DataFrame:
    """Long rows ``*by, subset, metric, value, lo, hi, n_ok, n_test, n_test_groups`` of ``*by, grp, y, pred, score``.

    ``subsets`` maps names to conditions on ``pred``; they may overlap, and one
    without rows gives none.  Groups are resampled within a subset, the same
    ones for all its keys.  ``vote`` (a column, a name) adds ``subset@name`` on one
    row a group of that column, resampled by these groups, for ``vote_subsets`` or
    for all.  Metrics are area, average precision, balanced accuracy and with
    ``with_ece`` calibration error, or with classes accuracy, balanced accuracy and
    macro F1; average precision and calibration error have no interval.  Rows without
    label or prediction are left out, and those without a group have no part in intervals
    or group counts; a condition that is null leaves a row out.  Keys are not null.
    """
    names = list(subsets)
    member = F.filter(F.array(*(F.when(subsets[n], F.lit(n)) for n in names)), lambda n: n.isNotNull())
    keys, columns = [*by, "subset"], [*by, "subset", "grp", "y", "pred", "score"]
    rows = pred.filter(F.col("y").isNotNull() & F.col("pred").isNotNull()).withColumn("subset", F.explode(member))
    if binary:
        rows = rows.withColumn("y", (F.col("y").cast("double") >= 0.5).cast("double")).withColumn("pred", (F.col("pred").cast("double") >= 0.5).cast("double"))
    use = rows.select(*by, "subset", F.col("grp").cast("string").alias("grp"), "y", "pred", F.col("score").cast("double").alias("score"))
    if vote:
        column, called = vote
        of = rows if vote_subsets is None else rows.filter(F.col("subset").isin(vote_subsets))
        use = use.unionByName(votes(of, column, keys, binary).withColumn("subset", F.concat("subset", F.lit(f"@{called}"))).select(*columns))
        names += [f"{n}@{called}" for n in names if vote_subsets is None or n in vote_subsets]
    # all metrics of all subsets read one small table
    use = settled(use, "subset_rows")
    value = _values(use, keys, binary)
    if binary and with_ece:
        value = value.unionByName(_long(M.calibration_error(use.filter(F.col("subset").isin(list(subsets))), "y", "score", keys), keys, ["ece"]))
    sizes = use.groupBy(*keys).agg(F.count("*").alias("n_test"), F.countDistinct("grp").alias("n_test_groups"))
    out = value.join(sizes, keys)
    if n_boot:
        # a subset draws from its own groups
        ci = [_intervals(use.filter(F.col("subset") == n), keys, binary, n_boot, seed) for n in names]
        out = out.join(reduce(lambda a, b: a.unionByName(b), ci), [*keys, "metric"], "left")
    else:
        out = out.select("*", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(None).cast("long").alias("n_ok"))
    return out.select(*keys, "metric", "value", "lo", "hi", "n_ok", "n_test", "n_test_groups")
