"""Tie-aware ranking and classification metrics as aggregations.

Ranking metrics aggregate to one row per distinct score first.  Running sums
over scores are taken within stretches between score quantiles, and over the
stretches' totals, so that no task orders all scores of a key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _by(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by or [])


def _levels(df: DataFrame, by: list[str], label: str, score: str, weight: str | None) -> DataFrame:
    """Weight of positives ``p`` and negatives ``n`` at each distinct score; rows with a null label or score are left out."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y = F.col(label).cast("double") >= 0.5
    rows = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    return rows.groupBy(*by, F.col(score).alias("_s")).agg(F.sum(F.when(y, w).otherwise(0.0)).alias("p"), F.sum(F.when(y, 0.0).otherwise(w)).alias("n"))


#: Stretches that the scores are cut into.
STRETCHES = 64


def _running(levels: DataFrame, by: list[str], sums: dict[str, str], descending: bool = False, before: bool = False) -> DataFrame:
    """Add running sums in score order: ``sums`` maps a new column to the summed one.

    Including the row's own level, or with ``before`` only those ahead of it.
    """
    # every branch takes all columns of the levels, so that Spark computes and exchanges them once
    cuts = levels.agg(F.percentile_approx("_s", F.array(*(F.lit(i / STRETCHES) for i in range(1, STRETCHES))), F.lit(1000)).alias("_q"), F.sum(F.col("p") + F.col("n")).alias("_all"))
    cuts = cuts.select(F.when(F.col("_all").isNotNull(), F.col("_q")).alias("_q"))
    lv = levels.crossJoin(F.broadcast(cuts)).withColumn("_b", F.size(F.filter("_q", lambda q: q < F.col("_s")))).drop("_q")
    order = (lambda c: F.desc(c)) if descending else F.asc
    ahead = W.partitionBy(*by).orderBy(order("_b")).rowsBetween(W.unboundedPreceding, -1)
    totals = lv.groupBy(*by, "_b").agg(F.sum("p").alias("_t_p"), F.sum("n").alias("_t_n")).filter(F.col("_t_p") + F.col("_t_n") >= 0)
    totals = totals.select(*(F.col(c).alias(f"_k_{c}") for c in [*by, "_b"]), *(F.coalesce(F.sum(f"_t_{c}").over(ahead), F.lit(0.0)).alias(f"_o_{n}") for n, c in sums.items()))
    inside = W.partitionBy(*by, "_b").orderBy(order("_s")).rowsBetween(W.unboundedPreceding, -1 if before else W.currentRow)
    lv = lv.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0.0)).alias(f"_i_{n}") for n, c in sums.items()))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*by, "_b"]])
    return lv.join(totals, same).select(*by, "_s", "p", "n", *((F.col(f"_o_{n}") + F.col(f"_i_{n}")).alias(n) for n in sums))


def _per(df: DataFrame, by: list[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def _with_totals(levels: DataFrame, by: list[str]) -> DataFrame:
    """Add ``all_p`` and ``all_n``, the weights of both classes of a key."""
    t = _per(levels, by, F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    if not by:
        return levels.crossJoin(F.broadcast(t))
    t = t.select(*(F.col(c).alias(f"_k_{c}") for c in by), "all_p", "all_n")
    return levels.join(t, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by])).drop(*(f"_k_{c}" for c in by))


def auroc(df: DataFrame, label: str, score: str, by=None, weight: str | None = None) -> DataFrame:
    """Mann-Whitney area with ties at half: ``*by, auroc, n_pos, n_neg``; null with one class only."""
    by = _by(by)
    lv = _running(_levels(df, by, label, score, weight), by, {"below": "n"}, before=True)
    out = _per(lv, by, F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("_u"))
    return out.select(*by, F.try_divide("_u", F.col("n_pos") * F.col("n_neg")).alias("auroc"), "n_pos", "n_neg")


def average_precision(df: DataFrame, label: str, score: str, by=None) -> DataFrame:
    """Sum of precision times gained recall over distinct scores: ``*by, auprc``; null without positives."""
    by = _by(by)
    lv = _running(_levels(df, by, label, score, None), by, {"tp": "p", "fp": "n"}, descending=True)
    out = _per(lv, by, F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("_a"), F.sum("p").alias("_p"))
    return out.select(*by, F.try_divide("_a", "_p").alias("auprc"))


def tpr_at_fpr(df: DataFrame, label: str, score: str, fpr: float = 0.01, by=None) -> DataFrame:
    """Largest true-positive rate at a false-positive rate of at most ``fpr``: ``*by, tpr``."""
    by = _by(by)
    lv = _with_totals(_running(_levels(df, by, label, score, None), by, {"tp": "p", "fp": "n"}, descending=True), by)
    ok = F.try_divide("fp", "all_n") <= fpr
    return _per(lv, by, F.coalesce(F.max(F.when(ok, F.try_divide("tp", "all_p"))), F.lit(0.0)).alias("tpr"))


def best_threshold(df: DataFrame, label: str, score: str, by=None) -> DataFrame:
    """Smallest of the scores and 0.5 with the best balanced accuracy of ``score >= t``: ``*by, threshold, balanced_accuracy``."""
    by = _by(by)
    lv = _levels(df, by, label, score, None).select(*by, F.col("_s").cast("double").alias("_s"), "p", "n")
    half = (lv.select(*by).distinct() if by else lv.limit(1)).select(*by, F.lit(0.5).alias("_s"), F.lit(0.0).alias("p"), F.lit(0.0).alias("n"))
    lv = lv.unionByName(half).groupBy(*by, "_s").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    lv = _with_totals(_running(lv, by, {"tp": "p", "fp": "n"}, descending=True), by)
    ba = F.round((F.try_divide("tp", "all_p") + 1 - F.try_divide("fp", "all_n")) / 2, 12)
    out = _per(lv, by, F.max(F.struct(ba.alias("ba"), (-F.col("_s")).alias("t"))).alias("_b"))
    return out.select(*by, (-F.col("_b.t")).alias("threshold"), F.col("_b.ba").alias("balanced_accuracy"))


def calibration_error(df: DataFrame, label: str, prob: str, by=None, bins: int = 10) -> DataFrame:
    """Weighted mean gap of mean probability and rate of positives over equal bins: ``*by, ece``."""
    by = _by(by)
    b = F.least(F.greatest(F.floor(F.col(prob) * bins), F.lit(0)), F.lit(bins - 1))
    per = df.groupBy(*by, b.alias("_bin")).agg(F.count("*").alias("c"), F.avg(prob).alias("m"), F.avg(F.col(label).cast("double")).alias("r"))
    agg = (F.sum(F.col("c") * F.abs(F.col("m") - F.col("r"))) / F.sum("c")).alias("ece")
    return per.groupBy(*by).agg(agg) if by else per.agg(agg)


def binary_report(df: DataFrame, label: str, score: str, pred: str, by=None, with_ece: bool = False) -> DataFrame:
    """``auroc, auprc, balanced_accuracy`` and with ``with_ece`` also ``ece``, per key."""
    by = _by(by)
    y, p = F.col(label).cast("double") >= 0.5, F.col(pred).cast("double") >= 0.5
    agg = ((F.avg(F.when(y, p.cast("double"))) + F.avg(F.when(~y, (~p).cast("double")))) / 2).alias("balanced_accuracy")
    parts = [auroc(df, label, score, by), average_precision(df, label, score, by), df.groupBy(*by).agg(agg) if by else df.agg(agg)]
    parts += [calibration_error(df, label, score, by)] if with_ece else []
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, by) if by else out.crossJoin(part)
    return out


def multiclass_report(df: DataFrame, label: str, pred: str, by=None) -> DataFrame:
    """``accuracy, balanced_accuracy, macro_f1`` over the classes of the truth; a class never predicted has F1 0."""
    by = _by(by)
    truth = df.groupBy(*by, F.col(label).alias("_c")).agg(F.count("*").alias("n"), F.sum((F.col(label) == F.col(pred)).cast("int")).alias("hit"))
    said = df.groupBy(*by, F.col(pred).alias("_c")).agg(F.count("*").alias("said"))
    both = truth.join(said, [*by, "_c"], "left").fillna(0, ["said"])
    agg = (
        (F.sum("hit") / F.sum("n")).alias("accuracy"),
        F.avg(F.col("hit") / F.col("n")).alias("balanced_accuracy"),
        F.avg(2 * F.col("hit") / (F.col("n") + F.col("said"))).alias("macro_f1"),
    )
    return both.groupBy(*by).agg(*agg) if by else both.agg(*agg)


def class_recall(df: DataFrame, label: str, pred: str, by=None) -> DataFrame:
    """Recall and size of every class."""
    return df.groupBy(*_by(by), F.col(label).alias("label")).agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("recall"), F.count("*").alias("n"))


def confusion(df: DataFrame, label: str, pred: str, classes: list | None = None) -> DataFrame:
    """Long count matrix ``label, pred, n``; with ``classes`` square, zeros included and others left out."""
    counts = df.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    if classes is None:
        return counts
    c = df.sparkSession.createDataFrame([(x,) for x in classes], df.select(F.col(label).alias("label")).schema)
    square = c.crossJoin(c.select(F.col("label").alias("pred")))
    return square.join(counts, ["label", "pred"], "left").fillna(0, ["n"])


def majority_rate(df: DataFrame, label: str, by=None) -> DataFrame:
    """Share of the largest class: ``*by, majority_rate``."""
    by = _by(by)
    c = df.groupBy(*by, label).count()
    agg = (F.max("count") / F.sum("count")).alias("majority_rate")
    return c.groupBy(*by).agg(agg) if by else c.agg(agg)


def chance(metric: str, n_classes: Column, positive_rate: Column) -> Column:
    """Chance level of a metric."""
    if metric == "auroc":
        return F.lit(0.5)
    if metric == "auprc":
        return positive_rate
    return 1 / n_classes if metric in ("balanced_accuracy", "macro_f1") else F.greatest(positive_rate, 1 - positive_rate)


def group_vote(df: DataFrame, group: str, label: str, pred: str, score: str | None = None) -> DataFrame:
    """One row a group. With ``score``: mean score, label and prediction at a mean of 0.5 or more. Without: the commonest label and prediction, ties to the smallest."""
    if score:
        half = lambda c: (F.avg(F.col(c).cast("double")) >= 0.5).cast("int")
        return df.groupBy(group).agg(F.avg(score).alias("score"), half(label).alias("label"), half(pred).alias("pred"), F.count("*").alias("n"))

    def mode(c: str) -> DataFrame:
        counts = df.groupBy(group, F.col(c).alias("v")).agg(F.count("*").alias("k"))
        first = counts.withColumn("r", F.row_number().over(W.partitionBy(group).orderBy(F.desc("k"), "v"))).filter("r = 1")
        return first.select(group, F.col("v").alias("label" if c == label else "pred"))

    return mode(label).join(mode(pred), group)


def by_analyte(df: DataFrame, analyte: str, label: str, score: str) -> DataFrame:
    """Mean score and majority label of every analyte."""
    return df.groupBy(analyte).agg(F.avg(score).alias("score"), (F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("label"))
