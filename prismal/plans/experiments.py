"""Evaluation plans: specs, folds, metrics with intervals, permutation tests.

A spec names DataFrames and columns; ``run`` expands specs, features and models
into fits, pools the predictions in one long table and lets the metric
operators aggregate it by key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prismal.functions import arrays as A
from prismal.operators import bootstraps as B
from prismal.operators import estimators as E
from prismal.operators import metrics as M
from prismal.operators import refits as X
from prismal.operators import resample as R
from prismal.operators import shuffles as H
from prismal.operators.subsets import subset_metrics
from prismal.session import ship


@dataclass
class Context:
    """Settings of a run; the number of permutations is an argument, never a matter of time left."""

    n_boot: int = 1000
    n_perm: int = 1000
    seed: int = 0
    features: tuple[str, ...] = ("F1",)
    models: tuple[str, ...] = ("majority", "centroid")
    min_positives: int = 10


@dataclass
class Spec:
    """One evaluation: a table ``id, feature, v, <label>, <group>`` and how to hold rows out.

    With ``test`` the models are fitted on ``rows`` and score ``test``; else
    every fold of ``folds`` (column of ``rows``) is scored by the others.
    """

    name: str
    rows: DataFrame
    label: str
    group: str
    test: DataFrame | None = None
    folds: str | None = None
    binary: bool = True
    hyper: dict = field(default_factory=dict)


def predictions(specs: list[Spec], ctx: Context) -> DataFrame:
    """``spec, feature, model, id, grp, y, pred, score`` of every combination, out of sample."""
    parts = []
    for s in specs:
        for feature in ctx.features:
            rows = s.rows.filter(F.col("feature") == feature).cache()
            for model in ctx.models:
                fit, hp = E.make(model), s.hyper.get(model, {})
                if s.test is not None:
                    held = [(rows, s.test.filter(F.col("feature") == feature))]
                else:
                    names = [r[0] for r in rows.select(s.folds).distinct().orderBy(s.folds).collect()]
                    held = [(rows.filter(F.col(s.folds) != k), rows.filter(F.col(s.folds) == k)) for k in names]
                for train, test in held:
                    scored = fit(train, "v", s.label, **hp).apply(test)
                    parts.append(scored.select(
                        F.lit(s.name).alias("spec"), F.lit(feature).alias("feature"), F.lit(model).alias("model"), F.col("id").cast("string").alias("id"),
                        F.col(s.group).cast("string").alias("grp"), F.col(s.label).cast("string").alias("y"), F.col("pred").cast("string").alias("pred"), F.col("score").cast("double").alias("score")))
    return reduce(lambda a, b: a.unionByName(b), parts)


KEY = ["spec", "feature", "model"]


def metric_rows(pred: DataFrame, ctx: Context, binary: bool = True) -> DataFrame:
    """Long metric rows ``spec, feature, model, metric, value, lo, hi, n_ok``; intervals resample groups."""
    if binary:
        rows = pred.withColumn("y", F.col("y").cast("double"))
        value = M.auroc(rows, "y", "score", KEY).select(*KEY, F.lit("auroc").alias("metric"), F.col("auroc").alias("value"))
        ci = B.area_interval(rows, "grp", "y", "score", ctx.n_boot, ctx.seed, by=KEY)
        return value.join(ci, KEY, "left")
    rep = M.multiclass_report(pred, "y", "pred", KEY)
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("accuracy", "balanced_accuracy", "macro_f1")))
    value = rep.select(*KEY, F.explode(pairs).alias("p")).select(*KEY, "p.metric", "p.value")

    def balanced(d: DataFrame, by: list[str], w: str) -> DataFrame:
        per = d.groupBy(*by, "y").agg((F.sum(F.col("hit") * F.col(w)) / F.sum(F.col("rows") * F.col(w))).alias("r"))
        return per.groupBy(*by).agg(F.avg("r").alias("balanced_accuracy"))

    # hits are counted by group before groups meet their replicates
    hits = pred.groupBy(*KEY, "grp", "y").agg(F.count_if(F.col("y") == F.col("pred")).alias("hit"), F.count("*").alias("rows"))
    ci = R.bootstrap_ci(hits, "grp", balanced, "balanced_accuracy", ctx.n_boot, ctx.seed, by=KEY).withColumn("metric", F.lit("balanced_accuracy"))
    return value.join(ci, [*KEY, "metric"], "left")


def subset_rows(pred: DataFrame, ctx: Context, subsets: dict[str, Column], binary: bool = True, vote: tuple[str, str] | None = None, vote_subsets: list[str] | None = None, with_ece: bool = False) -> DataFrame:
    """Metric rows by subset of the test rows, and by vote of a group as ``subset@name``, with sizes: ``*KEY, subset, metric, value, lo, hi, n_ok, n_test, n_test_groups``."""
    return subset_metrics(pred, subsets, KEY, ctx.n_boot, ctx.seed, binary, vote, vote_subsets, with_ece)


#: Models with refitted nulls.
REFITTED = ("centroid", *X.HYPER)


def with_nulls(metrics: DataFrame, specs: list[Spec], ctx: Context, which: str = "primary,best") -> DataFrame:
    """Metric rows with ``p_perm, n_perm, perm_null_mean``, filled in where a refitted null was made.

    A null is made for the area of every binary spec with folds: of the model
    logistic on the first feature and of the best combination, or with ``all`` of
    all combinations that ``REFITTED`` has.  All others, and a spec with a test
    table of its own, have nulls in these columns.
    """
    by_name = {s.name: s for s in specs if s.binary and s.folds and s.test is None}
    areas = metrics.filter(F.col("metric") == "auroc")
    best = best_combo(areas.filter(F.col("model").isin(*REFITTED)), ("spec",)).select(*KEY)
    first = areas.filter((F.col("model") == "logistic") & (F.col("feature") == ctx.features[0])).select(*KEY)
    chosen = (areas.filter(F.col("model").isin(*REFITTED)).select(*KEY) if which == "all" else best.unionByName(first)).distinct()
    found = []
    # a row a combination of named specs, features and models
    for c in chosen.orderBy(*KEY).collect():
        if c.spec not in by_name:
            continue
        s = by_name[c.spec]
        hyper = {"logistic": "c", "plsda": "k", "knn": "k"}.get(c.model)
        rows = s.rows.filter(F.col("feature") == c.feature)
        null = refit_permutation(rows, "v", s.label, s.group, s.folds, ctx, None, c.model, s.hyper.get(c.model, {}).get(hyper))
        key = [F.lit(c[k]).alias(k) for k in KEY]
        found.append(null.select(*key, F.lit("auroc").alias("metric"), F.col("p").alias("p_perm"), F.col("n_perm"), F.col("null_mean").alias("perm_null_mean")))
    if not found:
        return metrics.select("*", F.lit(None).cast("double").alias("p_perm"), F.lit(None).cast("int").alias("n_perm"), F.lit(None).cast("double").alias("perm_null_mean"))
    return metrics.join(reduce(lambda a, b: a.unionByName(b), found), [*KEY, "metric"], "left")


def best_combo(rows: DataFrame, by=("spec",), metric: str = "auroc", family: str | None = None) -> DataFrame:
    """Best non-majority feature and model per key; the first by name wins ties."""
    from prismal.functions.ids import family as in_family

    use = rows.filter((F.col("metric") == metric) & (F.col("model") != "majority") & ~F.col("feature").startswith("META"))
    if family:
        use = use.filter(in_family(F.col("feature"), family))
    w = W.partitionBy(*by).orderBy(F.desc_nulls_last(F.round("value", 9)), "feature", "model")
    return use.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def permutation_p(pred: DataFrame, ctx: Context, label: str = "y", group: str = "grp", strata: str | None = None) -> DataFrame:
    """p of the area of fixed scores under group-wise shuffles of the labels: ``auroc, p``.

    A weaker question than ``refit_permutation`` asks: the scores have seen the
    true labels.  Scores are ranked once for all shuffles.
    """
    rows = pred.withColumn(label, F.col(label).cast("double").cast("int"))
    return H.against_null(H.null_areas(rows, group, label, "score", ctx.n_perm, strata, ctx.seed)).select("auroc", "p")


#: Numbers of a block of refitted directions that is broadcast: 32 MB.
BLOCK = 4_000_000


def _centroid_directions(rows: DataFrame, labels: DataFrame, vector: str, label: str, group: str, folds: str) -> tuple[DataFrame, DataFrame]:
    """(``perm, fold, w``, ``fold, c``): what tells class 1 from 0 and the centre, by the rows outside each fold.

    Every shuffle is refitted from the same sums, one vector a group and fold.
    """
    from prismal.operators import vectors as V

    sums = V.explode_vector(rows, vector, [folds, group]).groupBy(folds, group, "k").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    names = rows.select(folds).distinct()
    added = F.sum("s").alias("s"), F.sum("n").alias("n")

    def outside(part: DataFrame, keys: list[str], s: str, n: str) -> DataFrame:
        whole = part.groupBy(*keys, "k").agg(F.sum("s").alias("_s"), F.sum("n").alias("_n")).crossJoin(F.broadcast(names))
        rest = (F.col("_s") - F.coalesce("s", F.lit(0.0))).alias(s), (F.col("_n") - F.coalesce("n", F.lit(0))).alias(n)
        return whole.join(part, [folds, *keys, "k"], "left").select(folds, *keys, "k", *rest)

    # class 0 is what class 1 leaves of all, so only groups of class 1 meet the shuffles
    every = outside(sums.groupBy(folds, "k").agg(*added), [], "t", "m")
    ones = sums.join(labels.filter(F.col(label) == 1), group).groupBy("perm", folds, "k").agg(*added)
    c, own = F.try_divide("t", "m"), outside(ones, ["perm"], "s", "n").join(F.broadcast(every), [folds, "k"])
    means = F.struct("k", (F.try_divide("s", "n") - c).alias("a"), (F.try_divide(F.col("t") - F.col("s"), F.col("m") - F.col("n")) - c).alias("b"))
    both = own.groupBy("perm", folds).agg(F.array_sort(F.collect_list(means)).alias("z"))
    centre = every.groupBy(folds).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", c.alias("c")))), lambda z: z["c"]).alias("c"))
    part = lambda name: A.unit(F.transform("z", lambda z: z[name]))
    return both.select("perm", folds, A.minus(part("a"), part("b")).alias("w")), centre


#: Scores that a task makes at once.
CHUNK = 250_000


def _directed(rows: DataFrame, w: DataFrame, first: int, n: int) -> DataFrame:
    """``perm, y, score`` of every row of ``_f, u, y`` (a label a shuffle) by the directions ``perm, _f, w`` of its fold; 0 without one."""
    ship(rows.sparkSession)
    found: dict[str, dict[int, np.ndarray]] = {}
    for r in w.toLocalIterator():
        if r.w is not None and None not in r.w:
            found.setdefault(r._f, {})[r.perm - first] = np.array(r.w)
    sent = rows.sparkSession.sparkContext.broadcast({f: (np.array(list(at)), np.array(list(at.values()))) for f, at in found.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, max(1, CHUNK // n)):
                part = batch.slice(k, max(1, CHUNK // n))
                fold, known = np.array(part.column(0).to_pylist()), part.column(1).is_valid().to_numpy(zero_copy_only=False)
                score = np.zeros((part.num_rows, n))
                for f, (at, directions) in sent.value.items():
                    own = np.flatnonzero((fold == f) & known)
                    if len(own):
                        u = part.column(1).take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                        score[np.ix_(own, at)] = np.nan_to_num(np.round(u @ directions.T, 12), nan=0.0, posinf=np.inf, neginf=-np.inf)
                y = part.column(2).flatten()
                perm = np.tile(np.arange(first, first + n, dtype=np.int32), part.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(perm), y, pa.array(score.ravel())], ["perm", "y", "score"])

    return rows.mapInArrow(run, "perm int, y double, score double")


def refit_permutation(
    rows: DataFrame, vector: str, label: str, group: str, folds: str, ctx: Context, strata: str | None = None, model: str = "centroid",
    hyper: float | None = None, id_col: str = "id",
) -> DataFrame:
    """p of a model's out-of-fold area against models refitted on shuffled labels: ``auroc, p, null_mean, n_perm``.

    Models other than ``centroid`` are refitted by ``operators.refits``.  0/1 labels of whole groups are shuffled, within ``strata`` if given; each
    shuffle fits every fold anew and is scored against its own labels, as the
    true labels are.  Rows without label, vector, group or fold are left out; a
    fold that is fitted without one of the classes scores 0.  All refits are one
    plan a block of shuffles, whose directions are broadcast up to ``BLOCK``
    numbers; every row is scored once a shuffle.
    """
    if model != "centroid":
        return X.refit_null(rows, vector, label, group, folds, model, ctx.n_perm, ctx.seed, strata, hyper, id_col if model == "knn" else None)
    rows = rows.filter(" and ".join(f"`{c}` is not null" for c in (vector, label, group, folds)))
    true = rows.groupBy(group).agg(F.min(label).alias(label)).select(F.lit(-1).alias("perm"), group, label)
    labels = true.unionByName(R.permutations(rows, group, label, ctx.n_perm, strata, ctx.seed))
    size = rows.agg(F.countDistinct(folds).alias("f"), F.max(F.size(vector)).alias("d")).first()
    step = max(1, BLOCK // max(1, size.f * (size.d or 1)))
    areas = []
    for first in range(-1, ctx.n_perm, step):
        some = labels.filter((F.col("perm") >= first) & (F.col("perm") < first + step))
        w, c = _centroid_directions(rows, some, vector, label, group, folds)
        seen = rows.join(F.broadcast(c), folds).select(group, F.col(folds).cast("string").alias("_f"), A.unit(A.minus(A.doubles(F.col(vector)), F.col("c"))).alias("u"))
        drawn = some.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("perm", F.col(label).cast("double").alias("y")))).alias("_y"))
        both = seen.join(drawn, group).select("_f", "u", F.transform("_y", lambda s: s["y"]).alias("y"))
        scored = _directed(both, w.select("perm", F.col(folds).cast("string").alias("_f"), "w"), first, min(ctx.n_perm, first + step) - first)
        areas.append(M.auroc(scored, "y", "score", "perm"))
    found = reduce(lambda a, b: a.unionByName(b), areas)
    real = F.max(F.when(F.col("perm") < 0, F.col("auroc")))
    one = found.agg(real.alias("auroc"), F.collect_list(F.when(F.col("perm") >= 0, F.col("auroc"))).alias("null"))
    above = F.size(F.filter("null", lambda a: a >= F.col("auroc") - 1e-12))
    n = F.size("null")
    return one.select("auroc", ((1 + above) / (1 + n)).alias("p"), F.try_divide(A.total(F.col("null")), n).alias("null_mean"), n.alias("n_perm"))


def leave_pair_out_task(rows: DataFrame, analyte: str, label: str, model: str, ctx: Context, max_pairs: int | None = None) -> DataFrame:
    """Hold out each positive with each negative analyte: ``pos, neg, pos_score, neg_score, win``.

    Centroid models of all pairs are one plan (``operators.pairs_out``); of other models a pair is one fit.
    ``max_pairs`` is for trial runs: only so many pairs, in order, are held out; None holds out all.
    """
    if model == "centroid" and max_pairs is None:
        from prismal.operators.pairs_out import centroid_pairs

        return centroid_pairs(rows, "v", label, analyte).drop("perm")
    pairs = R.leave_pair_out(rows, analyte, label).orderBy("pos", "neg").collect()
    parts = []
    for p in pairs[:max_pairs]:
        out = F.col(analyte).isin(p.pos, p.neg)
        scored = E.make(model)(rows.filter(~out), "v", label).apply(rows.filter(out)).groupBy(analyte).agg(F.avg("score").alias("s"))
        pick = lambda a: F.max(F.when(F.col(analyte) == a, F.col("s")))
        parts.append(scored.agg(F.lit(p.pos).alias("pos"), F.lit(p.neg).alias("neg"), pick(p.pos).alias("pos_score"), pick(p.neg).alias("neg_score")))
    return R.pair_wins(reduce(lambda a, b: a.unionByName(b), parts))


def testable(df: DataFrame, analyte: str, labels: list[str], min_analytes: int = 2, min_rows: int = 5) -> DataFrame:
    """Which labels have enough analytes and rows on both sides: ``label, ok, reason``."""
    parts = []
    for name in labels:
        on = F.coalesce(F.col(name), F.lit(0)) > 0
        parts.append(df.agg(F.lit(name).alias("label"), F.countDistinct(F.when(on, F.col(analyte))).alias("ap"), F.countDistinct(F.when(~on, F.col(analyte))).alias("an"), F.count_if(on).alias("rp"), F.count_if(~on).alias("rn")))
    t = reduce(lambda a, b: a.unionByName(b), parts)
    reason = F.concat_ws("; ", F.when(F.least("ap", "an") < min_analytes, F.format_string("%d and %d analytes", "ap", "an")), F.when(F.least("rp", "rn") < min_rows, F.format_string("%d and %d rows", "rp", "rn")))
    return t.select("label", (reason == "").alias("ok"), F.nullif(reason, F.lit("")).alias("reason"))


def design_features(df: DataFrame, categories: dict[str, list[str]], numbers: list[str]) -> DataFrame:
    """A vector of one-hot design columns and numbers, missing ones at the column's median: adds ``v``."""
    med = df.agg(*(F.percentile(F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast("double")), F.lit(0.5)).alias(f"_m_{n}") for n in numbers)) if numbers else None
    rows = df.crossJoin(F.broadcast(med)) if med is not None else df
    hot = [(F.col(c).eqNullSafe(F.lit(v))).cast("double") for c, values in categories.items() for v in values]
    num = [F.coalesce(F.nanvl(F.col(n).cast("double"), F.col(f"_m_{n}")), F.col(f"_m_{n}"), F.lit(0.0)) for n in numbers]
    return rows.withColumn("v", F.array(*hot, *num)).drop(*(f"_m_{n}" for n in numbers))


def signatures(df: DataFrame, vector: str, analyte: str, strain: str) -> DataFrame:
    """Detectability: each strain's class signature (class mean less strain mean) against the other strains' mean signatures.

    Columns ``analyte, strain, correlation, match_rank``: the correlation with the
    same class elsewhere and the rank it has among all classes.
    """
    from prismal.operators import vectors as V

    long = V.explode_vector(df, vector, [analyte, strain])
    cls = long.groupBy(strain, analyte, "k").agg(F.avg("v").alias("m"))
    base = long.groupBy(strain, "k").agg(F.avg("v").alias("b"))
    sig = cls.join(base, [strain, "k"]).select(strain, analyte, "k", (F.col("m") - F.col("b")).alias("s"))
    sums = sig.groupBy(analyte, "k").agg(F.sum("s").alias("t"), F.count("*").alias("n"))
    other = sums.select(F.col(analyte).alias("other"), "k", "t", "n")
    both = sig.join(other, "k").join(sig.select(strain, F.col(analyte).alias("other"), "k", F.col("s").alias("own")), [strain, "other", "k"], "left")
    rest = F.try_divide(F.col("t") - F.coalesce("own", F.lit(0.0)), F.col("n") - F.when(F.col("own").isNotNull(), 1).otherwise(0))
    r = both.withColumn("rest", rest).groupBy(analyte, strain, "other").agg(A.correlation("s", "rest").alias("r"))
    ranked = r.withColumn("match_rank", F.rank().over(W.partitionBy(analyte, strain).orderBy(F.desc_nulls_last(F.round("r", 9)))))
    return ranked.filter(F.col("other") == F.col(analyte)).select(analyte, strain, F.col("r").alias("correlation"), "match_rank")


def degradation(metrics: DataFrame, rung: str = "rung", method: str = "method", value: str = "value") -> DataFrame:
    """Mean over labels per rung and method, rungs by their number; centred rows are kept apart by their own column."""
    from prismal.functions.ids import rung_key

    keys = [rung, method] + (["centred"] if "centred" in metrics.columns else [])
    return metrics.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n_labels")).withColumn("rung_no", rung_key(F.col(rung)))


def transfer(metrics: DataFrame, first: str, last: str, rung: str = "rung", label: str = "label", value: str = "value") -> DataFrame:
    """In-domain against last-rung value of every label: ``label, first, last, drop``."""
    pick = lambda r: F.max(F.when(F.col(rung) == r, F.col(value)))
    return metrics.groupBy(label).agg(pick(first).alias("first"), pick(last).alias("last")).withColumn("drop", F.col("first") - F.col("last"))


def layer_sweep(metrics: DataFrame, label: str = "label", layer: str = "layer", value: str = "value") -> DataFrame:
    """Best value per label and layer."""
    return metrics.groupBy(label, layer).agg(F.max(value).alias("best"))


def select_layer(validation: DataFrame, keys=("method", "position"), layer: str = "layer", value: str = "value") -> DataFrame:
    """Layer with the best mean validation value per key; the lowest wins ties. Shifted rungs play no part."""
    mean = validation.groupBy(*keys, layer).agg(F.avg(value).alias("mean"))
    w = W.partitionBy(*keys).orderBy(F.desc(F.round("mean", 9)), layer)
    return mean.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def string_loss(metrics: DataFrame, richer: str = "F3", poorer: str = "F2", label: str = "label") -> DataFrame:
    """Best value with the full signal less that with redrawn text, per label, largest loss first."""
    from prismal.functions.ids import family

    best = lambda f: F.max(F.when(family(F.col("feature"), f) & (F.col("model") != "majority"), F.col("value")))
    return metrics.groupBy(label).agg(best(richer).alias("richer"), best(poorer).alias("poorer")).withColumn("loss", F.col("richer") - F.col("poorer")).orderBy(F.desc("loss"), label)


def nested_accuracy(df: DataFrame, subsets: dict[str, object], correct: str) -> DataFrame:
    """Accuracy on several overlapping subsets in one pass: ``subset, n, accuracy``."""
    one = df.agg(*(F.count_if(c).alias(f"n_{k}") for k, c in subsets.items()), *(F.avg(F.when(c, F.col(correct).cast("double"))).alias(f"a_{k}") for k, c in subsets.items()))
    rows = F.array(*(F.struct(F.lit(k).alias("subset"), F.col(f"n_{k}").alias("n"), F.col(f"a_{k}").alias("accuracy")) for k in subsets))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def gate(rows: DataFrame, metric: str, chance: float) -> DataFrame:
    """Whether a lower bound lies above chance: ``*keys, passes``."""
    return rows.filter(F.col("metric") == metric).withColumn("passes", F.coalesce(F.col("lo") > chance, F.lit(False)))
