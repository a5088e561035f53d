"""The four evaluation tasks, hyperparameter choice and the controls around them.

Tables come as features ``id, feature, v`` and records with labels; every task
returns long metric rows that name task, variant and scheme.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prismal.functions import ids as I
from prismal.operators import bootstraps as B
from prismal.operators import checks as Q
from prismal.operators import estimators as E
from prismal.operators import metrics as M
from prismal.operators import physics as P
from prismal.operators import resample as R
from prismal.operators import vectors as V
from prismal.plans import experiments as X


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def choose(rows: DataFrame, model: str, label: str, group: str, grid: list | None = None, k: int = 5, seed: int = 0) -> tuple[object, float, str]:
    """(hyperparameter, threshold, source) by grouped inner folds on training rows only.

    The value with the best pooled score wins, the first of equals; the threshold
    maximises balanced accuracy of the pooled out-of-fold scores.  A model
    without a grid, or rows that cannot be folded, take the default.
    """
    grid = E.GRIDS.get(model) if grid is None else grid
    default = E.DEFAULTS.get(model)
    folds = R.group_folds(rows, group, label, k, seed)
    if not grid or not folds.limit(1).count():
        return default, 0.5, "fixed" if not grid else "default"
    name = {"logistic": "c", "plsda": "k", "knn": "k"}[model]
    best = None
    for value in grid:
        out = E.out_of_fold(rows, folds, group, model, "v", label, **{name: value}).join(rows.select("id", F.col(label).alias("_y")), "id").cache()
        binary = not out.filter(~F.col("_y").cast("string").isin("0", "1")).limit(1).count() and model != "knn"
        score = M.auroc(out, "_y", "score").first().auroc if binary else M.multiclass_report(out, "_y", "pred").first().balanced_accuracy
        if best is None or (score or 0) > best[0] + 1e-12:
            t = M.best_threshold(out, "_y", "score").first().threshold if binary else 0.5
            best = (score or 0, value, t)
    return best[1], best[2], "inner_cv"


def leave_one_strain_out(records: DataFrame, features: DataFrame, ctx: X.Context, label: str = "analyte") -> DataFrame:
    """T1: classify analytes of cells, each strain held out in turn; majority and metadata-free rows share the code path."""
    rows = features.join(records.filter("kind = 'cell'").select("id", "grp", label, I.strain(F.col("id")).alias("strain")).dropna(), "id")
    pred = X.predictions([X.Spec("cells", rows, label, "grp", folds="strain", binary=False)], ctx)
    return X.metric_rows(pred, ctx, binary=False).withColumn("task", F.lit("T1")).withColumn("scheme", F.lit("leave_one_strain_out"))


def standards_from_cells(records: DataFrame, features: DataFrame, ctx: X.Context, label: str = "analyte") -> DataFrame:
    """T1: train on cells, test on standards of the analytes that both have."""
    both = features.join(records.filter("kind in ('cell', 'standard')").select("id", "grp", "kind", label).dropna(), "id")
    shared = both.filter("kind = 'cell'").select(label).intersect(both.filter("kind = 'standard'").select(label))
    rows = both.join(F.broadcast(shared), label, "left_semi")
    pred = X.predictions([X.Spec("standards", rows.filter("kind = 'cell'"), label, "grp", test=rows.filter("kind = 'standard'"), binary=False)], ctx)
    return X.metric_rows(pred, ctx, binary=False).withColumn("task", F.lit("T1")).withColumn("scheme", F.lit("cells_to_standards"))


def metadata_only(records: DataFrame, ctx: X.Context, categories: dict[str, list[str]], numbers: list[str], label: str = "analyte", folds: str = "strain") -> DataFrame:
    """Confound: predict the label from design and acquisition columns alone."""
    rows = X.design_features(records, categories, numbers).withColumn("feature", F.lit("META"))
    pred = X.predictions([X.Spec("metadata", rows, label, "grp", folds=folds, binary=False)], X.Context(ctx.n_boot, ctx.n_perm, ctx.seed, ("META",), ctx.models))
    return X.metric_rows(pred, ctx, binary=False).withColumn("scheme", F.lit("metadata_only"))


def substrate_only(train: DataFrame, blanks: DataFrame, model: str, label: str) -> DataFrame:
    """Control: a model of analyte rows predicts the blanks of the same conditions; one check row."""
    fitted = E.make(model)(train, "v", label)
    classes = train.select(label).distinct().count()
    return Q.blank_control(fitted.apply(blanks), label, "pred", 1 / max(1, classes))


def leave_pair_out(records: DataFrame, features: DataFrame, labels: list[str], ctx: X.Context, model: str = "logistic", n_boot: int = 1000) -> DataFrame:
    """T2: mean win rate of every testable label with its interval: ``label, value, lo, hi, n_pairs``."""
    import numpy as np

    rows = features.filter(F.col("feature") == ctx.features[0]).join(records.filter("kind <> 'substrate_only'").select("id", "analyte", *labels), "id").cache()
    spark, out = records.sparkSession, []
    for t in X.testable(rows, "analyte", labels).filter("ok").collect():
        wins = X.leave_pair_out_task(rows.withColumn("y", F.coalesce(F.col(t.label), F.lit(0))), "analyte", "y", model, ctx).collect()
        pos, neg = sorted({w.pos for w in wins}), sorted({w.neg for w in wins})
        m = np.array([[next(w.win for w in wins if w.pos == a and w.neg == b) for b in neg] for a in pos])
        out.append((t.label, *R.pair_ci(m, n_boot, ctx.seed), len(wins)))
    return spark.createDataFrame(out, "label string, value double, lo double, hi double, n_pairs int")


def in_domain(records: DataFrame, features: DataFrame, labels: list[str], ctx: X.Context, group: str = "grp", scaffold: str | None = None, test_share: float = 0.2) -> DataFrame:
    """T3: labels of simulated records by a random and, with a scaffold column, a scaffold split."""
    if scaffold:
        rows = records.drop("split").join(R.set_split(records, scaffold, test_share), scaffold)
    else:
        rows = records.withColumn("split", F.when(R.draw(group, seed=ctx.seed) < test_share, "test").otherwise("train"))
    parts = []
    for name in labels:
        y = rows.select("id", F.col(group).alias("grp"), "split", F.coalesce(F.col(name), F.lit(0)).alias("y"))
        n = y.groupBy("split").agg(F.sum("y").alias("n")).collect()
        if len(n) < 2 or min(r.n for r in n) < ctx.min_positives:
            continue
        f = features.join(y, "id")
        pred = X.predictions([X.Spec(name, f.filter("split = 'train'"), "y", "grp", test=f.filter("split = 'test'"))], ctx)
        parts.append(X.metric_rows(pred, ctx).withColumn("label", F.lit(name)))
    if not parts:
        return records.sparkSession.createDataFrame([], "spec string, feature string, model string, metric string, value double, lo double, hi double, n_ok long, label string, task string, scheme string")
    return _union(parts).withColumn("task", F.lit("T3")).withColumn("scheme", F.lit("scaffold" if scaffold else "random"))


def across_domains(train_records: DataFrame, test_records: DataFrame, features: DataFrame, labels: list[str], ctx: X.Context) -> DataFrame:
    """T4: train in one domain, test in another, per label; ``low_support`` marks fewer than three analytes on a side."""
    parts = []
    for name in labels:
        y = lambda df: df.select("id", F.coalesce("analyte", "id").alias("grp"), F.coalesce(F.col(name), F.lit(0)).alias("y"))  # noqa: B023, E731
        tr, te = features.join(y(train_records), "id"), features.join(y(test_records), "id")
        sides = te.groupBy("y").agg(F.countDistinct("grp").alias("k")).collect()
        if len(sides) < 2:
            continue
        pred = X.predictions([X.Spec(name, tr, "y", "grp", test=te)], ctx)
        parts.append(X.metric_rows(pred, ctx).withColumn("label", F.lit(name)).withColumn("low_support", F.lit(min(r.k for r in sides) < 3)))
    return _union(parts).withColumn("task", F.lit("T4")).withColumn("scheme", F.lit("shifted"))


def per_analyte(pred: DataFrame, analytes: DataFrame) -> DataFrame:
    """Mean score, share predicted positive and rank of every analyte: ``spec, feature, model, analyte, score, positive, rank``."""
    per = pred.join(analytes.select(F.col("id").cast("string").alias("id"), "analyte"), "id").groupBy(*X.KEY, "analyte").agg(F.avg("score").alias("score"), F.avg((F.col("pred") == "1").cast("double")).alias("positive"))
    return per.withColumn("rank", F.row_number().over(W.partitionBy(*X.KEY).orderBy(F.desc("score"), "analyte")))


def per_class(pred: DataFrame) -> DataFrame:
    """Recall of every class by spec, feature and model."""
    return M.class_recall(pred, "y", "pred", X.KEY)


def shuffled_labels(rows: DataFrame, label: str, group: str, model: str, n_perm: int, seed: int = 0) -> DataFrame:
    """Grouped cross-validated accuracy with the labels shuffled: ``perm, accuracy``."""
    folds = R.group_folds(rows, group, label, 3, seed)
    perm = R.permutations(rows, group, label, n_perm, None, seed).withColumnRenamed(label, "_y").cache()
    parts = []
    for k in range(n_perm):
        shuffled = rows.join(perm.filter(F.col("perm") == k).drop("perm"), group)
        out = E.out_of_fold(shuffled, folds, group, model, "v", "_y").join(shuffled.select("id", "_y"), "id")
        parts.append(out.agg(F.lit(k).alias("perm"), F.avg((F.col("pred") == F.col("_y")).cast("double")).alias("accuracy")))
    return _union(parts)


def twin_agreement(scores: DataFrame, first: str, second: str, least: int = 4) -> DataFrame:
    """Mean rank correlation of two rungs' scores over common analytes, labels with at least ``least``: ``rho, n_labels``."""
    a = scores.filter(F.col("rung") == first).select("label", "analyte", F.col("score").alias("a"))
    b = scores.filter(F.col("rung") == second).select("label", "analyte", F.col("score").alias("b"))
    return P.rank_correlation(a.join(b, ["label", "analyte"]), "a", "b", "label").filter(F.col("n") >= least).agg(F.avg("rho").alias("rho"), F.count("rho").alias("n_labels"))


def mean_area_ci(scores: DataFrame, n_boot: int = 1000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Mean area over labels with the same analytes drawn for all of them: ``mean, lo, hi, n_ok`` of ``label, analyte, y, score``."""
    here = M.auroc(scores, "y", "score", "label").agg(F.avg("auroc").alias("mean"))
    means = B.area_replicates(scores, "analyte", "y", "score", n_boot, seed, "label").groupBy("rep").agg(F.avg("auroc").alias("mean"))
    return here.crossJoin(R.interval(means, "mean", n_boot, alpha))


def detectability(df: DataFrame, vector: str, analyte: str, strain: str, axis: list[float], recall: DataFrame, bands: int = 3, gap: float = 10.0) -> DataFrame:
    """Signature match across strains with the class's recall, its signal against the spread within strains, and its strongest separated bands."""
    from prismal.functions import signal as S

    sig = X.signatures(df, vector, analyte, strain).groupBy(analyte).agg(F.avg("correlation").alias("correlation"), F.avg("match_rank").alias("match_rank"))
    long = V.explode_vector(df, vector, [analyte, strain])
    cell = long.groupBy(analyte, strain, "k").agg(F.avg("v").alias("m"), F.coalesce(F.stddev_pop("v"), F.lit(0.0)).alias("s"))
    base = long.groupBy(strain, "k").agg(F.avg("v").alias("b"))
    mean = cell.join(base, [strain, "k"]).groupBy(analyte, "k").agg(F.avg(F.col("m") - F.col("b")).alias("v"), F.avg("s").alias("s"))
    vec = V.gather_vector(mean.select(analyte, "k", "v"), [analyte], "sig").join(mean.groupBy(analyte).agg(F.try_divide(F.max(F.abs("v")), F.avg("s")).alias("snr")), analyte)
    top = F.transform(S.separated_top(F.col("sig"), {}, bands, gap, axis), lambda b: b["position"])
    return vec.select(analyte, "snr", top.alias("bands")).join(sig, analyte).join(recall.select(F.col("label").alias(analyte), "recall"), analyte, "left")


def band_table(rows: DataFrame, vector: str, axis: list[float], positions: list[float], half: int = 3) -> DataFrame:
    """Per reference band: percentiles and relative spread of the local maxima: ``position, p10, p50, p90, cv``."""
    places = F.array(*(F.struct(F.lit(p).alias("position"), F.lit(max(1, min(range(len(axis)), key=lambda i: abs(axis[i] - p)) + 1 - half)).alias("at")) for p in positions))
    each = rows.select(F.col(vector).alias("_v"), F.explode(places).alias("b")).select("b.position", F.array_max(F.slice("_v", F.col("b.at"), F.lit(2 * half + 1))).alias("m"))
    return each.groupBy("position").agg(*(F.percentile("m", F.lit(q)).alias(n) for n, q in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))), F.try_divide(F.stddev_pop("m"), F.avg("m")).alias("cv"))


def inspect_blanks(rows: DataFrame, cfg: dict, good: DataFrame) -> DataFrame:
    """Verdict on every blank ``id, y``: ok, shifted, weak or absent, by its band near the reference and its correlation with the good mean."""
    from prismal.functions import arrays as A
    from prismal.functions import signal as S

    r = cfg["substrate"]["reference_norm"]
    wide = cfg | {"substrate": cfg["substrate"] | {"reference_norm": r | {"ref_tol": 3 * r["ref_tol"]}}}
    out = rows.withColumn("_n", S.reference(F.col("y"), cfg)).withColumn("_w", S.reference(F.col("y"), wide)).crossJoin(F.broadcast(good.select(F.col("mean").alias("_g"))))
    centred = lambda c: F.transform(c, lambda v: v - A.total(c) / F.size(c))
    corr = A.cosine(centred(F.col("y")), centred(F.col("_g")))
    verdict = F.when(F.col("_n.height").isNotNull(), F.when(corr >= cfg["substrate"]["generic_cb"]["min_corr"], "ok").otherwise("weak")).when(F.col("_w.height").isNotNull(), "shifted").otherwise("absent")
    return out.select("id", F.col("_w.position").alias("band"), corr.alias("correlation"), verdict.alias("verdict"))


def band_ratios(peaks: DataFrame, reference: DataFrame, share: float = 0.04) -> DataFrame:
    """Nearest peak within a share of each reference band: ``name, band, position, ratio``; ``reference`` has ``name, band``."""
    p = peaks.select("name", F.explode("peaks").alias("p")).select("name", F.col("p.position").alias("position"))
    both = reference.join(p, "name").filter(F.abs(F.col("position") - F.col("band")) <= share * F.col("band"))
    w = W.partitionBy("name", "band").orderBy(F.abs(F.col("position") - F.col("band")), "position")
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("name", "band", "position", (F.col("band") / F.col("position")).alias("ratio"))
