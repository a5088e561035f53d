"""Classifiers behind one registry: fit on a training DataFrame, score another.

``make(name)`` gives majority, centroid, knn, logistic, pca_logistic, boosting
or plsda.  Each has ``fit(train, vector, label)`` and the fitted model
``score(df, vector, id_col) -> id, pred, score``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismal.functions import arrays as A
from prismal.operators import linear as L
from prismal.operators import vectors as V

#: Fixed values of the hyperparameter grids and defaults.
GRIDS = {"logistic": [0.01, 0.1, 1.0, 10.0], "plsda": [2, 5, 10, 15], "knn": [1, 3, 5, 10]}
DEFAULTS = {"logistic": 0.1, "plsda": 10, "knn": 5}


@dataclass
class Fitted:
    """A fitted model: ``apply`` adds ``pred`` and ``score``."""

    apply: Callable[[DataFrame], DataFrame]
    classes: list = field(default_factory=list)

    def score(self, df: DataFrame, id_col: str = "id") -> DataFrame:
        return self.apply(df).select(F.col(id_col).alias("id"), "pred", "score")


def _classes(df: DataFrame, label: str) -> list:
    return [r[0] for r in df.select(label).dropna().distinct().orderBy(label).collect()]


def fit_majority(train: DataFrame, vector: str, label: str, **_) -> Fitted:
    """The commonest class and, for 0/1 labels, the rate of 1; ties to the smallest."""
    c = train.filter(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.desc("count"), label).collect()
    n, top = sum(r["count"] for r in c), c[0][label]
    rate = next((r["count"] for r in c if r[label] == 1), 0) / n
    return Fitted(lambda df: df.withColumn("pred", F.lit(top)).withColumn("score", F.lit(rate)), sorted(r[label] for r in c))


def fit_logistic(train: DataFrame, vector: str, label: str, c: float = 0.1, pca: float | None = None, **_) -> Fitted:
    """L2 logistic regression on standardised vectors, classes weighted equally; with ``pca`` on the components of that share of variance.

    ``c`` is the inverse strength for a summed loss: regParam = 1 / (c n).
    """
    classes = _classes(train, label)
    rows = train.filter(F.col(label).isNotNull()).withColumn("_x", array_to_vector(A.doubles(F.col(vector))))
    n = rows.count()
    per = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    if len(classes) < 2:
        only = classes[0] if classes else None
        return Fitted(lambda df: df.withColumn("pred", F.lit(only)).withColumn("score", F.lit(float(only == 1))), classes)
    code = F.create_map(*[x for i, k in enumerate(classes) for x in (F.lit(k), F.lit(float(i)))])
    weight = F.create_map(*[x for k in classes for x in (F.lit(k), F.lit(n / (len(classes) * per[k])))])
    scaler = StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True).fit(rows)
    steps = [scaler]
    ready = scaler.transform(rows)
    column = "_z"
    if pca:
        width = ready.select(F.size(vector)).first()[0]
        full = PCA(k=min(width, max(1, n - 1)), inputCol="_z", outputCol="_c").fit(ready)
        k = int(np.searchsorted(np.cumsum(full.explainedVariance.toArray()), pca)) + 1
        model = PCA(k=min(k, min(width, max(1, n - 1))), inputCol="_z", outputCol="_c").fit(ready)
        steps.append(model)
        ready, column = model.transform(ready), "_c"
    ready = ready.withColumn("_y", code[F.col(label)]).withColumn("_w", weight[F.col(label)])
    lr = LogisticRegression(featuresCol=column, labelCol="_y", weightCol="_w", regParam=1 / (c * n), standardization=False, maxIter=300, tol=1e-8, predictionCol="_p", probabilityCol="_q", rawPredictionCol="_r")
    steps.append(lr.fit(ready))
    names = F.array(*(F.lit(k) for k in classes))
    at = classes.index(1) if 1 in classes else len(classes) - 1

    def apply(df: DataFrame) -> DataFrame:
        out = df.withColumn("_x", array_to_vector(A.doubles(F.col(vector))))
        for s in steps:
            out = s.transform(out)
        return out.withColumn("pred", F.get(names, F.col("_p").cast("int"))).withColumn("score", F.get(vector_to_array("_q"), F.lit(at))).drop("_x", "_z", "_c", "_p", "_q", "_r")

    return Fitted(apply, classes)


def fit_boosting(train: DataFrame, vector: str, label: str, rounds: int = 30, **_) -> Fitted:
    """Gradient-boosted trees; more than two classes one against the rest."""
    classes = _classes(train, label)
    code = F.create_map(*[x for i, k in enumerate(classes) for x in (F.lit(k), F.lit(float(i)))])
    rows = train.filter(F.col(label).isNotNull()).withColumn("_x", array_to_vector(A.doubles(F.col(vector)))).withColumn("_y", code[F.col(label)])
    gbt = GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=rounds, maxDepth=4, predictionCol="_p", seed=0)
    two = len(classes) == 2
    model = gbt.fit(rows) if two else OneVsRest(classifier=gbt, featuresCol="_x", labelCol="_y", predictionCol="_p").fit(rows)
    names = F.array(*(F.lit(k) for k in classes))

    def apply(df: DataFrame) -> DataFrame:
        out = model.transform(df.withColumn("_x", array_to_vector(A.doubles(F.col(vector)))))
        score = F.get(vector_to_array("probability"), F.lit(1)) if two else F.lit(None).cast("double")
        return out.withColumn("pred", F.get(names, F.col("_p").cast("int"))).withColumn("score", score).drop("_x", "_p", "rawPrediction", "probability")

    return Fitted(apply, classes)


def pls_coefficients(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean of x, coefficients, mean of y) of a PLS regression of ``k`` components on scaled columns."""
    sd = x.std(0, ddof=1) if len(x) > 1 else np.ones(x.shape[1])
    use = sd > 1e-12
    mx, my = x.mean(0), y.mean(0)
    e, f = np.where(use, (x - mx) / np.where(use, sd, 1), 0.0), y - my
    ws, ps, qs = [], [], []
    for _ in range(min(k, int(use.sum()), max(1, len(x) - 1))):
        u, s, _ = np.linalg.svd(e.T @ f, full_matrices=False)
        if not s[0] > 1e-12:
            break
        w = u[:, 0]
        t = e @ w
        p, q = e.T @ t / (t @ t), f.T @ t / (t @ t)
        e, f = e - np.outer(t, p), f - np.outer(t, q)
        ws.append(w), ps.append(p), qs.append(q)
    if not ws:
        return mx, np.zeros((x.shape[1], y.shape[1])), my
    w, p, q = (np.array(a).T for a in (ws, ps, qs))
    coef = w @ np.linalg.pinv(p.T @ w) @ q.T
    return mx, np.where(use, 1 / np.where(use, sd, 1), 0)[:, None] * coef, my


def fit_plsda(train: DataFrame, vector: str, label: str, k: int = 10, **_) -> Fitted:
    """PLS regression on one-hot classes, the largest response wins; fitted on X'X and X'Y of all rows, which one pass adds up."""
    classes = _classes(train, label)
    hot = [F.col(label).eqNullSafe(F.lit(c)).cast("int").alias(f"_y{i}") for i, c in enumerate(classes)]
    rows = train.filter(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(A.doubles(F.col(vector)).alias("x"), F.lit(0).alias("fold"), *hot)
    pivot, parts = L.cross_products(rows, L.given)
    mx, coef, my = L.pls_from_sums(*L.outside(parts, None), k)
    mx = mx + pivot
    names = F.array(*(F.lit(c) for c in classes))

    def apply(df: DataFrame) -> DataFrame:
        v = F.zip_with(A.doubles(F.col(vector)), F.array(*(F.lit(float(m)) for m in mx)), lambda a, b: a - b)
        raw = F.array(*(A.dot(v, F.array(*(F.lit(float(c)) for c in coef[:, j]))) + float(my[j]) for j in range(len(classes))))
        out = df.withColumn("_raw", raw).withColumn("_pos", F.transform("_raw", lambda r: F.greatest(r, F.lit(1e-6))))
        one = classes.index(1) if 1 in classes else len(classes) - 1
        return out.withColumn("pred", F.get(names, F.array_position("_raw", F.array_max("_raw")).cast("int") - 1)).withColumn("score", F.get("_pos", F.lit(one)) / A.total(F.col("_pos"))).drop("_raw", "_pos")

    return Fitted(apply, classes)


def fit_centroid(train: DataFrame, vector: str, label: str, **_) -> Fitted:
    """Class means after the training mean is taken off; the largest cosine wins, ties to the smallest class."""
    classes = _classes(train, label)
    means = V.mean_vectors(train, vector, label).select(F.col(label).alias("pred"), "mean")
    centre = V.mean_vectors(train, vector, []).select(F.col("mean").alias("_c"))

    def apply(df: DataFrame) -> DataFrame:
        unit = lambda m: A.unit(A.minus(m, F.col("_c")))
        each = means.crossJoin(centre).agg(F.array_sort(F.collect_list(F.struct("pred", unit(F.col("mean")).alias("m")))).alias("_all"))
        rows = df.crossJoin(F.broadcast(centre)).crossJoin(F.broadcast(each)).withColumn("_u", unit(A.doubles(F.col(vector))))
        sims = F.transform("_all", lambda s: F.struct((-F.round(A.dot(F.col("_u"), s["m"]), 12)).alias("d"), s["pred"].alias("pred")))
        rows = rows.withColumn("_s", sims).withColumn("_b", F.array_min("_s"))
        of = lambda k: F.get(F.filter("_s", lambda s: s["pred"] == k), F.lit(0))["d"]
        # for 0/1 labels the score ranks by class 1, else it is the winner's similarity
        score = of(0) - of(1) if classes == [0, 1] else -F.col("_b.d")
        return rows.withColumn("pred", F.col("_b.pred")).withColumn("score", score).drop("_c", "_all", "_u", "_b", "_s")

    return Fitted(apply, classes)


def fit_knn(train: DataFrame, vector: str, label: str, k: int = 5, **_) -> Fitted:
    """Cosine neighbours with inverse-distance votes; rows to score need a long ``id``."""

    def apply(df: DataFrame) -> DataFrame:
        near = V.cosine_neighbours(df, train, vector, "id", k, [label])
        return df.join(V.neighbour_vote(near, label).withColumnRenamed("query_id", "id"), "id").withColumn("score", F.lit(None).cast("double"))

    return Fitted(apply, _classes(train, label))


MODELS: dict[str, Callable[..., Fitted]] = {
    "majority": fit_majority, "logistic": fit_logistic, "pca_logistic": lambda *a, **k: fit_logistic(*a, pca=0.95, **k),
    "boosting": fit_boosting, "plsda": fit_plsda, "centroid": fit_centroid, "knn": fit_knn,
}


def make(name: str) -> Callable[..., Fitted]:
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; there are {', '.join(sorted(MODELS))}")
    return MODELS[name]


def out_of_fold(df: DataFrame, folds: DataFrame, group: str, model: str, vector: str, label: str, id_col: str = "id", **hp) -> DataFrame:
    """Scores of every row by the model that has not seen its fold: ``id, pred, score, fold``."""
    rows = df.join(folds, group)
    parts = []
    for k in [r.fold for r in folds.select("fold").distinct().orderBy("fold").collect()]:
        fitted = make(model)(rows.filter(F.col("fold") != k), vector, label, **hp)
        parts.append(fitted.score(rows.filter(F.col("fold") == k), id_col).withColumn("fold", F.lit(k)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
