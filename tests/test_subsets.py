"""Metrics by subset and by vote, with intervals, against resamples made one by one."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismal.operators import resample as R
from prismal.operators.subsets import subset_metrics, votes

RNG = np.random.default_rng(8)


def weights(groups, n_boot, seed):
    names = sorted(set(groups), key=lambda g: (hashlib.md5(g.encode()).hexdigest()[:15], g))
    at = R.drawn(np.arange(n_boot)[:, None], np.arange(len(names))[None, :], len(names), seed)
    mult = [dict(zip(names, np.bincount(a, minlength=len(names)))) for a in at]
    return [np.array([m[g] for g in groups], float) for m in mult]


def scores(y, pred, w, classes=None):
    """accuracy, balanced accuracy, macro F1 by hand."""
    recall, f1 = [], []
    for c in sorted(set(y[w > 0])):
        n, hit, said = w[y == c].sum(), w[(y == c) & (pred == c)].sum(), w[pred == c].sum()
        recall.append(hit / n)
        f1.append(2 * hit / (n + said))
    if classes and len(recall) < classes:
        return {"balanced_accuracy": None}
    return {"accuracy": w[y == pred].sum() / w.sum(), "balanced_accuracy": np.mean(recall), "macro_f1": np.mean(f1)}


def area(y, s, w):
    a, b = y == 1, y == 0
    won = (s[a][:, None] > s[b]) + (s[a][:, None] == s[b]) / 2
    d = w[a].sum() * w[b].sum()
    return (won * w[a][:, None] * w[b]).sum() / d if d else None


def bounds(values):
    v = [x for x in values if x is not None]
    return np.quantile(v, 0.025), np.quantile(v, 0.975), len(v)


@pytest.fixture(scope="module")
def binary(spark):
    n = 90
    y, g = RNG.integers(0, 2, n), RNG.integers(0, 12, n)
    s = np.round(RNG.normal(size=n) + y, 1)
    rows = [(f"g{g[i]}", str(y[i]), str(int(s[i] > 0.5)), float(s[i]), i, f"a{g[i] % 5}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "grp string, y string, pred string, score double, i int, plate string").withColumn("spec", F.lit("x"))


def test_subsets_and_votes_equal_resamples_by_hand(spark, binary):
    rows, df = binary
    on = {"all": F.lit(True), "late": F.col("i") >= 40, "none": F.col("i") < 0}
    got = {(r.subset, r.metric): r for r in subset_metrics(df, on, ["spec"], 40, 4, vote=("plate", "plate"), vote_subsets=["all"]).collect()}
    assert {k[0] for k in got} == {"all", "late", "all@plate"} and {k[1] for k in got} == {"auroc", "auprc", "balanced_accuracy"}
    voted = {}
    for r in rows:
        voted.setdefault(r[5], []).append(r)
    half = lambda x: str(int(np.mean(x) >= 0.5))
    voted = [(p, half([int(r[1]) for r in v]), half([int(r[2]) for r in v]), float(np.mean([r[3] for r in v]))) for p, v in voted.items()]
    for name, use in (("all", rows), ("late", [r for r in rows if r[4] >= 40]), ("all@plate", voted)):
        grp, y, pred, s = [r[0] for r in use], np.array([int(r[1]) for r in use]), np.array([int(r[2]) for r in use]), np.array([r[3] for r in use])
        ones, drawn = np.ones(len(y)), weights(grp, 40, 4)
        for metric, fn in (("auroc", lambda w: area(y, s, w)), ("balanced_accuracy", lambda w: scores(y, pred, w, 2)["balanced_accuracy"])):
            r = got[name, metric]
            assert (r.n_test, r.n_test_groups) == (len(use), len(set(grp)))
            assert r.value == (None if fn(ones) is None else pytest.approx(fn(ones), abs=1e-12))
            made = [v for v in map(fn, drawn) if v is not None]
            assert r.n_ok == len(made) or (not made and not r.n_ok)
            assert (r.lo, r.hi) == (pytest.approx(bounds(made)[:2], abs=1e-12) if len(made) >= 10 else (None, None))
        assert got[name, "auprc"].lo is None


def test_classes_by_subset(spark, binary):
    rows, _ = binary
    cls = [(r[0], "abc"[r[4] % 3], "abc"[(r[4] + (r[3] > 1)) % 3], None, r[4], r[5]) for r in rows]
    df = spark.createDataFrame([*cls, (None, "a", "a", None, 1, None), ("g1", None, "a", None, 1, "a1")], "grp string, y string, pred string, score double, i int, plate string")
    got = {(r.subset, r.metric): r for r in subset_metrics(df.filter("grp is not null"), {"late": F.col("i") >= 40}, [], 40, 1, binary=False).collect()}
    use = [r for r in cls if r[4] >= 40]
    y, pred = (np.array([r[k] for r in use]) for k in (1, 2))
    drawn = weights([r[0] for r in use], 40, 1)
    for metric in ("accuracy", "balanced_accuracy", "macro_f1"):
        r = got["late", metric]
        lo, hi, n = bounds([scores(y, pred, w)[metric] for w in drawn])
        assert r.value == pytest.approx(scores(y, pred, np.ones(len(y)))[metric]) and (r.lo, r.hi, r.n_ok) == (pytest.approx(lo), pytest.approx(hi), n)
    v = {r.grp: r for r in votes(df, "plate", [], False).collect()}
    for p in {r[5] for r in cls}:
        said = [r[2] for r in cls if r[5] == p]
        assert v[p].pred == min(set(said), key=lambda c: (-said.count(c), c)) and v[p].score is None
    everything = subset_metrics(df, {"all": F.lit(True)}, [], 0, binary=False).first()
    # the row without a group counts, the one without a label does not
    assert (everything.n_test, everything.n_test_groups) == (91, len({r[0] for r in cls}))
    assert subset_metrics(df.limit(0), {"all": F.lit(True)}, [], 40, binary=False).count() == 0
