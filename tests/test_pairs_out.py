import numpy as np
import pytest
from pyspark.sql import functions as F

from prismal.operators import pairs_out as P
from prismal.operators import shuffles as H
from prismal.plans import experiments as X


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    made = [(i, f"a{i % 7}", int(i % 7 < 3), [float(v) for v in rng.normal(size=4) + (i % 7 < 3) * np.array([1.0, 0, 0, 0])]) for i in range(40)]
    return spark.createDataFrame(made, "id int, analyte string, y int, v array<double>").cache()


def unit(v):
    size = np.linalg.norm(v, axis=-1, keepdims=True)
    return v / np.where(size > 0, size, 1)


def brute(rows, label_of):
    """(pos, neg) to scores, a fit a pair."""
    a, v = np.array([r.analyte for r in rows]), np.array([r.v for r in rows])
    y = np.array([label_of[x] for x in a])
    out = {}
    for p in sorted({x for x in a if label_of[x]}):
        for n in sorted({x for x in a if not label_of[x]}):
            fit = (a != p) & (a != n)
            if len(set(y[fit])) < 2:
                continue
            c = v[fit].mean(0)
            w = unit(v[fit & (y == 1)].mean(0) - c) - unit(v[fit & (y == 0)].mean(0) - c)
            out[p, n] = tuple((unit(v[a == x] - c) @ w).mean() for x in (p, n))
    return out


@pytest.mark.parametrize("limits", [None, 8])
def test_pairs_and_shuffles_equal_a_fit_a_pair(rows, monkeypatch, limits):
    if limits:  # blocks of two analytes, chunks of two rows
        monkeypatch.setattr(P, "BLOCK", limits)
        monkeypatch.setattr(P, "CHUNK", limits)
    given = rows.collect()
    found = P.centroid_pairs(rows, "v", "y", "analyte", 3, 5).collect()
    places = H.places(rows, "analyte", "y").collect()
    drawn = {r.analyte: H.labels_of(*(np.array([r[c]]) for c in H.PLACE), np.arange(3), 5)[0] for r in places}
    for perm in range(-1, 3):
        labels = {r.analyte: r.y if perm < 0 else int(drawn[r.analyte][perm]) for r in places}
        want = brute(given, labels)
        got = {(r.pos, r.neg): (r.pos_score, r.neg_score) for r in found if r.perm == perm}
        assert got.keys() == want.keys() and len(got) == 12
        assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_the_task_takes_the_plan(rows):
    one = X.leave_pair_out_task(rows, "analyte", "y", "centroid", X.Context())
    want = brute(rows.collect(), {r.analyte: r.y for r in rows.collect()})
    assert {(r.pos, r.neg): (r.pos_score, r.neg_score) for r in one.collect()} == {k: pytest.approx(v) for k, v in want.items()}


def test_a_null_of_pairs(rows):
    r = P.centroid_pair_null(rows, "v", "y", "analyte", 20).first()
    wins = P.centroid_pairs(rows, "v", "y", "analyte", 20).groupBy("perm").agg(F.avg("win").alias("w")).collect()
    real = next(w.w for w in wins if w.perm < 0)
    assert r.auroc == pytest.approx(real) and r.n_perm == 20
    assert r.p == pytest.approx((1 + sum(w.w >= real - 1e-12 for w in wins if w.perm >= 0)) / 21)


def test_odd_tables(spark, rows):
    assert P.centroid_pairs(rows.limit(0), "v", "y", "analyte", 2).count() == 0
    # one positive analyte: without it there is no class 1
    assert P.centroid_pairs(rows.filter("analyte not in ('a0', 'a1')"), "v", "y", "analyte").count() == 0
    odd = rows.selectExpr("if(id = 0, null, v) v", "if(id = 1, null, y) y", "if(id = 2, null, analyte) analyte")
    assert P.centroid_pairs(odd, "v", "y", "analyte").count() == 12
    same = rows.select("analyte", "y", F.array(F.lit(1.0), F.lit(1.0)).alias("v"))
    assert P.centroid_pairs(same, "v", "y", "analyte").agg(F.avg("win")).first()[0] == 0.5
