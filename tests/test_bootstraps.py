"""Areas of resamples: against resamples made one by one, for every key, and as a table where groups are too many."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismal.operators import bootstraps as B
from prismal.operators import metrics as M
from prismal.operators import resample as R


def area(y, s, w):
    pos, neg = y >= 0.5, y < 0.5
    if not (w[pos].sum() and w[neg].sum()):
        return None
    gap = s[pos][:, None] - s[neg][None, :]
    won = (gap > 0) + (gap == 0) / 2
    return float((won * w[pos][:, None] * w[neg][None, :]).sum() / (w[pos].sum() * w[neg].sum()))


def table(spark, n=300, groups=23, seed=3):
    rng = np.random.default_rng(seed)
    y, g, k = rng.integers(0, 2, n), rng.integers(0, groups, n), rng.integers(0, 3, n)
    s = np.round(rng.normal(size=n) + y, 1)
    rows = [(f"g{g[i]}", ["a", "b", None][k[i]], int(y[i]), float(s[i])) for i in range(n)]
    rows += [(None, "a", 1, 0.0), ("g0", "a", None, 1.0), ("g0", "a", 1, None), ("g0", "a", 1, float("nan")), ("lone", "a", 1, -0.0), ("g1", "a", 0, 0.0)]
    return rows, spark.createDataFrame(rows, "g string, k string, y int, s double")


def by_hand(rows, n_boot, seed):
    names = sorted({r[0] for r in rows if r[0] is not None}, key=lambda g: (hashlib.md5(g.encode()).hexdigest()[:15], g))
    use = [r for r in rows if r[0] is not None and r[2] is not None and r[3] is not None and r[3] == r[3]]
    out = {}
    for rep in range(n_boot):
        mult = dict.fromkeys(names, 0)
        for d in range(len(names)):
            mult[names[R.drawn(rep, d, len(names), seed)]] += 1
        for k in {r[1] for r in use}:
            mine = [r for r in use if r[1] == k]
            out[k, rep] = area(*(np.array(c, float) for c in ([r[2] for r in mine], [r[3] for r in mine], [mult[r[0]] for r in mine])))
    return out


@pytest.mark.parametrize("chunk, levels", [(4_000_000, 500_000), (700, 20)])
def test_areas_equal_resamples_by_hand(spark, monkeypatch, chunk, levels):
    monkeypatch.setattr(B, "CHUNK", chunk)
    monkeypatch.setattr(B, "LEVELS", levels)
    rows, df = table(spark)
    want = by_hand(rows, 40, 5)
    got = {(r.k, r.rep): r.auroc for r in B.area_replicates(df.repartition(5), "g", "y", "s", 40, 5, "k").collect()}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], abs=1e-12) for x in want)
    alone = {r.rep: r.auroc for r in B.area_replicates(df.drop("k"), "g", "y", "s", 12, 5).collect()}
    assert alone == pytest.approx({rep: v for (_, rep), v in by_hand([(r[0], 0, *r[2:]) for r in rows], 12, 5).items()}, abs=1e-12)


def test_many_groups_give_the_same_by_a_table(spark, monkeypatch):
    _, df = table(spark)
    key = lambda d: {(r.k, r.rep): r.auroc for r in d.collect() if r.auroc is not None}
    want = key(B.area_replicates(df, "g", "y", "s", 30, 2, "k"))
    monkeypatch.setattr(B, "GROUPS", 0)
    assert key(B.area_replicates(df, "g", "y", "s", 30, 2, "k")) == pytest.approx(want, abs=1e-12)


def test_interval_and_empty_tables(spark):
    _, df = table(spark)
    ci = B.area_interval(df, "g", "y", "s", 60, 1).first()
    assert ci.n_ok == 60 and ci.lo < M.auroc(df.filter("g is not null"), "y", "s").first().auroc < ci.hi
    assert B.area_interval(df.limit(0), "g", "y", "s", 60, 1).first().lo is None
    assert B.area_replicates(df.limit(0), "g", "y", "s", 60, 1, "k").count() == 0
    one = B.area_interval(df.filter("y = 1"), "g", "y", "s", 60, 1).first()
    assert one.n_ok == 0 and one.lo is None


def test_draws_are_even_and_replicates_differ():
    at = R.drawn(np.arange(400)[:, None], np.arange(50)[None, :], 50, 3)
    counts = np.bincount(at.ravel(), minlength=50)
    assert counts.sum() == 20000 and ((counts - 400) ** 2 / 400).sum() < 95
    assert len({tuple(sorted(r)) for r in at.tolist()}) == 400
    # a group is left out about as often as 1/e
    assert abs((B.multiplicities(50, np.arange(400), 3) == 0).mean() - (1 - 1 / 50) ** 50) < 0.02


def test_no_rows_times_replicates_are_shuffled(spark):
    _, df = table(spark)
    plan = B.area_replicates(df, "g", "y", "s", 1000, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


def test_mean_over_labels_takes_the_same_resamples(spark):
    from prismal.plans import tasks

    rows, df = table(spark)
    scores = df.filter("k is not null").select(F.col("k").alias("label"), F.col("g").alias("analyte"), "y", F.col("s").alias("score"))
    hand = by_hand([r for r in rows if r[1] is not None], 40, 0)
    each = [np.mean([hand[k, rep] for k in "ab"]) for rep in range(40)]
    got = tasks.mean_area_ci(scores, 40).first()
    assert (got.lo, got.hi) == pytest.approx((np.quantile(each, 0.025), np.quantile(each, 0.975)), abs=1e-12)
