import numpy as np
import pytest
from pyspark.sql import functions as F

from prismal.functions import arrays as A
from prismal.functions import signal as S
from prismal.operators import coverage as C
from prismal.operators import estimators as E
from prismal.operators import vectors as V

RNG = np.random.default_rng(0)
X = RNG.normal(size=(60, 6)) + np.repeat(np.eye(6)[:3] * 4, 20, axis=0)
Y = np.repeat([0, 1, 2], 20)


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, X[i].tolist(), int(Y[i]), f"d{i % 2}", f"g{i // 4}") for i in range(60)]
    return spark.createDataFrame(rows, "id long, v array<double>, y int, d string, g string").repartition(3).cache()


def test_array_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],)], "v array<double>")
    got = df.select(A.norm(F.col("v")), A.unit(F.col("v")), A.standard_rows(F.col("v")), A.differences(F.col("v")), A.median(F.col("v"))).collect()
    assert got[0][0] == 5 and got[0][1] == [0.6, 0.8] and got[0][2] == [-1, 1] and got[0][3] == [1.0] and got[0][4] == 3.5
    assert got[1][1] == [0, 0] and got[1][2] == [0, 0]
    assert got[2][3] == [] and got[2][4] is None


def test_scale_to_max_raises_without_a_maximum(spark):
    with pytest.raises(Exception, match="positive maximum"):
        spark.createDataFrame([([0.0],)], "v array<double>").select(A.scale_to_max(F.col("v"))).collect()


def test_centring_by_group_means(table):
    c = {r.id: r.centred for r in V.centre_by_domain(table, "v", "d", "g").collect()}
    d = np.array([i % 2 for i in range(60)])
    g = np.array([i // 4 for i in range(60)])
    for i in (0, 7):
        same = d == d[i]
        mean = np.mean([X[same & (g == k)].mean(0) for k in np.unique(g[same])], axis=0)
        assert np.allclose(c[i], X[i] - mean)


def test_standardise_uses_training_rows_only(table):
    z = {r.id: r.z for r in V.standardise(table.filter("id < 30"), table, "v").collect()}
    m, s = X[:30].mean(0), X[:30].std(0)
    assert np.allclose(z[45], (X[45] - m) / s)


def test_controls_and_lookup(table, spark):
    out = V.subtract_controls(table, table.filter("id < 2"), "v", "d").filter("id = 5").first()
    assert np.allclose(out.v, X[5] - X[1])
    with pytest.raises(Exception, match="no controls"):
        V.subtract_controls(table, table.filter("id = 0"), "v", "d").collect()
    with pytest.raises(Exception, match="missing id"):
        V.lookup(spark.createDataFrame([(1,), (999,)], "id long"), table).collect()


def test_neighbours_equal_brute_force(table):
    got = {(r.query_id, r["rank"]): r.id for r in V.cosine_neighbours(table.filter("id % 7 = 0"), table, "v", "id", 4).collect()}
    u = X / np.linalg.norm(X, axis=1, keepdims=True)
    for q in range(0, 60, 7):
        s = u @ u[q]
        s[q] = -9
        assert [got[q, k + 1] for k in range(4)] == np.lexsort((np.arange(60), -s))[:4].tolist()


def test_neighbours_in_blocks_equal_those_at_once(table, monkeypatch):
    whole = sorted(map(tuple, V.cosine_neighbours(table, table, "v", "id", 3).collect()))
    monkeypatch.setattr(V.N, "BLOCK_BYTES", 300)
    assert sorted(map(tuple, V.cosine_neighbours(table, table, "v", "id", 3).collect())) == whole and len(whole) == 180


def test_near_pairs_lose_none(table):
    got = {(r.left_id, r.right_id) for r in V.near_pairs(table.filter("id < 30"), table.filter("id >= 30"), "v", "id", 0.5).collect()}
    u = X / np.linalg.norm(X, axis=1, keepdims=True)
    assert got == {(i, j) for i in range(30) for j in range(30, 60) if u[i] @ u[j] >= 0.5} and got


@pytest.mark.parametrize("name", ["majority", "logistic", "pca_logistic", "plsda", "centroid", "knn", "boosting"])
def test_estimators_separate_planted_classes(table, name):
    train, test = table.filter("id % 4 <> 0"), table.filter("id % 4 = 0")
    rows = E.make(name)(train, "v", "y", **({"rounds": 3} if name == "boosting" else {})).apply(test).select("y", "pred").collect()
    right = np.mean([r.y == r.pred for r in rows])
    assert len(rows) == 15 and (right >= 0.8 if name != "majority" else right <= 0.5)


def test_unknown_model_and_single_class(table):
    with pytest.raises(ValueError):
        E.make("nope")
    one = E.make("logistic")(table.filter("y = 1"), "v", "y").apply(table.filter("id = 0")).first()
    assert one.pred == 1 and one.score == 1.0


def test_out_of_fold_scores_every_row_once(table):
    from prismal.operators.resample import group_folds

    folds = group_folds(table, "g", "y", 3)
    out = E.out_of_fold(table, folds, "g", "centroid", "v", "y")
    assert out.count() == 60 and out.select("id").distinct().count() == 60


def test_plsda_coefficients_reach_least_squares():
    mx, coef, my = E.pls_coefficients(X, np.eye(3)[Y], 6)
    want = np.linalg.lstsq(np.c_[X - X.mean(0)], np.eye(3)[Y] - np.eye(3)[Y].mean(0), rcond=None)[0]
    assert np.allclose(coef, want, atol=1e-6) and np.allclose(my, 1 / 3)


def test_consensus_leaves_out_an_outlier(spark):
    base = np.sin(np.arange(50) / 5)
    rows = [(f"r{i}", (base + 0.01 * i).tolist()) for i in range(5)] + [("bad", np.cos(np.arange(50) / 2).tolist())]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    c = C.consensus(df, "v", "id").first()
    assert (c.n, c.n_all) == (5, 6) and np.allclose(c["mean"], base + 0.02) and np.allclose(c.p90, base + 0.036)
    noise = spark.createDataFrame([(str(i), RNG.normal(size=40).tolist()) for i in range(6)], "id string, v array<double>")
    with pytest.raises(Exception, match="too few"):
        C.consensus(noise, "v", "id").collect()


def test_gap_clusters_and_shared_positions(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 20.0), ("c", 2.5), ("c", 50.0)], "k string, p double")
    assert [(r.lo, r.hi, r["median"], r.n) for r in C.gap_clusters(df, "p", 5).orderBy("lo").collect()] == [(1.0, 3.0, 2.25, 4), (20.0, 20.0, 20.0, 1), (50.0, 50.0, 50.0, 1)]
    assert [(r["median"], r.share) for r in C.shared_positions(df, "p", "k").collect()] == [(2.25, 1.0)]
    assert C.shared_positions(df.filter("k <> 'c'"), "p", "k").count() == 0


def test_similarity_summary(table):
    t = C.similarity_table(table.withColumn("side", F.col("d")), "v", "side", "d0", "d1", "y")
    s = C.similarity_summary(t).first()
    assert s.n == 3 and s.top1 == 1.0 and s.median_rank == 1


def test_steps_and_unknown_step(table):
    out = S.apply_steps(table, "v", ["snv", "lt3"], axis=[1.0, 2.0, 3.0, 4.0, 5.0, 6.0]).filter("id = 3").first()
    assert np.allclose(out.v, ((X[3] - X[3].mean()) / X[3].std())[:2])
    with pytest.raises(ValueError):
        S.apply_steps(table, "v", ["zap"])
