import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from prismal.operators import linear as L
from prismal.operators import refits as X
from prismal.operators import shuffles as S


def area(y, s):
    gap = s[y == 1][:, None] - s[y == 0][None, :]
    return ((gap > 1e-12) + 0.5 * (np.abs(gap) <= 1e-12)).mean()


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101])
def test_a_shuffle_is_a_bijection(n):
    out = S.shuffled(np.arange(n), n, np.arange(40), 5)
    assert all(sorted(out[:, p]) == list(range(n)) for p in range(40))
    assert n < 10 or len({tuple(c) for c in out.T}) == 40


def test_shuffles_are_uniform():
    out = S.shuffled(np.arange(4), 4, np.arange(12_000), 1)
    counts = np.unique(out.T, axis=0, return_counts=True)[1]
    # 24 orders, 500 times each: within five deviations
    assert len(counts) == 24 and abs(counts - 500).max() < 5 * 500**0.5


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    n = 160
    grp = rng.integers(0, 40, n)
    y = (grp % 3 == 0).astype(int)
    x = rng.normal(size=(n, 6)) * [1, 2, 3, 1, 1, 0] + y[:, None] * [0.6, 0, 1, 0, 0, 0] + 5
    fold = grp % 4
    strata = np.where(grp < 20, "a", None)
    rows = [(i, f"g{g}", int(t), [float(v) for v in row], f"f{f}", None if s is None else str(s), float(np.round(row[0], 1))) for i, (g, t, row, f, s) in enumerate(zip(grp, y, x, fold, strata))]
    return rows, spark.createDataFrame(rows, "id long, g string, y int, x array<double>, fold string, s string, score double")


def label_columns(df, perms, strata=None, seed=0):
    """Labels of every group in every shuffle, from the places."""
    out = {}
    for r in S.places(df, "g", "y", strata).collect():
        a = [np.array([v]) for v in (r.pos, r.n, r.ones, r.z)]
        out[r.g] = S.labels_of(*a, np.arange(perms), seed)[0]
    return out


@pytest.mark.parametrize("strata", [None, "s"])
def test_fixed_scores_against_shuffles_equal_brute_force(data, strata):
    rows, df = data
    drawn = label_columns(df, 30, strata)
    got = {r.perm: r.auroc for r in S.null_areas(df, "g", "y", "score", 30, strata).collect()}
    score = np.array([r[6] for r in rows])
    assert got[-1] == pytest.approx(area(np.array([r[2] for r in rows]), score), abs=1e-12)
    for p in range(30):
        assert got[p] == pytest.approx(area(np.array([int(drawn[r[1]][p]) for r in rows]), score), abs=1e-12)
    # labels keep their number of groups, in every stratum
    for s in {r[5] if strata else 0 for r in rows}:
        groups = {r[1] for r in rows if not strata or r[5] == s}
        true = sum(r[2] for r in {r[1]: r for r in rows if r[1] in groups}.values())
        assert all(sum(drawn[g][p] for g in groups) == true for p in range(30))


def test_the_null_shuffles_no_rows_times_permutations(data):
    _, df = data
    plan = S.null_areas(df, "g", "y", "score", 1000)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "Generate explode" in plan  # only the finished vector is exploded
    with pytest.raises(Exception, match="varies within a group"):
        S.null_areas(df.withColumn("y", F.col("id") % 2), "g", "y", "score", 3).collect()


def test_twin_draws_the_same_shuffles(spark):
    rows = [(i, int(i % 3 == 0), float(i * 7 % 11)) for i in range(50)]
    got = {r.perm: r.auroc for r in S.null_areas(spark.createDataFrame(rows, "g long, y int, s double"), "g", "y", "s", 40, None, 9).collect()}
    values = ", ".join(f"({i}, {y}, {s})" for i, y, s in rows)
    want = dict(duckdb.sql(S.null_areas_sql(f"SELECT * FROM (VALUES {values}) t(grp, y, score)", 40, 9)).fetchall())
    assert got == pytest.approx(want)


def standard(x):
    sd = x.std(0)
    return x.mean(0), np.where(sd > 1e-6, sd, 1.0)


def logistic(x, y, c):
    """Newton's method on the same objective, one column."""
    mu, sd = standard(x)
    z = np.hstack([(x - mu) / sd, np.ones((len(x), 1))])
    w, n = np.zeros(z.shape[1]), len(x)
    weight = np.where(y, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    ridge = np.append(np.full(x.shape[1], 1 / (c * n)), 0.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        grad = z.T @ (weight * (p - y)) / n + ridge * w
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z / n + np.diag(ridge)
        w -= np.linalg.solve(hess, grad)
    return w[:-1] / sd, w[-1] - (mu / sd) @ w[:-1]


def test_joint_logistic_equals_separate_fits(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5)) * [1, 10, 0.1, 1, 0] + 3
    y = np.column_stack([x[:, 0] + rng.normal(size=300) > 3, x[:, 1] > 0, np.zeros(300), rng.random(300) < 0.2]).astype(int)
    rows = spark.createDataFrame([([float(v) for v in a], int(i % 3), *map(int, b)) for i, (a, b) in enumerate(zip(x, y))], "x array<double>, fold int, a int, b int, c int, d int").repartition(4)
    strengths = np.repeat([0.01, 1.0], 4)
    fit = L.joint_logistic(rows, L.with_strengths(L.given, 2), strengths, folds=3)
    assert fit.open == 0
    for f in range(3):
        seen = np.arange(300) % 3 != f
        for k in range(8):
            if k % 4 == 2:
                assert not fit.weights[f][:, k].any() and fit.bias[f][k] == 0
                continue
            w, b = logistic(x[seen], y[seen, k % 4], strengths[k])
            assert fit.weights[f][:, k] == pytest.approx(w, abs=2e-4 * max(1, abs(w).max())) and fit.bias[f][k] == pytest.approx(b, abs=2e-3)


def test_pls_from_sums_equals_the_rows(spark):
    from prismal.operators.estimators import pls_coefficients

    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 7)) @ rng.normal(size=(7, 7)) + 100
    x[:, 3] = 4.0
    y = (x[:, :3] > 100).astype(int)
    rows = spark.createDataFrame([([float(v) for v in a], int(i % 2), *map(int, b)) for i, (a, b) in enumerate(zip(x, y))], "x array<double>, fold int, a int, b int, c int").repartition(3)
    pivot, parts = L.cross_products(rows, L.given, 2)
    for fold in (None, 0, 1):
        seen = np.arange(200) % 2 != fold if fold is not None else np.ones(200, bool)
        n, sx, sy, xx, xy = L.outside(parts, fold)
        for k in (1, 3, 6):
            mx, coef, my = L.pls_from_sums(n, sx, sy, xx, xy, k)
            want = pls_coefficients(x[seen], y[seen].astype(float), k)
            assert mx + pivot == pytest.approx(want[0]) and coef == pytest.approx(want[1], abs=1e-8) and my == pytest.approx(want[2])


def brute(rows, labels, fit):
    """Out-of-fold area of ``fit(x, y, queries)``."""
    x, fold = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    score = np.zeros(len(rows))
    for f in set(fold):
        score[fold == f] = fit(x[fold != f], labels[fold != f], x[fold == f])
    return area(labels, np.round(score, 12))


def pls_fit(x, y, q):
    from prismal.operators.estimators import pls_coefficients

    mx, coef, my = pls_coefficients(x, np.column_stack([1 - y, y]).astype(float), 2)
    return (q - mx) @ coef[:, 1] + my[1]


def knn_fit(x, y, q):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sim = np.round(unit(q) @ unit(x).T, 12)
    near = np.argsort(-sim, axis=1, kind="stable")[:, :4]
    w = 1 / np.maximum(1 - np.take_along_axis(sim, near, 1), 1e-12)
    return (w * y[near]).sum(1) / w.sum(1)


@pytest.mark.parametrize("model,hyper,fit", [("logistic", 0.1, lambda x, y, q: (lambda w, b: q @ w + b)(*logistic(x, y, 0.1))), ("plsda", 2, pls_fit), ("knn", 4, knn_fit)])
def test_refits_equal_brute_force(data, monkeypatch, model, hyper, fit):
    rows, df = data
    drawn = label_columns(df, 6)
    want = [brute(rows, np.array([int(drawn[r[1]][p]) for r in rows]), fit) for p in range(6)]
    real = brute(rows, np.array([r[2] for r in rows]), fit)
    monkeypatch.setattr(L, "BLOCK", 4 * 7 * 5)  # two blocks of shuffles
    got = X.refit_null(df.repartition(3), "x", "y", "g", "fold", model, 6, 0, None, hyper, "id").first()
    assert got.auroc == pytest.approx(real, abs=2e-4) and got.null_mean == pytest.approx(np.mean(want), abs=2e-4) and got.n_perm == 6
    assert got.p == pytest.approx((1 + sum(w >= real - 1e-12 for w in want)) / 7)


def test_refits_of_nothing(data):
    _, df = data
    assert X.refit_null(df.limit(0), "x", "y", "g", "fold", "plsda", 3).first().auroc is None
    with pytest.raises(ValueError, match="no refits"):
        X.refit_null(df, "x", "y", "g", "fold", "boosting")


def test_labels_of_many_rows_and_shuffles_take_little_beyond_themselves():
    import tracemalloc

    n = 4000
    columns = np.arange(n), np.full(n, 3 * n), np.full(n, n), np.zeros(n, np.int64)
    tracemalloc.start()
    drawn = S.labels_of(*columns, np.arange(1000), 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    assert (drawn == (S.shuffled(*columns[:2], np.arange(1000), 3) < n)).all()


def test_areas_of_refits_move_lists_and_are_cut_by_score(spark, monkeypatch):
    rng = np.random.default_rng(8)
    n, columns = 500, 70
    x = np.round(rng.normal(size=(n, 3)), 1)  # scores that tie
    y = rng.random((n, columns)) < 0.3
    weights, bias = rng.integers(-1, 2, (2, 3, columns)).astype(float), np.zeros((2, columns))
    weights[:, :, 0] = 0
    rows = spark.createDataFrame([([float(v) for v in r], i % 2, bytes(np.packbits(b))) for i, (r, b) in enumerate(zip(x, y))], "x array<double>, fold int, bits binary").repartition(3).cache()
    monkeypatch.setattr(X, "RANGE", 60)
    areas = X._linear(rows, weights, bias, -1)
    got = {r.perm: r.auroc for r in areas.collect()}
    s = np.array([x[i] @ weights[i % 2] for i in range(n)])
    assert got == {j - 1: pytest.approx(area(y[:, j], s[:, j]), abs=1e-12) for j in range(columns)}
    # a row a stretch of a shuffle and batch is exchanged, none a row and shuffle
    assert "FlatMapGroupsInArrow" in areas._jdf.queryExecution().executedPlan().toString()
    none = X._areas(rows, lambda b: lambda at, wide: np.full((b.num_rows, wide), np.nan), -1, columns - 1).collect()
    assert len(none) == columns and all(r.auroc is None for r in none)


def test_pls_of_two_classes_equals_pls_from_sums():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 5)) @ rng.normal(size=(5, 5))
    x[:, 2] = 0
    y = (rng.random((80, 4)) < [0.3, 0.5, 0, 1]).astype(float)
    sums = len(x), x.sum(0), x.T @ x
    for k in (1, 3, 8):
        mx, coef = L.pls_of_two(sums[0], sums[1], y.sum(0), sums[2], x.T @ y, k)
        assert not coef[:, 2:].any()
        for c in (0, 1):
            both = np.column_stack([1 - y[:, c], y[:, c]])
            want = L.pls_from_sums(sums[0], sums[1], both.sum(0), sums[2], x.T @ both, k)
            assert mx == pytest.approx(want[0]) and coef[:, c] == pytest.approx(want[1][:, 1], abs=1e-9)


def test_packed_labels_are_those_of_the_shuffles(data):
    _, df = data
    drawn = label_columns(df, 21)
    placed = S.places(df, "g", "y")
    got = {r.g: np.unpackbits(np.frombuffer(r.bits, np.uint8), count=22) for r in S.label_bits(placed, "g", -1, 21, 0).collect()}
    assert {g: list(v[1:]) for g, v in got.items()} == {g: list(v) for g, v in drawn.items()}
    assert {r.g: r.y for r in placed.collect()} == {g: v[0] for g, v in got.items()}
