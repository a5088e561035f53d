import numpy as np
import pytest

from prismal.operators import near as N
from prismal.operators import vectors as V


@pytest.fixture(scope="module")
def clusters(spark):
    """Tight clusters, a zero vector, equal vectors and rows that are left out."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 8))
    x = np.concatenate([c + 0.05 * rng.normal(size=(20, 8)) for c in centres])
    x[5], x[7] = 0, x[6]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(None, [1.0] * 8), (9999, None)]
    return x, spark.createDataFrame(rows, "id long, v array<double>").repartition(5)


def cosines(x):
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    return u @ u.T


@pytest.mark.parametrize("least,block", [(0.98, 1 << 20), (0.98, 700), (0.6, 2000), (0.0, 1 << 20)])
def test_pairs_and_counts_equal_brute_force(clusters, monkeypatch, least, block):
    monkeypatch.setattr(N, "BLOCK_BYTES", block)
    monkeypatch.setattr(N, "ROWS_A_PIVOT", 20)
    x, df = clusters
    s = cosines(x)
    got = {(r.left_id, r.right_id): r.sim for r in N.near_pairs(df.filter("id % 3 = 0"), df.filter("id % 3 <> 0"), "v", "id", least).collect()}
    want = {(i, j): s[i, j] for i in range(0, len(x), 3) for j in range(len(x)) if j % 3 and s[i, j] >= least - 1e-12}
    assert got == pytest.approx(want) and got
    counts = {r.id: r.n_links for r in N.link_counts(df, "v", "id", least).collect()}
    assert counts == {i: int((s[i] >= least - 1e-12).sum() - (s[i, i] >= least - 1e-12)) for i in range(len(x))}


def test_bounds_prune_and_say_where_they_cannot(clusters, monkeypatch):
    monkeypatch.setattr(N, "ROWS_A_PIVOT", 20)
    x, df = clusters
    guests, home = N._prepared(df, df, "v", "id", 0.98, None)
    met = guests.groupBy("cell").count().withColumnRenamed("count", "l").join(home.groupBy("cell").count(), "cell").selectExpr("sum(l * count)").first()[0]
    # a thirtieth of the pairs are of one cluster
    assert met < 0.2 * len(x) ** 2
    with pytest.raises(ValueError, match="nothing to prune"):
        N.near_pairs(df, df, "v", "id", 0.01, max_share=0.5)


def test_nothing_passes_the_driver_and_empty_sides(clusters, monkeypatch):
    _, df = clusters
    plan = N.nearest(df, df, "v", "id", 3)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "LocalTableScan" not in plan
    assert N.near_pairs(df.limit(0), df, "v", "id", 0.9).count() == 0 == N.near_pairs(df, df.limit(0), "v", "id", 0.9).count()
    assert N.nearest(df, df.limit(0), "v", "id", 3).count() == 0


def test_a_pair_of_blocks_takes_little_beyond_its_rows(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    taken = {}
    for fn in ("link_counts", "nearest"):
        monkeypatch.setattr(N, "in_blocks", lambda a, b, compare, schema: taken.__setitem__("compare", compare) or 1 / 0)
        monkeypatch.setattr(N, "_prepared", lambda *_: (None, type("Home", (), {"drop": lambda *_: None})()))
        monkeypatch.setattr(N, "_rows", lambda *_: type("Rows", (), {"withColumn": lambda *_: None})())
        monkeypatch.setattr(N, "settled", lambda df, _: df)
        monkeypatch.setattr(N, "F", type("F", (), {"lit": staticmethod(lambda _: None)}))
        with pytest.raises(ZeroDivisionError):
            N.link_counts(None, "x", "id", 0.4) if fn == "link_counts" else N.nearest(None, None, "x", "id", 5)
        n, rng = 8192, np.random.default_rng(1)
        half = [pa.table({"id": np.arange(o, o + m), "x": pa.ListArray.from_arrays(pa.array(np.arange(0, 16 * m + 1, 16), pa.int32()), pa.array(rng.normal(size=16 * m)))}) for o, m in ((0, 600), (300, n))]
        tracemalloc.start()
        out = taken["compare"](*half)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 32 << 20
        x, y = (N.matrix(t["x"]) for t in half)
        s = np.round(x @ y.T, 12)
        s[np.arange(600)[:, None] == np.arange(300, 300 + n)] = -np.inf
        if fn == "link_counts":
            assert out["n"].to_pylist() == (s >= 0.4 - 1e-12).sum(1).tolist()
        else:
            want = 300 + np.argsort(-s, axis=1, kind="stable")[:, :5]
            assert np.array_equal(out["id"].to_numpy().reshape(600, 5), want)


def test_nearest_rows_of_other_sides_only(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_BYTES", 8 * 4 * 30)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 4))[rng.integers(0, 100, 150)]  # with copies
    x[10:17, 1] = np.nan
    side = [None if i % 25 == 0 else "abc"[i % 3] for i in range(150)]
    df = spark.createDataFrame([(i, [float(v) for v in r], s) for i, (r, s) in enumerate(zip(x, side))], "id long, v array<double>, s string")
    got = {}
    for r in V.cosine_neighbours(df, df, "v", "id", 4, apart="s").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 12)
    for i in range(150):
        others = [j for j in range(150) if side[i] and side[j] and side[j] != side[i] and not np.isnan(sims[i, j])]
        assert got.get(i, []) == sorted(others, key=lambda j: (-sims[i, j], j))[:4]


def test_floats_are_sent_as_floats(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_BYTES", 4 * 4 * 30)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(100, 4)).astype(np.float32)[rng.integers(0, 80, 100)]  # with copies
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<float>").cache()
    near = N.nearest(df, df, "v", "id", 3)
    assert near.groupBy("query_id").count().agg({"count": "max"}).first()[0] <= 3 * 4  # 30 rows a block
    sent = [line for line in near._jdf.queryExecution().analyzed().toString().splitlines() if "FlatMapCoGroupsInArrow" in line]
    left, right = N._sides(df, df, "v", "id", None)
    assert sent and left is right and left.schema["x"].dataType.simpleString() == "array<float>"
    wide = df.withColumn("v", df.v.cast("array<double>"))
    got, want = (sorted(map(tuple, V.cosine_neighbours(d, d, "v", "id", 3).collect())) for d in (df, wide))
    assert got == want and len(got) == 300
