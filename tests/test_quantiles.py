import numpy as np
import pytest

from prismal.operators import quantiles as Q

PROBS = (0.0, 0.1, 0.5, 0.9, 1.0)


@pytest.mark.parametrize("few,bins", [(1 << 16, 1024), (10, 4), (1, 2)])
def test_quantiles_equal_sorting(spark, monkeypatch, few, bins):
    monkeypatch.setattr(Q, "FEW", few)
    monkeypatch.setattr(Q, "BINS", bins)
    rng = np.random.default_rng(2)
    groups = {
        "normal": rng.normal(size=301), "same": np.full(50, 3.25), "ties": rng.integers(0, 4, 200).astype(float), "one": np.array([-7.5]),
        # far apart, so that most bins are empty, and values next to one another
        "wide": np.concatenate([rng.normal(size=40) * 1e-9, [1e300, -1e300, 1e12]]), "close": 1 + np.arange(30) * 2.0**-52, None: rng.random(77),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("normal", None), ("normal", float("nan")), ("void", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r.g: r.q for r in Q.quantiles(df, "v", ["g"], PROBS).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        s = np.sort(vs)
        h = np.array(PROBS) * (len(s) - 1)
        lo, hi = s[np.floor(h).astype(int)], s[np.ceil(h).astype(int)]
        assert got[g] == pytest.approx(lo + (h - np.floor(h)) * (hi - lo), rel=1e-12, abs=1e-15)
    whole = Q.quantiles(df.filter("g = 'ties'"), "v", [], (0.5,)).first().q
    assert whole == [float(np.median(groups["ties"]))]


def test_no_buffer_holds_a_large_key(spark, monkeypatch):
    monkeypatch.setattr(Q, "FEW", 50)
    df = spark.range(5000).selectExpr("id % 2 AS g", "cast(id AS double) AS v")
    out = Q.quantiles(df, "v", ["g"], (0.5,))
    seen = []
    monkeypatch.setattr(Q, "settled", lambda d, name, real=Q.settled: seen.append((name, real(d, name))) or seen[-1][1])
    out = {r.g: r.q[0] for r in Q.quantiles(df, "v", ["g"], (0.5,)).collect()}
    assert out == {0: 2499.0, 1: 2500.0}
    last = [d for name, d in seen if name == "places"][-1]
    assert last.filter("_in > 50").count() == 0
