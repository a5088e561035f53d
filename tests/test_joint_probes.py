import numpy as np
import pytest

from prismal.plans import ladder


def area(y, s):
    gap = s[y == 1][:, None] - s[y == 0][None, :]
    return ((gap > 1e-12) + 0.5 * (np.abs(gap) <= 1e-12)).mean()


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(240):
        y = [int(rng.random() < 0.4), int(rng.random() < 0.3), None if i % 7 else 1]
        for layer in ("a", "b"):
            signal = [y[0] * (2.0 if layer == "a" else 0.2), y[1] * (0.1 if layer == "a" else 1.5), 0, (y[2] or 0) * 0.8]
            rows.append((i, ("train", "train", "valid", "rung")[i % 4], layer, [float(v) for v in rng.normal(size=4) + signal], *y, f"R{i % 8 // 4}", f"m{i // 8}"))
    return rows, spark.createDataFrame(rows, "id long, part string, source string, v array<double>, p int, q int, r int, rung string, analyte string").repartition(4)


def test_strength_and_layer_come_from_validation(table):
    from test_shuffles import logistic

    rows, df = table
    names, cs = ["p", "q", "r"], (0.001, 0.1)
    got = ladder.joint_probes(df.filter("part = 'train'"), df.filter("part = 'valid'"), names, strengths=cs)
    pick = lambda part, layer: [r for r in rows if r[1] == part and r[2] == layer]
    xy = lambda rs: (np.array([r[3] for r in rs]), np.array([[int(bool(v)) for v in r[4:7]] for r in rs]))
    want, fits = {}, {}
    for layer in ("a", "b"):
        (x, y), (xv, yv) = xy(pick("train", layer)), xy(pick("valid", layer))
        per = []
        for c in cs:
            ws = [logistic(x, y[:, k], c) for k in range(3)]
            per.append(([area(yv[:, k], xv @ w + b) for k, (w, b) in enumerate(ws)], c, ws))
        best = max(per, key=lambda p: np.mean(p[0]))
        fits[layer] = best[2]
        for k, n in enumerate(names):
            want[n, layer] = (best[0][k], best[1])
    found = {(r.label, r.source): r for r in got.table.collect()}
    assert {k: (pytest.approx(v[0], abs=2e-3), v[1]) for k, v in want.items()} == {k: (r.validation, r.c) for k, r in found.items()}
    chosen = {r.label: r.source for r in found.values() if r.chosen}
    assert chosen == {n: max(("a", "b"), key=lambda s, n=n: found[n, s].validation) for n in names} and chosen["p"] == "a" and chosen["q"] == "b"
    for centred in (False, True):
        for r in ladder.joint_rungs(got, df.filter("part = 'rung'"), centred=centred).collect():
            mine = [m for m in pick("rung", chosen[r.label]) if m[7] == r.rung]
            x, y = xy(mine)
            k = names.index(r.label)
            w, b = fits[chosen[r.label]][k]
            s, who = x @ w + b, [m[8] for m in mine]
            mean = np.array([s[[j for j, a in enumerate(who) if a == m]].mean() for m in sorted(set(who))])
            truth = np.array([int(y[[j for j, a in enumerate(who) if a == m], k].mean() >= 0.5) for m in sorted(set(who))])
            assert r.source == chosen[r.label] and r.auroc == pytest.approx(area(truth, mean), abs=5e-3)
