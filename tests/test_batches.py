"""Batch kernels against plain loops, and their columns on nulls, empty and ragged rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismal.functions import kernels as K
from prismal.functions import signal as S
from prismal.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def naive_shape(y, i):
    """(prominence, left base, right base) by looking at every point."""
    bases = []
    for side in (range(i, -1, -1), range(i, len(y))):
        low = i
        for j in side:
            if y[j] > y[i]:
                break
            low = j if y[j] < y[low] else low
        bases.append(low)
    return y[i] - max(y[b] for b in bases), *bases


def naive_crossing(y, i, base, level):
    step = 1 if base > i else -1
    j = i
    while j != base and y[j] > level:
        j += step
    return j if y[j] >= level else j - step * (level - y[j]) / (y[j - step] - y[j])


def naive_spaced(at, height, distance):
    kept = []
    for i in sorted(range(len(at)), key=lambda k: (-height[k], -k)):
        if all(abs(at[i] - at[j]) >= distance for j in kept):
            kept.append(i)
    return [k in kept for k in range(len(at))]


@pytest.mark.parametrize("decimals", [1, 12])
def test_peaks_of_a_batch_equal_loops(decimals):
    y = np.round(np.random.default_rng(3).normal(size=(9, 120)).cumsum(1), decimals)
    row, at = K.maxima(y)
    shape = K.shapes(y, row, at)
    left, right = K.crossings(y, row, at, shape, 0.6)
    for k, (r, i) in enumerate(zip(row, at)):
        p, a, b = naive_shape(y[r], i)
        assert (shape.left_base[k], shape.right_base[k]) == (a, b) and shape.prominence[k] == pytest.approx(p)
        level = y[r, i] - shape.prominence[k] * 0.6
        assert (left[k], right[k]) == pytest.approx((naive_crossing(y[r], i, a, level), naive_crossing(y[r], i, b, level)))
    kept = K.spaced(row, at, y[row, at], 9)
    for r in range(len(y)):
        m = row == r
        assert kept[m].tolist() == naive_spaced(at[m].tolist(), y[r, at[m]].tolist(), 9)


def test_a_batch_equals_its_rows():
    y = np.random.default_rng(4).normal(size=(6, 80)).cumsum(1)
    for fn in (lambda v: K.als_baseline(v, 100, 0.05, 5), lambda v: K.savitzky_golay(v, 9, 3), lambda v: K.gaussian_broaden(v, 5, 1), K.robust_noise):
        assert np.allclose(fn(y), [fn(v) for v in y])


def test_a_signal_without_points_off_its_fit_keeps_it():
    assert not K.als_baseline(np.zeros((2, 30))).any()


def test_regions_may_touch_and_overlap():
    g = np.arange(10.0)
    assert np.flatnonzero(K.in_regions(g, [[1, 2], [2, 4], [3, 3], [8, 8]])).tolist() == [1, 2, 3, 4, 8]
    assert not K.in_regions(g, []).any()


def test_strongest_takes_the_first_of_equals():
    assert K.strongest(np.array([0, 0, 0, 2, 2]), np.array([1.0, 3, 1, 5, 5]), 1).tolist() == [False, True, False, True, False]
    assert K.strongest(np.array([0, 0, 0]), np.array([1.0, 3, 1]), 2).tolist() == [True, True, False]


def test_columns_take_nulls_and_rows_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 8)  # several blocks a shape
    y = [None, [0.0, 2, 0, 1, 0], [], [0.0, 1, 0], [3.0, None, 1], [0.0, 5, 0, 4, 0], [1.0]]
    rows = [v if v is None else [None if a is None else float(a) for a in v] for v in y]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "id int, y array<double>").repartition(1)
    out = {r.id: r for r in df.select("id", S.peak_shapes(F.col("y")).alias("p"), S.noise(F.col("y")).alias("n"), S.broaden(F.col("y"), 0.0, 1.0).alias("b")).collect()}
    assert out[0].p is None and out[0].n is None and out[0].b is None
    assert [[q["at"] for q in out[i].p] for i in (1, 2, 3, 5, 6)] == [[1, 3], [], [1], [1, 3], []]
    assert [q["prominence"] for q in out[1].p] == [2, 1] and out[2].n == 0 and out[6].b == [1.0] and out[2].b == []
    assert out[4].n is None and out[4].b[0] == 3 and np.isnan(out[4].b[1])
    assert df.filter("id < 0").select(S.peak_shapes(F.col("y"))).collect() == []


def test_a_missing_reference_gives_null_and_axes_are_kept_apart(spark):
    cfg = {"window": [0.0, 4.0], "grid_step": 1.0, "substrate": {"fit_regions": [[0, 4]], "max_shift_cm": 0.0}}
    v = [0.0, 1.0, 2.0, 1.0, 0.0]
    df = spark.createDataFrame([(0, v, None), (1, v, [a / 2 for a in v]), (2, v, [0.0] * 5)], "id int, y array<double>, ref array<double>").repartition(1)
    out = {r.id: r.s for r in df.select("id", S.subtract_reference(F.col("y"), F.col("ref"), cfg).alias("s")).collect()}
    assert out[0] is None or out[0]["rest"] is None
    assert out[1]["scale"] == pytest.approx(2) and np.allclose(out[1]["rest"], 0) and out[2]["scale"] == 0 and out[2]["rest"] == v
    axes = spark.createDataFrame([(0, [0.0, 4.0], [0.0, 4.0]), (1, [0.0, 8.0], [0.0, 4.0])], "id int, x array<double>, y array<double>").repartition(1)
    drawn = {r.id: r.v for r in axes.select("id", S.interpolate(F.col("x"), F.col("y"), cfg).alias("v")).collect()}
    assert drawn == {0: [0, 1, 2, 3, 4], 1: [0, 0.5, 1, 1.5, 2]}


def test_errors_that_round_alike_take_the_first_shift():
    # the errors of all shifts lie within 1e-10
    g = np.arange(4.0)
    ref, y = np.array([0.0, 0.0, 0.0, 1.0]), np.array([0.0, 1.0, 0.0, 1e-5])
    cfg = {"substrate": {"fit_regions": [[0, 3]], "max_shift_cm": 0.25}}
    raw = K.subtract(y, ref, g, cfg)
    assert raw.shift == 0
    cfg["substrate"]["error_decimals"] = 9
    assert K.subtract(y, ref, g, cfg).shift == -0.25


def test_baselines_of_the_query_equal_dense_solutions(spark):
    found = {(r.vec_id, r.k): r.v for r in QUERIES["signal_baseline"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    for r in rows:
        y = np.array(r.embedding, float)
        d = np.diff(np.eye(len(y)), 2, axis=0)
        w = np.ones(len(y))
        for _ in range(10):
            z = np.linalg.solve(np.diag(w) + 50.0 * d.T @ d, w * y)
            w = np.where(y > z, 0.05, np.where(y < z, 0.95, 0))
        assert np.allclose([found[r.vec_id, k] for k in range(len(y))], z, atol=2e-6)
    assert len(found) == sum(len(r.embedding) for r in rows)


def test_the_columns_run_as_arrow_functions(spark):
    plan = QUERIES["peak_shapes"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "Exchange" not in plan
