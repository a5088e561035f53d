import pytest

from prismal.plans import experiments, queries

SF = "/root/testdata/sf0.001"


def test_permutations_and_resamples_are_a_thousand(spark):
    assert (experiments.Context().n_perm, experiments.Context().n_boot) == (1000, 1000)
    p = queries.QUERIES["permutation_test"](spark, SF).first().p
    assert 0 < p <= 1 and p * 1001 == pytest.approx(round(p * 1001), abs=1e-6)
    ci = queries.QUERIES["bootstrap_interval"](spark, SF).first()
    assert 900 < ci.n_ok <= 1000 and ci.lo < ci.hi


def test_no_task_numbers_all_groups(spark):
    from pyspark.sql import functions as F

    from prismal.operators import coverage, resample

    rows = spark.range(500).select(F.col("id").cast("string").alias("g"), (F.col("id") % 2).alias("y"), (F.col("id") * 7 % 1000).cast("double").alias("v"))
    perm = resample.permutations(rows, "g", "y", 3, None, 1)
    split, folds = resample.group_split(rows, "g", "y"), resample.group_folds(rows, "g", "y", 4)
    for df in (perm, split, folds):
        plan = df._jdf.queryExecution().executedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert any("_cell" in line for line in windows)
    got = perm.collect()
    assert len(got) == 1500 and all(sum(r.y for r in got if r.perm == p) == 250 for p in range(3))
    assert len({tuple(r.y for r in sorted(got, key=lambda r: int(r.g)) if r.perm == p) for p in range(3)}) == 3
    assert {(r.split, r["count"]) for r in split.groupBy("split").count().collect()} == {("test", 100), ("train", 400)}
    # 250 groups of each label on 4 folds: 63, 63, 62, 62 of each
    assert sorted(r["count"] for r in folds.groupBy("fold").count().collect()) == [124, 124, 126, 126]
    # clusters across the borders of cells of a thousand tolerances
    c = coverage.gap_clusters(spark.createDataFrame([(x,) for x in (998.0, 999.5, 1000.5, 1001.0, 2005.0, 2005.5, 5000.0)], "v double"), "v", 1.0).orderBy("cluster").collect()
    assert [(r.lo, r.hi, r.n) for r in c] == [(998.0, 998.0, 1), (999.5, 1001.0, 3), (2005.0, 2005.5, 2), (5000.0, 5000.0, 1)]
