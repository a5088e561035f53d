import numpy as np
import pytest
from pyspark.sql import functions as F

from prismal.operators import metrics as M
from prismal.operators import resample as R


def auc(y, s):
    p, n = [b for a, b in zip(y, s) if a], [b for a, b in zip(y, s) if not a]
    return np.mean([(a > b) + 0.5 * (a == b) for a in p for b in n]) if p and n else None


def frame(spark, y, s, **more):
    cols = {"y": y, "s": s} | more
    return spark.createDataFrame(list(zip(*cols.values())), list(cols))


def test_auroc_with_ties_equals_all_pairs(spark):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 200).tolist(), (rng.integers(0, 12, 200) / 4).tolist()
    g = (np.arange(200) % 3).tolist()
    got = {r.g: r.auroc for r in M.auroc(frame(spark, y, s, g=g), "y", "s", "g").collect()}
    for k in range(3):
        assert got[k] == pytest.approx(auc([a for a, q in zip(y, g) if q == k], [b for b, q in zip(s, g) if q == k]))


def test_one_class_and_nulls(spark):
    assert M.auroc(frame(spark, [1, 1], [0.1, 0.2]), "y", "s").first().auroc is None
    assert M.average_precision(frame(spark, [0, 0], [0.1, 0.2]), "y", "s").first().auprc is None
    assert M.auroc(frame(spark, [1, 0, None, 1], [0.2, 0.1, 0.5, float("nan")]), "y", "s").first().auroc == 1.0
    assert M.auroc(frame(spark, [1], [0.5]).limit(0), "y", "s").first().auroc is None


def test_average_precision_by_hand(spark):
    assert M.average_precision(frame(spark, [1, 0, 1, 0], [0.9, 0.8, 0.7, 0.1]), "y", "s").first().auprc == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_threshold_takes_the_smallest_of_equals(spark):
    r = M.best_threshold(frame(spark, [0, 1, 0, 1], [0.1, 0.4, 0.4, 0.9]), "y", "s").first()
    assert (r.threshold, r.balanced_accuracy) == (0.4, 0.75)


def test_calibration_and_rates(spark):
    df = frame(spark, [1, 0, 1, 1], [1.0, 0.0, 0.95, 0.91])
    assert M.calibration_error(df, "y", "s").first().ece == pytest.approx(0.75 * abs((1 + 0.95 + 0.91) / 3 - 1))
    assert M.tpr_at_fpr(frame(spark, [1, 1, 0, 0], [0.9, 0.2, 0.5, 0.1]), "y", "s", 0.0).first().tpr == 0.5


def test_multiclass_with_a_class_never_predicted(spark):
    r = M.multiclass_report(frame(spark, ["a", "a", "b", "c"], ["a", "b", "b", "b"]), "y", "s").first()
    assert r.accuracy == 0.5 and r.balanced_accuracy == pytest.approx((0.5 + 1 + 0) / 3) and r.macro_f1 == pytest.approx((2 / 3 + 0.5 + 0) / 3)


def test_confusion_is_square(spark):
    rows = {(r.label, r.pred): r.n for r in M.confusion(frame(spark, ["a", "b", "z"], ["a", "a", "a"]), "y", "s", ["a", "b"]).collect()}
    assert rows == {("a", "a"): 1, ("a", "b"): 0, ("b", "a"): 1, ("b", "b"): 0}


def test_votes(spark):
    df = frame(spark, ["b", "a", "b", "a"], ["x", "y", "x", "y"], g=[1, 1, 2, 2])
    assert {(r.label, r.pred) for r in M.group_vote(df, "g", "y", "s").collect()} == {("a", "x")}


def test_binary_report_has_all_parts(spark):
    df = frame(spark, [1, 0, 1, 0], [0.9, 0.3, 0.4, 0.6]).withColumn("p", (F.col("s") >= 0.5).cast("int"))
    r = M.binary_report(df, "y", "s", "p", with_ece=True).first()
    assert r.auroc == 0.75 and r.balanced_accuracy == 0.5 and r.ece > 0


def test_bootstrap_is_repeatable_and_covers(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 120).tolist()
    df = frame(spark, y, [float(a + b) for a, b in zip(y, rng.normal(size=120))], g=(np.arange(120) // 4).tolist())
    fn = lambda d, by, w: M.auroc(d, "y", "s", by, w)
    a, b = (R.bootstrap_ci(df, "g", fn, "auroc", 60, 5).first() for _ in range(2))
    assert a == b and a.lo < M.auroc(df, "y", "s").first().auroc < a.hi
    assert R.bootstrap_ci(df, "g", fn, "auroc", 5, 5).first().lo is None


def test_replicates_draw_as_many_groups_as_there_are(spark):
    g = spark.createDataFrame([(i,) for i in range(7)], "g int")
    sums = R.replicates(g, "g", 9, 1).groupBy("rep").agg(F.sum("mult").alias("n")).collect()
    assert len(sums) == 9 and {r.n for r in sums} == {7}


def test_permutations_keep_groups_and_counts(spark):
    df = spark.createDataFrame([(f"g{i // 2}", i // 2 % 3, "s" if i < 6 else "t") for i in range(12)], "g string, y int, z string")
    perm = R.permutations(df, "g", "y", 4, "z", 2)
    assert perm.count() == 24
    want = sorted(r.y for r in df.select("g", "y").distinct().collect())
    assert all(sorted(r.y for r in perm.filter(F.col("perm") == k).collect()) == want for k in range(4))
    bad = spark.createDataFrame([("g", 0), ("g", 1)], "g string, y int")
    with pytest.raises(Exception, match="varies"):
        R.permutations(bad, "g", "y", 1).collect()


def test_splits_and_folds(spark):
    df = spark.createDataFrame([(f"g{i}", None if i % 3 == 2 else f"a{i % 3}") for i in range(30)] + [("solo", "only")], "g string, y string")
    s = {r.g: r.split for r in R.group_split(df, "g", "y").collect()}
    assert s["solo"] == "train" and sum(v == "test" for v in s.values()) == 6
    assert R.group_folds(df, "g", "y").count() == 0
    folds = R.group_folds(df.filter("y is not null and y <> 'only'"), "g", "y", 5).groupBy("fold").count().collect()
    assert len(folds) == 5 and {r["count"] for r in folds} == {4}
    sets = {r.k: r.split for r in R.set_split(spark.createDataFrame([("a",)] * 6 + [("b",)] * 3 + [("c",)], "k string"), "k", 0.3).collect()}
    assert sets == {"a": "train", "b": "test", "c": "train"}


def test_p_value_and_pairs(spark):
    null = spark.createDataFrame([(0.4,), (0.6,), (0.7,)], "v double")
    assert R.p_value(null, "v", 0.6).first().p == 0.75
    df = spark.createDataFrame([("p", 1), ("q", 0), ("r", 0)], "a string, y int")
    assert R.leave_pair_out(df, "a", "y").count() == 2
    w = R.pair_wins(spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (0.0, 1.0)], "pos_score double, neg_score double")).collect()
    assert [r.win for r in w] == [0.5, 1.0, 0.0]
    assert R.pair_ci(np.full((3, 2), 0.5), 50) == (0.5, 0.5, 0.5)
