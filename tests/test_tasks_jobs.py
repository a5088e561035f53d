import numpy as np
import pytest
from pyspark.sql import functions as F

from prismal.config import variant
from prismal.functions import kernels as K
from prismal.plans import experiments as X
from prismal.plans import jobs
from prismal.plans import tasks as T

RNG = np.random.default_rng(7)
CTX = X.Context(n_boot=12, n_perm=4, models=("majority", "centroid"), min_positives=3)


@pytest.fixture(scope="module")
def world(spark):
    """Cells of three strains, standards and blanks; class means are planted."""
    rec, feat = [], []
    for i in range(54):
        a, s = i % 3, i // 3 % 3
        rec.append((f"Cell_s{s}_a{a}_{i}", "cell", f"a{a}", f"g{i // 3}_{a}", int(a == 0)))
        feat.append((rec[-1][0], "F1", (RNG.normal(size=5) * 0.5 + 3 * np.eye(5)[a] + s).tolist()))
    for i in range(9):
        a = i % 3
        rec.append((f"std{a}_{i}", "standard", f"a{a}", f"std{i}", int(a == 0)))
        feat.append((rec[-1][0], "F1", (RNG.normal(size=5) * 0.5 + 3 * np.eye(5)[a] + 1).tolist()))
    r = spark.createDataFrame(rec, "id string, kind string, analyte string, grp string, fg int").cache()
    return r, spark.createDataFrame(feat, "id string, feature string, v array<double>").cache()


def value(rows, model, metric):
    return rows.filter((F.col("model") == model) & (F.col("metric") == metric)).first().value


def test_classification_across_strains_and_to_standards(world):
    rec, feat = world
    rows = T.leave_one_strain_out(rec, feat, CTX).cache()
    assert value(rows, "centroid", "balanced_accuracy") > 0.8 > 0.5 > value(rows, "majority", "balanced_accuracy")
    assert value(T.standards_from_cells(rec, feat, CTX), "centroid", "accuracy") > 0.8


def test_metadata_and_blanks(world, spark):
    rec, feat = world
    m = rec.filter("kind = 'cell'").withColumn("strain", F.substring("id", 6, 2)).withColumn("h", F.rand(1))
    rows = T.metadata_only(m, CTX, {"strain": ["s0", "s1", "s2"]}, ["h"])
    assert value(rows, "majority", "accuracy") < 0.6 and {r.feature for r in rows.collect()} == {"META"}
    blanks = spark.createDataFrame([(f"b{i}", RNG.normal(size=5).tolist(), f"a{i % 3}") for i in range(9)], "id string, v array<double>, analyte string")
    assert T.substrate_only(feat.join(rec, "id"), blanks, "centroid", "analyte").first().status in ("PASS", "FAIL")


def test_pairs_labels_and_domains(world):
    rec, feat = world
    out = T.leave_pair_out(rec, feat, ["fg"], CTX, n_boot=10)
    assert out.count() == 0  # one positive analyte only
    both = rec.withColumn("fg", (F.col("analyte") != "a2").cast("int"))
    random = T.in_domain(both, feat, ["fg"], CTX, test_share=0.4).filter("model = 'centroid'").first()
    assert random.value > 0.8 and random.scheme == "random"
    assert T.in_domain(both, feat, ["fg"], CTX, scaffold="analyte", test_share=0.7).count() == 0  # one class is missing on a side
    assert T.in_domain(both.withColumn("fg", F.lit(0)), feat, ["fg"], CTX).count() == 0
    t4 = T.across_domains(both.filter("kind = 'cell'"), both.filter("kind = 'standard'"), feat, ["fg"], CTX)
    assert t4.filter("low_support").count() == t4.count() > 0


def test_choice_of_hyperparameters(world):
    rec, feat = world
    rows = feat.join(rec.filter("kind = 'cell'"), "id")
    best, threshold, source = T.choose(rows, "logistic", "fg", "grp", [0.01, 1.0], 3)
    assert best in (0.01, 1.0) and 0 < threshold < 1 and source == "inner_cv"
    assert T.choose(rows, "majority", "fg", "grp") == (None, 0.5, "fixed")
    assert T.choose(rows.filter("grp = 'g0_0'"), "logistic", "fg", "grp") == (0.1, 0.5, "default")


def test_rows_per_analyte_and_shuffles(world):
    rec, feat = world
    rows = feat.join(rec.filter("kind = 'cell'"), "id").withColumn("strain", F.substring("id", 6, 2))
    pred = X.predictions([X.Spec("s", rows, "analyte", "grp", folds="strain", binary=False)], CTX).cache()
    assert T.per_class(pred).count() == 6
    per = T.per_analyte(pred.withColumn("score", F.lit(1.0)), rec).filter("model = 'centroid'").orderBy("rank").collect()
    assert [(r.analyte, r["rank"]) for r in per] == [("a0", 1), ("a1", 2), ("a2", 3)]
    acc = [r.accuracy for r in T.shuffled_labels(rows, "analyte", "grp", "centroid", 2).collect()]
    assert len(acc) == 2 and max(acc) < 0.8
    det = T.detectability(rows, "v", "analyte", "strain", [0.0, 20.0, 40.0, 60.0, 80.0], T.per_class(pred.filter("model = 'centroid'")), 1).collect()
    assert {r.analyte: r.bands for r in det} == {"a0": [0.0], "a1": [20.0], "a2": [40.0]} and all(r.match_rank == 1 and r.snr > 1 for r in det)


def test_twins_and_mean_areas(spark):
    rows = [("x", f"a{i}", r, float(i if r == "R1" else 2 * i), i % 2) for i in range(6) for r in ("R1", "R1q")]
    s = spark.createDataFrame(rows, "label string, analyte string, rung string, score double, y int")
    t = T.twin_agreement(s, "R1", "R1q").first()
    assert t.rho == 1.0 and t.n_labels == 1 and T.twin_agreement(s, "R1", "R1q", 9).first().rho is None
    ci = T.mean_area_ci(s.filter("rung = 'R1'"), 30).first()
    assert 0 <= ci.lo <= ci["mean"] <= ci.hi <= 1


def test_reference_reports(spark):
    cfg = variant()
    g = K.grid(*cfg["window"], cfg["grid_step"])
    good = K.lorentzian_sum([829, 755], [1, 0.4], g, 16)
    far = K.lorentzian_sum([836, 755], [1, 0.4], g, 16)
    df = spark.createDataFrame([("ok", good.tolist()), ("moved", far.tolist()), ("none", K.lorentzian_sum([1200], [1], g, 16).tolist())], "id string, y array<double>")
    mean = spark.createDataFrame([(good.tolist(),)], "mean array<double>")
    assert {r.id: r.verdict for r in T.inspect_blanks(df, cfg, mean).collect()} == {"ok": "ok", "moved": "shifted", "none": "absent"}
    b = T.band_table(df.filter("id = 'ok'"), "y", g.tolist(), [829.0]).first()
    assert b.p50 == pytest.approx(1.0, abs=0.02) and b.cv == 0
    p = spark.createDataFrame([("m", [(990.0, 1.0, 9.0), (1500.0, 1.0, 9.0)])], "name string, peaks array<struct<position:double,intensity:double,width:double>>")
    r = T.band_ratios(p, spark.createDataFrame([("m", 1000.0), ("m", 600.0)], "name string, band double")).collect()
    assert [(x.band, x.position) for x in r] == [(1000.0, 990.0)]


def test_jobs_end_to_end(spark, tmp_path, capsys):
    x = np.arange(400.0, 1901.0)
    (tmp_path / "sig").mkdir()
    for name, extra in (("CB_a_trp_1", []), ("Cell_a_trp_1", [1010]), ("Cell_a_trp_2", [1010]), ("L-tryptophan", [1010])):
        y = K.lorentzian_sum([829, 755, *extra], [1, 0.4, *[1.5] * len(extra)], x, 16)
        (tmp_path / "sig" / f"{name}.txt").write_text("\n".join(f"{a} {b:.6f}" for a, b in zip(x, y)))
    (tmp_path / "a.csv").write_text("name,code,smiles,formula,source\nL-tryptophan,trp,S,F,x\n")
    base = ["--signals", str(tmp_path / "sig"), "--analytes", str(tmp_path / "a.csv"), "--out", str(tmp_path / "out" / "rec"), "--manifest", str(tmp_path / "m.json")]
    assert jobs.main(["preflight", *base]) == 0 and jobs.main(["build_records", *base]) == 0
    rec = spark.read.parquet(str(tmp_path / "out" / "rec"))
    assert {r.id: r.text.split()[0] for r in rec.filter("kind <> 'substrate_only'").collect()} == {"Cell_a_trp_1": "1010", "Cell_a_trp_2": "1010", "L-tryptophan": "1010"}
    assert {r.split for r in rec.filter("kind = 'substrate_only'").collect()} == {"control"}
    before = sorted(p.name for p in (tmp_path / "out" / "rec").rglob("*.parquet"))
    assert jobs.main(["build_records", *base]) == 0 and before == sorted(p.name for p in (tmp_path / "out" / "rec").rglob("*.parquet"))
    assert jobs.main(["coverage_report", *base]) == 0
    capsys.readouterr()
    code = jobs.main(["check_records", *base])
    assert "| grammar |" in capsys.readouterr().out and code in (0, 1)
