import numpy as np
import pytest
from pyspark.sql import functions as F

from prismal.config import overlay, variant
from prismal.functions import arrays as A
from prismal.functions import kernels as K
from prismal.functions import text as X
from prismal.operators import checks as Q
from prismal.operators import features as FT
from prismal.operators import records as B
from prismal.operators import references as J

CFG = variant()
AXIS = np.arange(400.0, 1901.0)


def spectrum(scale=1.0, shift=0.0, analyte=(), cb=(829, 755, 880), base=True):
    heights = dict(zip((829, 755, 880), (1.0, 0.4, 0.5)))
    p = [(c + shift, heights[c], 16) for c in cb] + [(a + shift, h, 16) for a, h in analyte]
    y = K.lorentzian_sum([a for a, _, _ in p], [b for _, b, _ in p], AXIS, [c for _, _, c in p])
    return (scale * (y + (2 + 0.001 * AXIS if base else 0))).tolist()


@pytest.fixture(scope="module")
def analytes(spark):
    return spark.createDataFrame([("L-tryptophan", "trp", "SMI1"), ("L-tyrosine", "tyr", "SMI2")], "name string, code string, smiles string")


def loaded(spark):
    trp = ((1010, 1.6), (1340, 0.8))
    rows = [(f"CB_536_trp_{i}", AXIS.tolist(), spectrum(3.0 + i)) for i in range(3)]
    rows += [(f"Cell_536_trp_{i}", AXIS.tolist(), spectrum(5.0 * (i + 1), analyte=trp)) for i in range(2)]
    rows += [("L-tyrosine", AXIS.tolist(), spectrum(2.0, analyte=((640, 0.7),))), ("Cell_9_tyr_1", AXIS.tolist(), spectrum(2.0, analyte=((640, 0.7),), cb=()))]
    return spark.createDataFrame(rows, "id string, x array<double>, y array<double>")


@pytest.fixture(scope="module")
def built(spark, analytes):
    rows = B.measured(loaded(spark), CFG, analytes)
    return {r.id: r for r in B.by_mode(rows, CFG).collect()}


def positions(r):
    return [round(p.position) for p in r.peaks]


def test_substrate_bands_go_and_analyte_peaks_stay(built):
    r = built["Cell_536_trp_0"]
    assert positions(r) == [1010, 1340] and r.substrate.mode_used == "reference_norm" and r.substrate.reference == "mean(536_trp, n=3)"
    assert r.substrate.n_masked == 3 and r.analyte == "L-tryptophan" and r.grp == "Cell_536_trp" and r.kind == "cell"
    assert r.peaks[0].intensity == pytest.approx(1.6, abs=0.1)


def test_text_does_not_depend_on_overall_intensity(built):
    assert built["Cell_536_trp_0"].text == built["Cell_536_trp_1"].text


def test_unpaired_rows_use_the_generic_reference(built):
    r = built["L-tyrosine"]
    assert r.substrate.reference.startswith("generic(n=3") and positions(r) == [640]


def test_a_missing_band_is_flagged_and_nothing_is_dropped(built):
    r = built["Cell_9_tyr_1"]
    assert r.substrate.mode_used == "max_in_window(ref_missing)" and positions(r) == [640] and r.peaks[0].intensity == pytest.approx(1, abs=0.05)


def test_rescaling_and_axis_alignment(spark, analytes):
    cfg = variant("v2m")
    rows = [("CB_a_trp_1", AXIS.tolist(), spectrum(3.0)), ("Cell_a_trp_1", AXIS.tolist(), spectrum(4.0, shift=-5.0, analyte=((1010, 1.6),)))]
    df = spark.createDataFrame(rows, "id string, x array<double>, y array<double>")
    out = {r.id: r for r in B.by_mode(B.measured(df, cfg, analytes), cfg).collect()}
    r = out["Cell_a_trp_1"]
    assert r.substrate.shift == pytest.approx(5, abs=1.01) and r.substrate.mode_used == "reference_norm+rescaled"
    assert positions(r)[0] == pytest.approx(1010, abs=1) and max(p.intensity for p in r.peaks) == 1.0 and r.schema == "v1.2-v2m"


def test_duplicate_ids_raise(spark, analytes):
    df = loaded(spark)
    with pytest.raises(Exception, match="duplicate id"):
        B.measured(df.unionByName(df.limit(1)), CFG, analytes).collect()


@pytest.mark.parametrize("mode", ["none", "mask", "paired", "mean_ref"])
def test_other_modes(spark, analytes, mode):
    cfg = overlay(CFG, {"substrate.mode": mode})
    out = {r.id: r for r in B.by_mode(B.measured(loaded(spark), cfg, analytes), cfg).select("id", "peaks", "substrate").collect()}
    got = positions(out["Cell_536_trp_0"])
    assert {1010, 1340} <= set(got)
    assert (829 in got) == (mode == "none")


def test_unknown_mode_raises(spark, analytes):
    cfg = overlay(CFG, {"substrate.mode": "zap"})
    with pytest.raises(ValueError):
        B.by_mode(spark.createDataFrame([], "id string, y array<double>, kind string, analyte string, smiles string"), cfg)


def test_simulated_sticks_and_peaklists(spark):
    g = K.grid(400, 1900, 1)
    sig = spark.createDataFrame([(1, K.lorentzian_sum([700, 1200], [1, 0.5], g, 12).tolist()), (2, [0.0] * len(g)), (3, [1.0] * len(g))], "id long, y array<double>")
    mols = spark.createDataFrame([(1, "C"), (2, "CC")], "number long, smiles string")
    out = B.simulated(sig, g.tolist(), mols, CFG).collect()
    assert [(r.id, r.smiles, positions(r)) for r in out] == [("qm9s_1", "C", [700, 1200])]
    st = spark.createDataFrame([("m", [714.2857, 1224.489], [10.0, 5.0]), ("z", [700.0], [0.0])], "id string, freq array<double>, inten array<double>")
    out = B.from_sticks(st, CFG).collect()
    assert [(r.id, positions(r)) for r in out] == [("dft_m", [700, 1200])]
    pl = spark.createDataFrame([(1, "C", [600.0, 800.0, 3000.0], [0.4, 0.2, 1.0], [15.3, 15.3, 15.3]), (2, "N", [3000.0], [1.0], [15.0])], "id long, smiles string, x array<double>, y array<double>, w array<double>")
    r = B.from_peaklists(pl, CFG).collect()
    assert len(r) == 1 and r[0].text == "600 1.00 10 | 800 0.50 10" and r[0].effective_floor == 0.25 and r[0].window_max_global == 0.4


def test_splits_keep_controls_apart(spark):
    df = spark.createDataFrame([(f"i{k}", f"g{k // 2}", "a" if k < 10 else None, "cell" if k else "substrate_only") for k in range(20)], "id string, grp string, analyte string, kind string")
    out = B.assign_splits(df, CFG).collect()
    assert {r.split for r in out} == {"train", "test", "control"} and [r.split for r in out if r.kind == "substrate_only"] == ["control"]
    assert all(len({r.split for r in out if r.grp == g and r.kind == "cell"}) == 1 for g in {r.grp for r in out})


def test_top_up_counts_as_it_goes(spark):
    c = spark.createDataFrame([(i, int(i < 6), int(i % 2 == 0)) for i in range(12)], "id int, a int, b int")
    got = {r.id for r in B.top_up(c, c.filter("id = 0"), ["a", "b"], 4).collect()}
    assert 0 in got and len([i for i in got if i < 6]) >= 4 and len([i for i in got if i % 2 == 0]) >= 4


def test_labels_and_features(spark):
    rec = spark.createDataFrame([("r1", "C", "700 0.50 9 | 1200 1.00 12"), ("r2", "N", "")], "id string, smiles string, text string")
    lab = B.add_labels(rec, spark.createDataFrame([("C", {"fg_x": 1})], "smiles string, labels map<string,int>"))
    assert {r.id: r.labels for r in lab.collect()} == {"r1": {"fg_x": 1}, "r2": None}
    store = spark.createDataFrame([("r1", [1.0, 2.0], [2.0, 4.0]), ("r2", [0.0, 1.0], [0.0, 0.0])], "id string, x829 array<double>, xsub array<double>")
    f = {(r.id, r.feature): r.v for r in FT.feature_set(rec, CFG, store).collect()}
    assert f["r1", "F1"][20] == 0.5 and f["r1", "F1pos"][70] == 1.0 and f["r1", "F3"] == [1.0, 2.0] and sum(f["r2", "F1"]) == 0
    assert f["r1", "F2"][700] == pytest.approx(1.0, abs=0.01)
    assert len(FT.axis("F1", CFG)) == 125 and len(FT.axis("F2", CFG)) == 1251
    with pytest.raises(ValueError):
        FT.feature_table(rec, "F9", CFG)
    assert FT.stored(store, variant("matched")).filter("id = 'r1'").first().v == [0.5, 1.0]
    more = FT.with_steps(FT.feature_table(rec, "F1", CFG), {"F1": [["sqrt"], ["snv", "sqrt"]]}, {})
    assert {r.feature for r in more.select("feature").distinct().collect()} == {"F1", "F1.sqrt", "F1.snv.sqrt"}


def test_explained_peaks(spark):
    kind = "struct<p:array<struct<position:double,intensity:double,width:double>>,b:array<struct<position:double,height:double>>>"
    row = ([(758.0, 1.0, 9.0), (760.0, 0.3, 9.0), (900.0, 0.2, 9.0)], [(755.0, 0.4), (761.0, 0.4)])
    s = spark.createDataFrame([(row,)], f"r {kind}").select(A.split_explained(F.col("r.p"), F.col("r.b"), 5, 0.1, 1.5)).first()[0]
    assert [p.position for p in s.kept] == [758.0, 900.0] and [p.position for p in s.dropped] == [760.0]


def test_references_fall_back_to_the_pair(spark):
    refs = spark.createDataFrame([("CB_a_1", [1.0]), ("CB_a_2", [3.0])], "id string, v array<double>")
    s = spark.createDataFrame([("Cell_a_2",), ("x",)], "id string")
    assert {r.id: (r.ref, r.ref_label) for r in J.find_reference(s, refs, "v").collect()} == {"Cell_a_2": ([2.0], "mean(a, n=2)"), "x": (None, None)}
    assert {r.id: r.ref_label for r in J.find_reference(s, refs, "v", "same_index").collect()} == {"Cell_a_2": "CB_a_2", "x": None}


def test_alignment_finds_the_one_right_mapping(spark):
    rng = np.random.default_rng(0)
    flags = rng.integers(0, 2, 60)
    mols = spark.createDataFrame([(int(i * 3 + 5), i, i, int(flags[i])) for i in range(60)], "number long, list_pos long, row long, ring int")
    sig = spark.createDataFrame([(i * 3 + 5, float(flags[i]) + 0.1 * float(rng.random())) for i in range(60)], "id long, score double")
    out = J.evaluate_joins(mols, sig, {"ring": "score"})
    assert [r.candidate for r in out.filter("passes").collect()] == ["number"] and J.one_alignment(out).first().ok


# ---- checks: each passes clean records and fails on an injected fault

CLEAN = [(f"s_{i}", f"g_{i}", f"{600 + 10 * i} 1.00 9", "train" if i % 2 else "test", f"a{i % 3}") for i in range(8)]
COLS = "id string, grp string, text string, split string, analyte string"


def status(df):
    r = df.first()
    assert r.check and isinstance(r.examples, list)
    return r.status


@pytest.mark.parametrize(
    ("check", "fault", "bad"),
    [
        (lambda d: Q.grammar(d, CFG), ("b", "gb", "600 1.0 9", "train", "a"), "FAIL"),
        (lambda d: Q.grammar(d, CFG), ("b", "gb", None, "train", "a"), "FAIL"),
        (lambda d: Q.forbidden_terms(d, ["tyr"], group_col="grp"), ("b", "gb", "600 tyr 9", "train", "a"), "FAIL"),
        (lambda d: Q.forbidden_terms(d, ["tyr"], group_col="grp"), ("b", "gb", "600 g_3 9", "train", "a"), "FAIL"),
        (Q.split_disjoint, ("s_1", "gb", "610 1.00 9", "train", "a"), "FAIL"),
        (Q.split_disjoint, ("b", "g_1", "610 1.00 9", "test", "a"), "FAIL"),
        (Q.exact_duplicates, ("b", "gb", "600 1.00 9", "train", "a0"), "FAIL"),
        (Q.exact_duplicates, ("b", "gb", "600 1.00 9", "train", "a9"), "WARN"),
        (lambda d: Q.token_budget(d, 30), ("b", "gb", " | ".join(["600 1.00 9"] * 9), "train", "a"), "FAIL"),
    ],
)
def test_checks_catch_an_injected_fault(spark, check, fault, bad):
    clean = spark.createDataFrame(CLEAN, COLS)
    assert status(check(clean)) == "PASS"
    assert status(check(clean.unionByName(spark.createDataFrame([fault], COLS)))) == bad


def test_controls_template_and_exit_code(spark):
    assert status(Q.template(spark, "x {text}", ["tyr"])) == "PASS" and status(Q.template(spark, "x {text} tyr", ["tyr"])) == "FAIL" and status(Q.template(spark, "x", [])) == "FAIL"
    nulls = spark.createDataFrame([(0.3,), (0.32,)], "v double")
    assert status(Q.shuffled_control(0.9, nulls, "v", 0.3)) == "PASS" and status(Q.shuffled_control(0.9, nulls, "v", 0.1)) == "FAIL"
    p = spark.createDataFrame([("a", "a")] * 6, "y string, p string")
    assert status(Q.blank_control(p, "y", "p", 0.2)) == "FAIL" and status(Q.blank_control(p.limit(2), "y", "p", 0.2)) == "SKIP"
    pairs = spark.createDataFrame([("a", True)], "left_id string, same_label boolean")
    assert status(Q.near_duplicates(pairs)) == "WARN" and status(Q.near_duplicates(pairs.limit(0))) == "PASS"
    no_split = spark.createDataFrame([("a", "g", None)], "id string, grp string, split string")
    assert status(Q.split_disjoint(no_split)) == "SKIP"
    both = Q.run_all(Q.template(spark, "x", []), Q.near_duplicates(pairs))
    assert both.count() == 2 and Q.worst(both).first().exit_code == 1
    leaks = Q.legacy_leaks(spark.createDataFrame([("a", "smiles"), ("b", "x")], "id string, t string"), {"smiles": F.contains("t", F.lit("smiles"))})
    assert [(r.id, r.leaks) for r in leaks.collect()] == [("a", "smiles")]
    assert X.label_terms(["Tyr", "x", None]) == ["tyr"]


def test_a_raster_makes_its_peaks_once(spark):
    # a peak in a random place fills one bin only if it is not drawn again for every bin
    peak = F.struct((500 + 1250 * F.rand(1)).alias("position"), F.lit(1.0).alias("intensity"))
    v = spark.range(50).select(X.raster(F.array(peak), 500.0, 1750.0).alias("v")).collect()
    assert all(sum(r.v) == 1 and len(r.v) == 125 for r in v)
    nulls = spark.range(1).select(X.raster(F.lit(None).cast("array<struct<position:double,intensity:double>>"), 0.0, 20.0).alias("v")).first()
    assert nulls.v == [None, None]
