import math
import random

import pytest
from pyspark.sql import functions as F

from prismal import config
from prismal.functions import ids as I
from prismal.functions import text as X
from prismal.schema import PEAKS

CFG = config.variant()


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


def test_variants_and_overlays():
    v = config.variant("v2mf")
    assert v["schema"] == "v1.2-v2mf" and v["window"] == [510.0, 1800.0] and v["sim_freq_scale"] == 1.0134
    assert config.BASE["window"] == [500.0, 1750.0]
    with pytest.raises(ValueError):
        config.variant("nope")
    with pytest.raises(KeyError):
        config.overlay(config.BASE, {"no.such.path": 1})


def test_fixed_decimals_equal_pythons(spark):
    rng = random.Random(0)
    values = [rng.uniform(0, 2) for _ in range(3000)] + [k / 200 for k in range(400)] + [k + 0.5 for k in range(40)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(X.fixed(F.col("v"), 2), X.fixed(F.col("v"), 0)).collect()
    assert [r[0] for r in got] == [f"{round(v, 2):.2f}" for v in values]
    assert [r[1] for r in got] == [str(int(round(v))) for v in values]


def test_round_trip_and_order(spark):
    peaks = [(1200.4, 1.3, -12.0), (700.5, -0.2, 8.6)]
    text = one(spark, lambda c: X.peaks_text(c, CFG), peaks, PEAKS.simpleString())
    assert text == "700 0.00 9 | 1200 1.30 12"
    back = one(spark, lambda c: X.parse_peaks(c, CFG), text)
    assert [tuple(p) for p in back] == [(700.0, 0.0, 9.0), (1200.0, 1.3, 12.0)]


def test_bad_text_raises_and_empty_has_no_peaks(spark):
    assert one(spark, lambda c: X.parse_peaks(c, CFG), "") == []
    assert one(spark, lambda c: X.parse_peaks(c, CFG, False), "700 0.5 9") is None
    with pytest.raises(Exception, match="does not match"):
        one(spark, lambda c: X.parse_peaks(c, CFG), "700 0.5 9")


def test_raster_edges(spark):
    peaks = [(500.0, 0.1, 1.0), (509.9, 0.4, 1.0), (510.0, 0.2, 1.0), (1750.0, 0.3, 1.0), (90.0, 0.05, 1.0)]
    v = one(spark, lambda c: X.raster(c, 500, 1750), peaks, PEAKS.simpleString())
    assert len(v) == 125 and v[0] == 0.4 and v[1] == 0.2 and v[124] == 0.3 and sum(x > 0 for x in v) == 3


def test_token_estimate(spark):
    assert one(spark, X.estimate_tokens, "abcd 12, x") == 2 + 1 + 2 + 1 + 1 + 1
    assert one(spark, X.estimate_tokens, None) == 0
    assert one(spark, X.estimate_tokens, "a\u00a0\u2003b\u0663é") == 5


def test_terms_need_non_letters_around(spark):
    p = X.term_pattern(["trp", "L-tyr"])
    rows = spark.createDataFrame([("a trp b",), ("strpx",), ("TRP1",), ("l-TYRx",), ("",)], "t string").select(F.col("t").rlike(p)).collect()
    assert [r[0] for r in rows] == [True, False, True, True, False]
    assert one(spark, lambda c: c.rlike(X.term_pattern([])), "anything") is False


def test_fields_and_prompt(spark):
    assert one(spark, lambda c: X.keep_fields(c, CFG, "position"), "700 0.50 9 | 800 1.00 7") == "700 | 800"
    r = one(spark, lambda c: X.prompt(c, "a {text} b"), "xyz")
    assert r.prompt[r.start : r.stop] == "xyz"
    with pytest.raises(ValueError):
        X.prompt(F.lit(""), "none")


def test_ids(spark):
    cases = {"Cell_Cell_BW_pro_18": "Cell_BW_pro_18", "Cell_CB_536_trp_4": "CB_536_trp_4", "AAs_L-threonine": "L-threonine", "indoles_oxindole": "oxindole", "Cell_x": "Cell_x"}
    for raw, want in cases.items():
        assert one(spark, I.normal_id, raw) == want
    assert [one(spark, f, "Cell_536_trp_3") for f in (I.kind, I.group, I.strain, I.pair_name, I.condition)] == ["cell", "Cell_536_trp", "536", "CB_536_trp_3", "536_trp"]
    assert one(spark, I.strain, "a:b_c") == "?"


def test_analyte_rules(spark):
    a = spark.createDataFrame([("L-tyrosine", "tyr", "s1"), ("tyrosine", "tyx", "s2"), ("L-alanine", "ala", "s3"), ("indole", "ala", "s4")], "name string, code string, smiles string")
    ids = ["L-tyrosine", "CB_L-tyrosine_1", "Cell_BW_tyr_1", "Cell_BW_ala_1", "nothing", None]
    got = {r.id: r.analyte for r in I.with_analyte(spark.createDataFrame([(i,) for i in ids], "id string"), a).collect()}
    assert got == {"L-tyrosine": "L-tyrosine", "CB_L-tyrosine_1": "L-tyrosine", "Cell_BW_tyr_1": "L-tyrosine", "Cell_BW_ala_1": None, "nothing": None, None: None}


def test_subsample_share_and_identity_with_zlib(spark):
    import zlib

    ids = [f"q_{i}" for i in range(500)]
    got = {r.id for r in spark.createDataFrame([(i,) for i in ids], "id string").filter(I.in_subsample(F.col("id"), 0.2)).collect()}
    assert got == {i for i in ids if zlib.crc32(i.encode()) / 2**32 < 0.2}


def test_missing_values_in_text_helpers(spark):
    df = spark.createDataFrame([(float("nan"), None, None)], "a double, b double, c string")
    r = df.select(X.rounded(F.col("a")), X.interval_text(F.col("a"), F.col("b"), F.col("b")), X.tagged_text({"x": F.col("c")}), X.truthy(F.col("c"))).first()
    assert r[0] is None and r[1] == "n/a" and r[2] == "x: NA" and r[3] is False
    assert math.isclose(1.0, 1.0)
