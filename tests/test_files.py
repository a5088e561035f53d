import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismal.config import variant
from prismal.operators import physics as P
from prismal.sinks import files as K
from prismal.sources import files as S
from prismal.sources import jobs as J


def test_two_column_files(spark, tmp_path):
    (tmp_path / "AAs").mkdir()
    (tmp_path / "AAs" / "x 1.txt").write_text("#Wave #Int\n3 30\n2,20\n\nbad row\n1\t10\n")
    (tmp_path / "top.txt").write_text("; c\n5 1\n")
    (tmp_path / "README.txt").write_text("1 1\n")
    (tmp_path / "other.csv").write_text("1 1\n")
    rows = {r.id: r for r in S.two_columns(spark, str(tmp_path)).collect()}
    assert set(rows) == {"x 1", "top"} and rows["x 1"].x == [1, 2, 3] and rows["x 1"].y == [10, 20, 30]
    assert rows["x 1"].subset == "AAs" and rows["top"].subset == "."
    (tmp_path / "none.txt").write_text("# only\n")
    with pytest.raises(Exception, match="no numeric rows"):
        S.two_columns(spark, str(tmp_path)).collect()


def test_sticks_keep_their_order(spark, tmp_path):
    (tmp_path / "m.txt").write_text("freq act\n900 2\n700,1\nx y\n")
    r = S.sticks(spark, str(tmp_path)).first()
    assert r.id == "m" and r.freq == [900, 700] and r.inten == [2, 1]


def test_wide_csv(spark, tmp_path):
    p = tmp_path / "w.csv"
    p.write_text("id,700,600\n1,7,6\n2,8,5\n")
    df, axis = S.wide_csv(spark, str(p))
    assert axis == [600, 700] and {r.id: r.y for r in df.collect()} == {1: [6, 7], 2: [5, 8]}
    p.write_text("id,a,b\n")
    with pytest.raises(ValueError):
        S.wide_csv(spark, str(p))
    p.write_text("PLACEHOLDER\n")
    with pytest.raises(FileNotFoundError):
        S.wide_csv(spark, str(p))


def test_peaklists(spark, tmp_path):
    p = tmp_path / "p.jsonl"
    line = lambda x: json.dumps({"prompt": x, "response": "##SMILES: CCO "}) + "\n"
    p.write_text(line('Raman {"Wavenumbers": "600,700", "Intensities": "1,0.5", "Widths": ""}') + "\n")
    r = S.peaklists(spark, str(p)).first()
    assert r.smiles == "CCO" and r.x == [600, 700] and r.w == []
    p.write_text(line("nothing"))
    with pytest.raises(Exception, match="no peak object"):
        S.peaklists(spark, str(p)).collect()


def test_store_tables_and_records(spark, tmp_path):
    assert S.store(spark, str(tmp_path / "none")) is None
    df = spark.createDataFrame([("a", "v1", [1.0]), ("b", "v1", [2.0])], "id string, schema string, x array<double>")
    K.write_signals(df.drop("schema"), str(tmp_path / "sig"), variant("matched"))
    assert S.one_schema(S.store(spark, str(tmp_path / "sig"))).first().schema == "v1.2-matched"
    with pytest.raises(ValueError):
        S.one_schema(df.unionByName(df.withColumn("schema", F.lit("v2"))))
    K.write_records(df, str(tmp_path / "rec"), "v2")
    assert S.records(spark, str(tmp_path / "rec"), "v2").count() == 2 and S.records(spark, str(tmp_path / "rec"), "native").count() == 0
    acts = spark.createDataFrame([("a", "last", 3, [1.0]), ("b", "last", 4, [2.0])], "id string, position string, layer int, v array<double>")
    acts.write.partitionBy("position", "layer").parquet(str(tmp_path / "acts"))
    assert [r.id for r in S.activations(spark, str(tmp_path / "acts"), "last", 3, df).collect()] == ["a"]


def test_generic_reference_and_calibration(spark, tmp_path):
    p = tmp_path / "g.txt"
    p.write_text("# head\n501 2 3\n500 1 2\n")
    assert S.generic_reference(spark, str(p)).first().asDict() == {"x": [500, 501], "mean": [1, 2], "p90": [2, 3]}
    assert S.calibration("scale 0.967 over 58 bands\nactivity rho 0.956\nint785 rho 0.760")["convention"] == "activity"
    assert S.calibration("scale 0.967\nactivity rho 0.70\nint785 rho 0.80") == {"scale": 0.967, "convention": "int785"}


def test_tables_out(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.123456, float("nan"))], "k string, v double, w double").coalesce(1)
    K.write_table(df, str(tmp_path / "t"), ["k", "v", "w", "extra"])
    body = next((tmp_path / "t").glob("part*.csv")).read_text().splitlines()
    assert body == ["k,v,w,extra", 'a,0.1235,"",""'] or body == ["k,v,w,extra", "a,0.1235,,"]
    K.write_predictions(spark.createDataFrame([("F1", "lr", 1), ("F2", "lr", 2)], "feature string, model string, x int"), spark.createDataFrame([("F1", "lr")], "feature string, model string"), str(tmp_path / "p"))
    assert spark.read.option("header", True).csv(str(tmp_path / "p")).count() == 1
    assert K.markdown([{"a": 1, "b": None}]) == "| a | b |\n| --- | --- |\n| 1 |  |\n" and K.markdown([]) == ""
    t = spark.createDataFrame([("a", "x", 0), ("b", "y", 1)], "id string, text string, ord int")
    d1, d2 = (K.text_digest(x, "id", "text", "ord").first().digest for x in (t, t.repartition(3)))
    assert d1 == d2 and d1 != K.text_digest(t.withColumn("ord", 1 - F.col("ord")), "id", "text", "ord").first().digest
    f = tmp_path / "f"
    f.write_bytes(b"x")
    assert K.file_digest(f) == K.digest_files(spark.read.format("binaryFile").load(str(f))).first().sha256
    assert S.pick_column(t) == "id" and S.pick_column(t.withColumnRenamed("id", "Fname")) == "Fname" and S.pick_column(t.select("ord")) == "ord"
    m = spark.createDataFrame([("s", "lr", "l", "F1", 0.5), ("s", "knn", "l", "F1", 0.7), ("s", "majority", "l", "F1", 0.9)], "scheme string, model string, label string, feature string, value double")
    assert S.best_metric(m, "s").first().best == 0.7


OUT = """
* xyz 1 1
! CPCM(Water)
FINAL ENERGY EVALUATION AT THE STATIONARY POINT
CARTESIAN COORDINATES (ANGSTROEM)
---------------------------------
  C   0.0  0.0  0.0
  H   0.0  0.0  1.1

VIBRATIONAL FREQUENCIES
   0:       0.00 cm**-1
   6:     -50.10 cm**-1
   7:     900.50 cm**-1
NORMAL MODES
   8:     999.00 cm**-1
RAMAN SPECTRUM
 Mode    freq (cm**-1)   Activity   Depolarization
---------------------------------------------------
   7:       900.50      10.5      0.25
   8:      1000.00       2.0      0.75

The end
ORCA TERMINATED NORMALLY
"""


def test_job_outputs(spark, tmp_path):
    (tmp_path / "m1.out").write_text(OUT)
    jobs = J.read(spark, str(tmp_path))
    r = jobs.select(J.frequencies(F.col("text")), J.raman(F.col("text")), J.geometry(F.col("text")), J.settings(F.col("text"))).first()
    assert r[0] == [0.0, -50.1, 900.5] and [tuple(x) for x in r[1]] == [(900.5, 10.5, 0.25), (1000.0, 2.0, 0.75)]
    assert [a.symbol for a in r[2]] == ["C", "H"] and tuple(r[3]) == ("water", 1)
    want = spark.createDataFrame([("m1", 0, "water")], "name string, charge int, solvent string")
    v = J.verdicts(jobs, want).first()
    assert v.verdict == "problem" and v.problems == "1 imaginary modes; charge differs" and v.n_raman == 2
    info = J.job_info(jobs, want.withColumn("smiles", F.lit(None).cast("string")), want.withColumn("smiles", F.lit("C")).withColumn("charge", F.lit(9))).first()
    assert (info.smiles, info.charge) == ("C", 0)


def tensor_modes(spark, n=12):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        d = rng.normal(size=6)  # xx yy zz xy xz yz
        a = d[:3].mean()
        g2 = 0.5 * ((d[0] - d[1]) ** 2 + (d[1] - d[2]) ** 2 + (d[2] - d[0]) ** 2) + 3 * (d[3:] ** 2).sum()
        rows.append(("m", i, d.tolist(), 600.0 + 80 * i, float(45 * a * a + 7 * g2), float(3 * g2 / (45 * a * a + 4 * g2))))
    return spark.createDataFrame(rows, "name string, mode int, d array<double>, freq double, activity double, depol double")


def test_tensor_order_and_averages(spark):
    m = tensor_modes(spark)
    best = P.pick_order(m).first()
    assert best.order_id == 0 and best.verified
    avg = P.oriented(m, 4000).groupBy("mode").agg(F.avg("zz").alias("zz")).join(m.select("mode", P.isotropic(F.col("d")).alias("iso")), "mode").collect()
    assert all(abs(r.zz / r.iso - 1) < 0.12 for r in avg) and abs(np.mean([r.zz / r.iso for r in avg]) - 1) < 0.03
    i = P.intensities(m).filter("mode is null or convention = 'gapiso785'" if False else "convention = 'gapiso785'").count()
    assert i == 12
    g = np.arange(500.0, 1751.0)
    fit = P.fit_orientation(m, g, np.exp(-0.5 * ((g - 900) / 20) ** 2), 30).collect()
    assert {r.fit_half for r in fit} == {"low", "high"} and all(-1 <= r.heldout_cos <= 1 for r in fit)


def test_hessian_text(spark):
    text = "$polarizability_derivatives\n2\n" + "\n".join("1.0 2.0 3.0 0.1 0.2 0.3" for _ in range(2)) + "\n$raman_spectrum\n2\n 900.0 1.5 0.2\n 950.0 2.5 0.3\n\n$end\n"
    df = spark.createDataFrame([("j", text)], "name string, text string")
    rows = J.hessian_modes(df).collect()
    assert [(r.mode, r.freq, r.d[5]) for r in rows] == [(0, 900.0, 0.3), (1, 950.0, 0.3)]
    with pytest.raises(ValueError):
        J.parse_hessian(text.replace("$raman_spectrum\n2", "$raman_spectrum\n3"))


def test_scale_is_recovered_and_ranks_correlate(spark):
    freq, inten = [700.0, 1000.0, 1300.0], [1.0, 0.8, 0.6]
    peaks = [(f * 0.967, i, 10.0) for f, i in zip(freq, inten)]
    df = spark.createDataFrame([("m", freq, inten, peaks)], "name string, freq array<double>, inten array<double>, peaks array<struct<position:double,intensity:double,width:double>>")
    r = P.calibrate_scale(df, [round(0.95 + 0.001 * i, 3) for i in range(31)]).first()
    assert abs(r.scale - 0.967) <= 0.001 and r.n_bands == 3
    c = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 4.0), ("a", 3.0, 9.0), ("b", 1.0, 2.0), ("b", 1.0, 3.0)], "k string, x double, y double")
    assert {r.k: r.rho for r in P.rank_correlation(c, "x", "y", "k").collect()} == {"a": 1.0, "b": None}
