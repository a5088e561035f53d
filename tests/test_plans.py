import os
import subprocess
import sys
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismal import streaming
from prismal.config import variant
from prismal.plans import experiments as X
from prismal.plans import ladder as L
from prismal.operators import metrics as M
from prismal.operators import resample as R
from prismal.plans import queries

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
RNG = np.random.default_rng(3)


@pytest.fixture(scope="module")
def spec_rows(spark):
    y = np.arange(48) % 2
    rows = [(i, "F1", (RNG.normal(size=3) + 2 * y[i]).tolist(), int(y[i]), f"g{i // 2 * 2 + y[i]}", i // 4 % 3, f"a{i % 6}") for i in range(48)]
    return spark.createDataFrame(rows, "id long, feature string, v array<double>, y int, g string, fold int, analyte string").cache()


def test_a_spec_runs_to_metric_rows_with_intervals(spec_rows):
    ctx = X.Context(n_boot=20, n_perm=8)
    pred = X.predictions([X.Spec("s", spec_rows, "y", "g", folds="fold")], ctx).cache()
    assert pred.count() == 96 and pred.filter("model = 'centroid'").select("id").distinct().count() == 48
    rows = {r.model: r for r in X.metric_rows(pred, ctx).collect()}
    assert rows["majority"].value == pytest.approx(0.5, abs=0.2) and rows["majority"].hi >= rows["majority"].lo
    multi = X.metric_rows(pred, ctx, binary=False).filter("metric = 'balanced_accuracy' and model = 'centroid'").first()
    assert multi.value > 0.8 and multi.lo <= multi.value <= multi.hi
    p = X.permutation_p(pred.filter("model = 'centroid'").withColumn("score", F.col("pred").cast("double")), ctx).first()
    assert p.p == pytest.approx(1 / 9) and p.auroc > 0.8
    best = X.best_combo(X.metric_rows(pred, ctx, False), metric="balanced_accuracy").first()
    assert best.model == "centroid" and X.gate(X.metric_rows(pred, ctx, False), "balanced_accuracy", 0.5).filter("passes").count() >= 1


def test_refitted_shuffles_equal_brute_force(spark, spec_rows):
    ctx = X.Context(n_perm=12)
    got = X.refit_permutation(spec_rows, "v", "y", "g", "fold", ctx).first()
    rows = [r.asDict() for r in spec_rows.collect()]
    x, fold, own = (np.array([r[c] for r in rows]) for c in ("v", "fold", "y"))
    unit = lambda m: m / np.linalg.norm(m, axis=-1, keepdims=True)

    def area(y):
        s = np.zeros(len(y))
        for f in set(fold):
            fit, held = fold != f, fold == f
            c = x[fit].mean(0)
            s[held] = unit(x[held] - c) @ (unit(x[fit & (y == 1)].mean(0) - c) - unit(x[fit & (y == 0)].mean(0) - c))
        gap = s[y == 1][:, None] - s[y == 0]
        return ((gap > 1e-12) + 0.5 * (np.abs(gap) <= 1e-12)).mean()

    new = {}
    for r in R.permutations(spec_rows, "g", "y", 12).collect():
        new.setdefault(r.perm, {})[r.g] = r.y
    null = [area(np.array([new[p][r["g"]] for r in rows])) for p in range(12)]
    assert got.n_perm == 12 and got.auroc == pytest.approx(area(own)) and got.null_mean == pytest.approx(np.mean(null))
    assert got.p == pytest.approx((1 + sum(a >= area(own) - 1e-12 for a in null)) / 13)
    auroc = X.predictions([X.Spec("s", spec_rows, "y", "g", folds="fold")], X.Context(models=("centroid",))).selectExpr("cast(y as double) y", "score")
    assert M.auroc(auroc, "y", "score").first().auroc == pytest.approx(got.auroc)
    blocks = X.BLOCK
    try:
        X.BLOCK = 1  # a block a shuffle
        assert X.refit_permutation(spec_rows, "v", "y", "g", "fold", X.Context(n_perm=2)).first().auroc == pytest.approx(got.auroc)
    finally:
        X.BLOCK = blocks


def test_metric_rows_carry_refitted_nulls(spec_rows):
    ctx = X.Context(n_boot=12, n_perm=6, models=("majority", "centroid", "plsda"))
    specs = [X.Spec("s", spec_rows, "y", "g", folds="fold", hyper={"plsda": {"k": 1}})]
    rows = {r.model: r for r in X.with_nulls(X.metric_rows(X.predictions(specs, ctx), ctx), specs, ctx, "all").collect()}
    assert rows["majority"].p_perm is None and rows["majority"].n_perm is None
    for name in ("centroid", "plsda"):
        r = rows[name]
        alone = X.refit_permutation(spec_rows, "v", "y", "g", "fold", ctx, None, name, 1).first()
        assert (r.p_perm, r.n_perm, r.perm_null_mean) == (alone.p, 6, alone.null_mean) and r.value == pytest.approx(alone.auroc)
        assert r.p_perm == pytest.approx(1 / 7)
    best = X.with_nulls(X.metric_rows(X.predictions(specs, ctx), ctx), specs, ctx)
    assert best.filter("p_perm is not null").count() == 1 and best.count() == 3


def test_refits_without_rows_or_a_class(spark, spec_rows):
    odd = spec_rows.selectExpr("if(id = 0, null, v) v", "1 - y * 0 as y", "if(id = 1, null, g) g", "fold", "id as perm")
    none = X.refit_permutation(odd, "v", "y", "g", "fold", X.Context(n_perm=2)).first()
    assert none.auroc is None and X.refit_permutation(odd.limit(0), "v", "y", "g", "fold", X.Context(n_perm=2)).first().auroc is None


def test_train_test_spec_and_pairs(spec_rows):
    ctx = X.Context(models=("logistic",))
    pred = X.predictions([X.Spec("t", spec_rows.filter("fold > 0"), "y", "g", test=spec_rows.filter("fold = 0"))], ctx)
    assert pred.count() == 16
    wins = X.leave_pair_out_task(spec_rows, "analyte", "y", "logistic", ctx, max_pairs=2)
    assert wins.count() == 2 and wins.agg(F.avg("win")).first()[0] == 1.0


def test_small_tables(spark, spec_rows):
    t = {r.label: (r.ok, r.reason) for r in X.testable(spec_rows.withColumn("rare", (F.col("id") == 0).cast("int")), "analyte", ["y", "rare"]).collect()}
    assert t["y"] == (True, None) and t["rare"][0] is False and "rows" in t["rare"][1]
    d = X.design_features(spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0)], "c string, n double"), {"c": ["a", "b"]}, ["n"])
    assert sorted(r.v for r in d.collect()) == [[0.0, 0.0, 3.0], [0.0, 1.0, 2.0], [1.0, 0.0, 1.0]]
    m = spark.createDataFrame([("R0", "probe", "x", 0, 0.9, 1), ("R9", "probe", "x", 0, 0.6, 1), ("R10", "probe", "x", 0, 0.5, 2), ("R0", "probe", "x", 1, 0.1, 2)], "rung string, method string, label string, centred int, value double, layer int")
    deg = {(r.rung, r.centred): r["mean"] for r in X.degradation(m).collect()}
    assert deg["R0", 0] == 0.9 and deg["R0", 1] == 0.1
    assert [r.rung for r in X.degradation(m).filter("centred = 0").orderBy("rung_no").collect()] == ["R0", "R9", "R10"]
    assert X.transfer(m.filter("centred = 0"), "R0", "R9").first()["drop"] == pytest.approx(0.3)
    assert X.layer_sweep(m).count() == 2
    assert X.select_layer(m.withColumn("position", F.lit("last"))).first().layer == 1
    loss = X.string_loss(spark.createDataFrame([("x", "F3.snv", "lr", 0.9), ("x", "F2", "lr", 0.7), ("x", "F3", "majority", 1.0)], "label string, feature string, model string, value double")).first()
    assert loss.loss == pytest.approx(0.2)
    acc = {r.subset: (r.n, r.accuracy) for r in X.nested_accuracy(spark.createDataFrame([(1, True), (2, False)], "i int, ok boolean"), {"all": F.lit(True), "one": F.col("i") == 1, "none": F.col("i") > 9}, "ok").collect()}
    assert acc == {"all": (2, 0.5), "one": (1, 1.0), "none": (0, None)}


def test_signatures_match_across_strains(spark):
    base = {a: RNG.normal(size=20) for a in "abc"}
    rows = [(a, s, (base[a] + 0.05 * RNG.normal(size=20) + k).tolist()) for k, s in enumerate(("s1", "s2", "s3")) for a in "abc"]
    out = X.signatures(spark.createDataFrame(rows, "analyte string, strain string, v array<double>"), "v", "analyte", "strain").collect()
    assert len(out) == 9 and all(r.match_rank == 1 and r.correlation > 0.9 for r in out)


def test_ladder(spark):
    cfg = variant()
    sticks = spark.createDataFrame([("m", "neutral_gas", "activity", [714.3, 1020.4], [1.0, 0.5]), ("m", "neutral_water", "activity", [714.3], [1.0]), ("m", "neutral_gas", "other", [714.3], [1.0])], "id string, dft_set string, stick_variant string, freq array<double>, inten array<double>")
    mols = spark.createDataFrame([("m", "neutral_gas", "C"), ("m", "neutral_water", "C")], "name string, dft_set string, smiles string")
    rec = L.stick_records(sticks, mols, cfg).collect()
    assert {(r.rung, r.analyte, r.smiles) for r in rec} == {("R2", "m", "C"), ("R3", "m", "C")}
    sers = spark.createDataFrame([("x", "standard", "trp", "S", "1"), ("y", "cell", "trp", "S", "1"), ("z", "cell", None, "S", "1"), ("c", "substrate_only", "trp", "S", "1")], "id string, kind string, analyte string, smiles string, text string")
    got = L.measured_rungs(sers)
    assert {r.id for r in got.collect()} == {"R8:x", "R9:y"} and L.paired(got).count() == 2
    assert [r.id for r in L.twins(spark.createDataFrame([("q2", "S"), ("q1", "S"), ("q3", "T")], "id string, smiles string"), sers).collect()] == ["q1"]
    rows = [(f"i{i}", (RNG.normal(size=4) + 3 * (i % 2)).tolist(), i % 2, "R1" if i < 20 else "R2", f"a{i % 10}") for i in range(40)]
    t = spark.createDataFrame(rows, "id string, v array<double>, fg int, rung string, analyte string")
    out = L.probe_rungs(t, t, "v", ["fg"]).collect() + L.probe_rungs(t, t, "v", ["fg"], centred=True).collect()
    assert len(out) == 4 and all(r.auroc == 1.0 for r in out)


def test_streams(spark, tmp_path):
    from datetime import datetime

    spark.createDataFrame([("a", "abc 1", datetime(2024, 1, 1, 0, 0)), ("a", "x", datetime(2024, 1, 1, 0, 3)), ("a", "y", datetime(2024, 1, 1, 2, 0)), ("b", "z", datetime(2024, 1, 2, 0, 0))], "k string, t string, ts timestamp").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("k string, t string, ts timestamp").parquet(str(tmp_path / "in"))
    q = streaming.budget_stream(src, "t", 2).writeStream.format("memory").queryName("budget").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.t, r.n_tokens, r.fits) for r in spark.table("budget").collect()} == {("abc 1", 3, False), ("x", 1, True), ("y", 1, True), ("z", 1, True)}
    q = streaming.gap_sessions(src, "ts", "10 minutes", ["k"], "1 minute").writeStream.outputMode("append").format("memory").queryName("sessions").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.k, r.n) for r in spark.table("sessions").collect()) == [("a", 1), ("a", 2)]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cur = duck.execute(queries.ORACLES[name])
    theirs = [d[0] for d in cur.description]
    want = [dict(zip(theirs, r)) for r in cur.fetchall()]
    cols = sorted(df.columns)
    assert cols == sorted(theirs)
    key = lambda rows: sorted((tuple(round(r[c], 5) + 0.0 if isinstance(r[c], float) else r[c] for c in cols) for r in rows), key=str)
    assert key(df.collect()) == key(want)


def test_every_vector_gets_a_vote(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(11)
    x, ids = rng.normal(size=(70, 5))[rng.integers(0, 60, 70)], [i for i in range(1, 80) if i % 20][:70]  # with copies
    df = spark.createDataFrame([(i, [float(v) for v in r], i % 3) for i, r in zip(ids, x)], "vec_id long, embedding array<float>, label int")
    df.repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.query_id: r.pred for r in queries.QUERIES["neighbour_vote"](spark, str(tmp_path)).collect()}
    u = x.astype(np.float32).astype(float)
    sims = np.round((u / np.linalg.norm(u, axis=1, keepdims=True)) @ (u / np.linalg.norm(u, axis=1, keepdims=True)).T, 12)
    want = {}
    for i, s in zip(ids, sims):
        near = sorted((j for j in range(70) if ids[j] != i), key=lambda j: (-s[j], ids[j]))[:5]
        w = [round(sum(1 / max(1 - s[j], 1e-12) for j in near if ids[j] % 3 == c), 6) for c in range(3)]
        want[i] = int(np.argmax(w))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == want == dict(con.execute(queries.ORACLES["neighbour_vote"]).fetchall())


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        p = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql_is_repeatable(spark, name):
    a, b = (sorted(map(str, queries.QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert a == b and a


def test_registration_survives_without_the_optional_parts():
    code = textwrap.dedent("""
        import sys
        class No:
            def find_spec(self, name, path=None, target=None):
                if name == 'corpus_pipeline' or name.startswith('prismal.llm'):
                    raise ImportError(name)
        sys.meta_path.insert(0, No())
        import __spark_entry__ as e
        assert e.queries() and not any(n.startswith('op') and n[2].isdigit() for n in e.queries()) and 'pipeline' not in e.queries()
        assert set(e.oracle_sql()) <= set(e.queries())
    """)
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_rows_meet_all_directions_of_their_fold_in_a_batch(spark):
    rows = spark.createDataFrame([("0", [1.0, 0.0], [1.0, 0.0]), ("1", [0.0, 1.0], [0.0, 0.0]), ("2", [1.0, 1.0], [1.0, 1.0]), ("0", None, [0.0, 1.0])], "_f string, u array<double>, y array<double>")
    w = spark.createDataFrame([(-1, "0", [2.0, 3.0]), (0, "0", [4.0, 5.0]), (0, "1", [6.0, 7.0]), (-1, "1", None)], "perm int, _f string, w array<double>")
    got = sorted((r.perm, r.y, r.score) for r in X._directed(rows, w, -1, 2).collect())
    assert got == sorted([(-1, 1.0, 2.0), (0, 0.0, 4.0), (-1, 0.0, 0.0), (0, 0.0, 7.0), (-1, 1.0, 0.0), (0, 1.0, 0.0), (-1, 0.0, 0.0), (0, 1.0, 0.0)])
