"""The shift ladder: rungs of ever more realistic records, probes scored on each."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from prismal.functions import arrays as A
from prismal.operators import linear as N
from prismal.operators import metrics as M
from prismal.operators import records as B
from prismal.operators import references as J
from prismal.operators import vectors as V
from prismal.session import settled, ship

#: Fixed values of the rungs: name, what it is, source set and stick variant.
RUNGS = [
    ("R1", "calibration, gas", "calibration_gas", "activity"), ("R2", "neutral, gas", "neutral_gas", "activity"), ("R3", "neutral, water", "neutral_water", "activity"),
    ("R4", "zwitterion, water", "zwitterion_water", "activity"), ("R5", "785 nm factor", "zwitterion_water", "int785"), ("R6", "surface orientation", "zwitterion_water", "gapiso785"),
]


def rung_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RUNGS, "rung string, title string, dft_set string, stick_variant string")


def stick_records(sticks: DataFrame, molecules: DataFrame, cfg: dict) -> DataFrame:
    """Records of every rung from sticks ``id, dft_set, stick_variant, freq, inten`` and molecules ``name, dft_set, smiles``; empty texts are left out."""
    rungs = F.broadcast(rung_table(sticks.sparkSession).drop("title"))
    rows = sticks.join(rungs, ["dft_set", "stick_variant"]).join(F.broadcast(molecules.select(F.col("name").alias("id"), "dft_set", "smiles")), ["id", "dft_set"], "left")
    made = B.from_sticks(rows.select(F.concat_ws("|", "rung", "id").alias("id"), "freq", "inten"), cfg).drop("smiles")
    named = made.withColumn("rung", F.regexp_extract("id", r"^dft_([^|]+)\|", 1)).withColumn("analyte", F.substring_index("analyte", "|", -1))
    keys = rows.select("rung", F.col("id").alias("analyte"), "dft_set", "stick_variant", "smiles")
    return named.join(keys, ["rung", "analyte"]).filter(F.col("text") != "")


def measured_rungs(records: DataFrame) -> DataFrame:
    """Standards as R8 and cells as R9; rows without an analyte, molecule or text are left out."""
    rung = F.when(F.col("kind") == "standard", "R8").when(F.col("kind") == "cell", "R9")
    ok = rung.isNotNull() & F.col("analyte").isNotNull() & F.col("smiles").isNotNull() & (F.coalesce("text", F.lit("")) != "")
    return records.filter(ok).withColumn("rung", rung).withColumn("id", F.concat_ws(":", rung, "id"))


def twins(records: DataFrame, molecules: DataFrame, key: str = "smiles", order: str = "id") -> DataFrame:
    """The first simulated record of each wanted molecule, as rung R1q."""
    wanted = records.join(F.broadcast(molecules.select(key).distinct()), key, "left_semi")
    return J.first_per_key(wanted, key, order).withColumn("rung", F.lit("R1q"))


def paired(records: DataFrame, analyte: str = "analyte", rung: str = "rung") -> DataFrame:
    """Rows of analytes that every rung has."""
    return J.complete_keys(records, analyte, rung)


def probe_rungs(train: DataFrame, rungs: DataFrame, vector: str, labels: list[str], centred: bool = False) -> DataFrame:
    """Mass-mean probes of each label, scored on every rung by analyte: ``label, rung, auroc, n_pos, n_neg, centred``.

    Standardisation, and with ``centred`` the domain means, come from training
    rows and each rung's own unlabelled rows.
    """
    tr = V.standardise(train, train, vector, "_z")
    te = V.standardise(train, rungs, vector, "_z")
    if centred:
        tr = V.centre_by_domain(tr.withColumn("rung", F.lit("train")), "_z", "rung", None, "_c").drop("_z").withColumnRenamed("_c", "_z")
        te = V.centre_by_domain(te, "_z", "rung", "analyte", "_c").drop("_z").withColumnRenamed("_c", "_z")
    parts = []
    for name in labels:
        on = F.coalesce(F.col(name), F.lit(0))
        two = tr.select("_z", on.alias("_label"))
        test = te.select(F.monotonically_increasing_id().alias("_id"), "_z", on.alias("_label"), "rung", "analyte")
        w = V.explode_vector(two, "_z", ["_label"]).groupBy("k").agg(F.avg(F.when(F.col("_label") > 0, F.col("v"))).alias("p"), F.avg(F.when(F.col("_label") == 0, F.col("v"))).alias("q"))
        packed = w.agg(F.array_sort(F.collect_list(F.struct("k", (F.col("p") - F.col("q")).alias("w"), ((F.col("p") + F.col("q")) / 2).alias("m")))).alias("_w"))
        score = F.aggregate(F.zip_with("_z", "_w", lambda x, t: (x - t["m"]) * t["w"]), F.lit(0.0), lambda s, x: s + x)
        scored = test.crossJoin(F.broadcast(packed)).select("rung", "analyte", F.col("_label").alias("y"), score.alias("score"))
        per = scored.groupBy("rung", "analyte").agg(F.avg("score").alias("score"), (F.avg("y") >= 0.5).cast("int").alias("y"))
        parts.append(M.auroc(per, "y", "score", "rung").withColumn("label", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b), parts).withColumn("centred", F.lit(int(centred)))


#: Strengths that are tried. Fixed values.
STRENGTHS = (0.001, 0.01, 0.1)


@dataclass
class Probes:
    """Fitted probes: ``table`` (``label, source, c, validation, chosen``) and the weights of each source at its strength."""

    table: DataFrame
    labels: list[str]
    sources: list
    weights: np.ndarray
    bias: np.ndarray

    def score(self, rows: DataFrame, vector: str, source: str, keep: list[str]) -> DataFrame:
        """``*keep, source, label, score`` of every row by the probes of its source."""
        at = F.array_position(F.array(*(F.lit(x) for x in self.sources)), F.col(source)) - 1
        return _scores(rows.filter(F.col(source).isin(self.sources)), A.doubles(F.col(vector)), at, self.weights, self.bias, keep, source, self.labels)


def _scores(rows: DataFrame, vector, at, weights: np.ndarray, bias: np.ndarray, keep: list[str], source: str, names: list) -> DataFrame:
    """``*keep, source, label, score``: a row for each column of the weights."""
    ship(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = sent.value
        for batch in batches:
            if batch.num_rows:
                x, f = N.matrix(batch.column(0)), batch.column(1).to_numpy()
                s = np.einsum("nd,ndk->nk", x, w[f]) + b[f]
                given = [c for c in batch.columns[2:]]
                yield pa.RecordBatch.from_arrays([*given, pa.array(list(s), pa.list_(pa.float64()))], [*keep, source, "s"])

    use = rows.select(vector.alias("x"), at.cast("int").alias("f"), *keep, source)
    schema = rows.select(*keep, source).schema.add("s", T.ArrayType(T.DoubleType()))
    label = F.get(F.array(*(F.lit(n) for n in names)), F.col("k"))
    return use.mapInArrow(run, schema).select(*keep, source, F.posexplode("s").alias("k", "score")).select(*keep, source, label.alias("label"), "score")


def joint_probes(train: DataFrame, validation: DataFrame, labels: list[str], vector: str = "v", source: str = "source", strengths: tuple[float, ...] = STRENGTHS) -> Probes:
    """Logistic probes of all labels, sources and strengths, fitted together; strength and source are chosen on the validation rows.

    Rows are one source (a layer, or a position and layer) of one record: a
    vector, all of one width, and a 0/1 column for each label, a null counting as
    0.  Every pass over the training rows serves all labels, sources and
    strengths.  A source takes the strength with the best mean area over its labels on
    validation, the first of equal ones; a label takes the source with the best
    area, the first by name of equal ones (``chosen``).  Rungs play no part.
    """
    names = [r[0] for r in train.select(source).distinct().orderBy(source).collect()]
    spot = F.array_position(F.array(*(F.lit(x) for x in names)), F.col(source)) - 1
    on = [(F.coalesce(F.col(n), F.lit(0)) > 0).cast("int").alias(n) for n in labels]
    rows = settled(train.filter(F.col(vector).isNotNull() & F.col(source).isNotNull()).select(A.doubles(F.col(vector)).alias("x"), spot.cast("int").alias("fold"), *on), "probes")
    each = np.repeat(np.asarray(strengths, float), len(labels))
    fit = N.joint_logistic(rows, N.with_strengths(N.given, len(strengths)), each, len(names), within=True)
    columns = [f"{c}|{n}" for c in range(len(strengths)) for n in labels]
    held = validation.filter(F.col(source).isin(names)).withColumn("_y", F.array(*on))
    scored = _scores(held, A.doubles(F.col(vector)), spot, fit.weights, fit.bias, ["_y"], source, columns)
    parts = F.split("label", "[|]", 2)
    scored = scored.select(source, parts[0].cast("int").alias("c"), parts[1].alias("label"), "score", "_y")
    truth = F.get("_y", F.array_position(F.array(*(F.lit(n) for n in labels)), F.col("label")).cast("int") - 1)
    areas = settled(M.auroc(scored.withColumn("y", truth), "y", "score", [source, "c", "label"]).select(source, "c", "label", F.col("auroc").alias("validation")), "areas")
    best = areas.groupBy(source, "c").agg(F.avg("validation").alias("m"))
    first = best.withColumn("r", F.row_number().over(W.partitionBy(source).orderBy(F.desc_nulls_last("m"), "c"))).filter("r = 1").select(source, "c")
    own = areas.join(first, [source, "c"])
    rank = F.row_number().over(W.partitionBy("label").orderBy(F.desc_nulls_last("validation"), source))
    strength = F.get(F.array(*(F.lit(float(c)) for c in strengths)), F.col("c"))
    table = own.select("label", source, strength.alias("c"), "validation", (rank == 1).alias("chosen"))
    picked = {r[source]: r.c for r in first.collect()}
    take = np.array([[picked.get(n, 0) * len(labels) + k for k in range(len(labels))] for n in names])
    weights = np.stack([fit.weights[f][:, t] for f, t in enumerate(take)]) if names else fit.weights
    bias = np.stack([fit.bias[f][t] for f, t in enumerate(take)]) if names else fit.bias
    return Probes(table, labels, names, weights, bias)


def joint_rungs(probes: Probes, rungs: DataFrame, vector: str = "v", source: str = "source", centred: bool = False) -> DataFrame:
    """Areas of the chosen probes on every rung, one score and label an analyte: ``label, rung, source, auroc, n_pos, n_neg, centred``.

    ``rungs`` are ``id, rung, analyte``, a vector a source and the label columns.  With
    ``centred`` a rung's own mean, over its analytes' means, is taken off first.
    """
    rows = rungs
    if centred:
        rows = rows.withColumn("_domain", F.concat_ws("|", source, "rung"))
        rows = V.centre_by_domain(rows, vector, "_domain", "analyte", "_c").drop(vector, "_domain").withColumnRenamed("_c", vector)
    rows = rows.withColumn("_y", F.array(*((F.coalesce(F.col(n), F.lit(0)) > 0).cast("int") for n in probes.labels)))
    scored = probes.score(rows, vector, source, ["rung", "analyte", "_y"])
    truth = F.get("_y", F.array_position(F.array(*(F.lit(n) for n in probes.labels)), F.col("label")).cast("int") - 1)
    chosen = probes.table.filter("chosen").select("label", source)
    per = scored.join(chosen, ["label", source]).withColumn("y", truth).groupBy("label", source, "rung", "analyte").agg(F.avg("score").alias("score"), (F.avg("y") >= 0.5).cast("int").alias("y"))
    return M.auroc(per, "y", "score", ["label", source, "rung"]).select("label", "rung", source, "auroc", "n_pos", "n_neg", F.lit(int(centred)).alias("centred"))
