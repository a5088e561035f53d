"""Leave-pair-out of centroid models for all pairs and label shuffles in one plan.

What a pair's model is fitted on is all rows less two analytes, so its centre
and class means are totals less two analytes' sums.  Only the directions depend
on the labels: rows meet the centres once, as the sum of their unit deviations
for every pair, and each pair's sums then meet the directions of all shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismal.functions import arrays as A
from prismal.operators import resample as R
from prismal.operators import shuffles as H
from prismal.operators import vectors as V
from prismal.session import settled, ship

#: Numbers of a block of analytes' sums that is broadcast: 32 MB.
BLOCK = 4_000_000
#: Numbers that a task works on at once.
CHUNK = 1_000_000
#: Tasks that may share an analyte's rows.
SALTS = 256

PAIRS = "perm int, pos string, neg string, pos_score double, neg_score double"
_KINDS = {"long": pa.int64(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}
_PART = "lo long, hi long, lo_name string, hi_name string, own long, u array<double>, s_lo array<double>, s_hi array<double>, n_lo long, n_hi long, y_lo long, y_hi long"
_FIELDS = pa.schema([(name, _KINDS[kind]) for name, kind in (f.split() for f in _PART.split(", "))])


def _units(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero stays."""
    size = np.linalg.norm(v, axis=-1, keepdims=True)
    return np.divide(v, size, out=np.array(v, float), where=size > 0)


def _matrix(column: pa.ListArray, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _deviations(sums: pd.DataFrame, total: np.ndarray, m: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's rows against the centres of one block of analytes: parts of the sums of unit deviations, a row a pair."""
    at, names, n, y = (sums[c].to_numpy() for c in ("pos", "name", "n", "y"))
    s = np.stack(sums["s"].to_numpy())

    def add(u: np.ndarray, own: dict, v: np.ndarray) -> None:
        step = max(1, CHUNK // max(1, v.size))
        for k in range(0, len(s), step):
            b = slice(k, k + step)
            left = np.maximum(m - own["n"] - n[b], 1)[:, None]
            centre = (total - own["s"] - s[b]) / left
            u[b] += _units(v[None] - centre[:, None]).sum(axis=1)

    def parts(own: dict, u: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, CHUNK // (4 * len(total)))
        others = [j for j in range(len(s)) if at[j] != own["pos"]]
        for k in range(0, len(others), step):
            rows = []
            for j in others[k : k + step]:
                ends = [(own["pos"], own["name"], own["s"], own["n"], own["y"]), (at[j], names[j], s[j], n[j], y[j])]
                lo, hi = sorted(ends, key=lambda e: e[0])
                rows.append((lo[0], hi[0], lo[1], hi[1], own["pos"], u[j], lo[2], hi[2], lo[3], hi[3], lo[4], hi[4]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FIELDS)], schema=_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, u = None, None  # an analyte's rows lie together, so a task sends one part a pair
        for batch in batches:
            keys = batch.column("pos").to_numpy()
            starts = np.flatnonzero(np.diff(keys, prepend=-1))
            for a, b in zip(starts, [*starts[1:], len(keys)]):
                if own is None or own["pos"] != keys[a]:
                    if own is not None:
                        yield from parts(own, u)
                    own, u = batch.slice(a, 1).select(["pos", "name", "n", "y", "s"]).to_pylist()[0], np.zeros_like(s)
                    own["s"] = np.asarray(own["s"])
                step = max(1, CHUNK // len(total))
                for k in range(a, b, step):
                    add(u, own, _matrix(batch.column("v").slice(k, min(step, b - k)), len(total)))
        if own is not None:
            yield from parts(own, u)

    return run


def centroid_pairs(rows: DataFrame, vector: str, label: str, analyte: str, n_perm: int = 0, seed: int = 0) -> DataFrame:
    """Mean scores of both analytes of every held-out pair: ``perm, pos, neg, pos_score, neg_score, win``.

    ``perm`` -1 has the true labels, 0 and on shuffles of the analytes' 0/1
    labels.  The model is the centroid model of ``estimators``.  A pair without
    which a class would be empty is left out, as are rows with a null vector,
    label or analyte; an analyte with both labels raises.  Sums of analytes
    are broadcast in blocks of ``BLOCK`` numbers, a pass over the rows each.
    """
    spark = rows.sparkSession
    ship(spark)
    rows = rows.filter(" and ".join(f"`{c}` is not null" for c in (vector, label, analyte)))
    rows = rows.select(F.col(analyte).cast("string").alias("name"), F.col(label).alias("y"), A.doubles(F.col(vector)).alias("v"))
    sums = V.explode_vector(rows, "v", ["name"]).groupBy("name", "k").agg(F.sum("v").alias("v"))
    placed = H.places(rows, "name", "y").select("name", "y", "pos", F.col("n").alias("n_all"), "ones")
    sums = V.gather_vector(sums, ["name"], "s").join(rows.groupBy("name").agg(F.count("*").alias("n")), "name")
    table = settled(sums.join(placed, "name"), "pair_sums")
    size = table.agg(F.max("n_all").alias("a"), F.max("ones").alias("ones"), F.max(F.size("s")).alias("d"), F.sum("n").alias("m")).first()
    if size.a is None:
        return R.pair_wins(spark.createDataFrame([], PAIRS))
    d, perms = size.d, np.arange(n_perm)
    step = max(1, BLOCK // d)
    total, ones, n_ones = np.zeros(d), np.zeros((n_perm + 1, d)), np.zeros(n_perm + 1)

    def given(at: np.ndarray, y: np.ndarray) -> np.ndarray:
        """0/1 labels of analytes: the true ones, then all shuffles."""
        k = np.ones(len(at), np.int64)
        drawn = H.labels_of(at.astype(np.int64), size.a * k, size.ones * k, 0 * k, perms, seed) if n_perm else np.zeros((len(at), 0))
        return np.hstack([y[:, None], drawn]).astype(float)

    # one block of analytes at a time reaches the driver
    blocks = [(k, k + step) for k in range(0, size.a, step)]
    block = lambda b: table.filter((F.col("pos") >= b[0]) & (F.col("pos") < b[1])).toPandas()
    for b in blocks:
        t = block(b)
        s, on = np.stack(t["s"].to_numpy()), given(t["pos"].to_numpy(), t["y"].to_numpy())
        total, ones, n_ones = total + s.sum(axis=0), ones + on.T @ s, n_ones + on.T @ t["n"].to_numpy()
    own = rows.select("name", "v").join(table, "name").select("pos", "name", "n", "y", "s", "v")
    own = own.repartition("pos", F.pmod(F.xxhash64("v"), F.lit(SALTS))).sortWithinPartitions("pos")
    own = settled(own, "pair_rows") if len(blocks) > 1 else own
    parts = None
    for b in blocks:
        some = own.mapInArrow(_deviations(block(b), total, size.m), _PART)
        parts = some if parts is None else parts.unionByName(some)
    sent = spark.sparkContext.broadcast((total, ones, n_ones, size.m))

    def scored(pdf: pd.DataFrame) -> pd.DataFrame:
        # a pair's parts: one a task that has rows of either
        total, ones, n_ones, m = sent.value
        r = pdf.iloc[0]
        ends = np.stack([r["s_lo"], r["s_hi"]]), np.array([r["n_lo"], r["n_hi"]], float)
        u = np.stack([np.stack(list(pdf.loc[pdf["own"] == r[e], "u"])).sum(axis=0) for e in ("lo", "hi")]) / ends[1][:, None]
        y = given(np.array([r["lo"], r["hi"]]), np.array([r["y_lo"], r["y_hi"]]))
        first = y[0] > y[1]
        pos = np.where(first, 0, 1)
        n1, n0 = n_ones - ends[1][pos], m - n_ones - ends[1][1 - pos]
        use = np.flatnonzero((y[0] != y[1]) & (n1 > 0) & (n0 > 0))
        pos, n1, n0 = pos[use], n1[use, None], n0[use, None]
        centre = (total - ends[0].sum(axis=0)) / (m - ends[1].sum()) if m > ends[1].sum() else total
        way = _units((ones[use] - ends[0][pos]) / n1 - centre) - _units((total - ones[use] - ends[0][1 - pos]) / n0 - centre)
        names, score = np.array([r["lo_name"], r["hi_name"]], object), way @ u.T
        k = np.arange(len(use))
        return pd.DataFrame({"perm": use - 1, "pos": names[pos], "neg": names[1 - pos], "pos_score": score[k, pos], "neg_score": score[k, 1 - pos]})

    return R.pair_wins(parts.groupBy("lo", "hi").applyInPandas(scored, PAIRS))


def centroid_pair_null(rows: DataFrame, vector: str, label: str, analyte: str, n_perm: int = 1000, seed: int = 0) -> DataFrame:
    """Mean win rate of all pairs against shuffled labels: ``auroc, p, null_mean, n_perm``."""
    wins = centroid_pairs(rows, vector, label, analyte, n_perm, seed).groupBy("perm").agg(F.avg("win").alias("auroc"))
    return H.against_null(wins)
