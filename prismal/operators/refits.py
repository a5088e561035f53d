"""Nulls of out-of-fold areas by models refitted on shuffled labels.

A shuffle is one more label column of the same rows: what a model needs is
computed for all columns at once.  Logistic columns share every pass; PLS columns
share X'X of a fold and differ in X'Y; neighbours do not depend on labels and are
searched once.  Only the scores meet the number of shuffles, as arrays, and are
put in order by stretches of each shuffle's scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prismal.functions import arrays as A
from prismal.operators import linear as L
from prismal.operators import shuffles as S
from prismal.operators import vectors as V
from prismal.session import release, settled, ship

#: Strength, components and neighbours where none are given.
HYPER = {"logistic": 0.1, "plsda": 10, "knn": 5}
#: Shuffles, whole bytes of labels, whose scores a task holds at once.
STRETCH = 64
#: Labels, rows by shuffles, of a task in every pass.
TASK = 20_000_000
#: Scores of a shuffle that are put in order at once, and rows sampled to cut them there; areas are the same wherever they are cut.
RANGE, SAMPLE = 200_000, 2000


def _labels(n: int) -> L.Labels:
    """Label columns out of the bytes that hold them."""
    return lambda columns: np.unpackbits(S.packed(pa.array(columns[0], pa.binary()), n), axis=1, count=n).view(bool)


def _part(packed: np.ndarray, at: int, n: int) -> np.ndarray:
    """Labels ``at`` to ``at + n - 1`` of every row."""
    return np.unpackbits(packed[:, at // 8 : -(-(at + n) // 8)], axis=1, count=n)


def _levels(s: np.ndarray, y: np.ndarray, cuts: np.ndarray, first: int) -> pa.RecordBatch:
    """``perm, cut, s, ones, zeros``: distinct scores of every shuffle (row) in order, by stretch between its cuts, with the rows of either label.

    Lists go as bytes, which Spark moves whole instead of by number.
    """
    order = s.argsort(axis=1)
    s, y = np.take_along_axis(s, order, 1), np.take_along_axis(y, order, 1)
    new = np.ones(s.shape, bool)
    new[:, 1:] = s[:, 1:] != s[:, :-1]
    starts = np.flatnonzero(new)
    ones = np.add.reduceat(y.ravel(), starts, dtype=np.int32)
    zeros = np.diff(np.append(starts, s.size)).astype(np.int32) - ones
    s, ends = s.ravel()[starts], np.cumsum(new.sum(1))
    stretches = cuts.shape[0] + 1
    inner = np.empty((len(ends), stretches), np.int64)
    inner[:, -1] = ends
    for j, (at, to) in enumerate(zip([0, *ends[:-1]], ends)) if len(cuts) else ():
        inner[j, :-1] = at + np.searchsorted(s[at:to], cuts[:, j], side="right")
    ends = np.concatenate([[0], inner.ravel()])
    perm = np.repeat(np.arange(first, first + len(inner), dtype=np.int32), stretches)
    cut = np.tile(np.arange(stretches, dtype=np.int32), len(inner))
    lists = (pa.BinaryArray.from_buffers(pa.binary(), len(perm), [None, pa.py_buffer((ends * v.itemsize).astype(np.int32)), pa.py_buffer(v)]) for v in (s, ones, zeros))
    return pa.RecordBatch.from_arrays([pa.array(perm), pa.array(cut), *lists], ["perm", "cut", "s", "ones", "zeros"])


def _pairs(key: tuple, table: pa.Table) -> pa.Table:
    """What a stretch of a shuffle's scores adds to its area: pairs in order within, ties at half, and the rows of either label."""
    s, ones, zeros = (np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (("s", np.float64), ("ones", np.int32), ("zeros", np.int32)))
    order = np.argsort(s, kind="stable")  # sorted runs, which this merges
    # NaN stands last and has no rank
    order = order[: len(order) - np.isnan(s).sum()]
    s, ones, zeros = s[order], ones[order].astype(float), zeros[order].astype(float)
    if len(s):
        starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        ones, zeros = np.add.reduceat(ones, starts), np.add.reduceat(zeros, starts)
    u = float(ones @ (np.cumsum(zeros) - zeros / 2))
    return pa.table({"perm": pa.array([key[0].as_py()], pa.int32()), "cut": pa.array([key[1].as_py()], pa.int32()), "u": [u], "ones": [ones.sum()], "zeros": [zeros.sum()]})


def _areas(rows: DataFrame, score, first: int, last: int) -> DataFrame:
    """``perm, auroc`` of the shuffles ``first`` to ``last - 1``: ``score(batch)`` gives scores of a stretch of shuffles against the labels in ``bits``.

    Tasks put their rows' scores in order; what is shuffled is a list a shuffle and
    batch, cut by score, and each cut is put in order by itself.
    """
    ship(rows.sparkSession)
    n = rows.count()
    stretches = max(1, -(-n // RANGE))
    cuts = np.zeros((0, last - first))
    if stretches > 1:
        some = [score(b)(0, last - first) for b in rows.sample(False, min(1.0, SAMPLE / n), 0).toArrow().to_batches() if b.num_rows]
        if some:
            cuts = np.quantile(np.round(np.vstack(some), 12), np.arange(1, stretches) / stretches, axis=0)
    sent = rows.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                of, y = score(batch), S.packed(batch.column("bits"), last - first)
                for at in range(0, last - first, STRETCH):
                    wide = min(STRETCH, last - first - at)
                    s = np.ascontiguousarray(np.round(of(at, wide), 12).T)
                    yield _levels(s, _part(y, at, wide).T, sent.value[:, at : at + wide], first + at)
        release()

    levels = rows.mapInArrow(run, "perm int, cut int, s binary, ones binary, zeros binary")
    pairs = levels.groupBy("perm", "cut").applyInArrow(_pairs, "perm int, cut int, u double, ones double, zeros double")
    below = F.coalesce(F.sum("zeros").over(W.partitionBy("perm").orderBy("cut").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    u = F.sum(F.col("u") + F.col("ones") * F.col("below"))
    return pairs.withColumn("below", below).groupBy("perm").agg(F.try_divide(u, F.sum("ones") * F.sum("zeros")).alias("auroc"))


def _linear(rows: DataFrame, weights: np.ndarray, bias: np.ndarray, first: int) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast((weights, bias))

    def score(batch: pa.RecordBatch):
        w, b = sent.value
        x, fold = L.matrix(batch.column("x")), batch.column("fold").to_numpy()
        own = [(f, np.flatnonzero(fold == f)) for f in np.unique(fold)]

        def of(at: int, wide: int) -> np.ndarray:
            out = np.zeros((len(fold), wide))
            for f, here in own:
                out[here] = x[here] @ w[f][:, at : at + wide] + b[f][at : at + wide]
            return out

        return of

    return _areas(rows, score, first, first + bias.shape[1])


def _plsda(rows: DataFrame, folds: int, labels: L.Labels, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Response of class 1 of every label column and fold left out."""
    pivot, parts = L.cross_products(rows, labels, folds)
    columns = next(iter(parts.values()))[4].shape[1]
    weights, bias = np.zeros((folds, len(pivot), columns)), np.zeros((folds, columns))
    for f in range(folds):
        sums = L.outside(parts, f)
        if not sums:
            continue
        n, sx, sy, xx, xy = sums
        mx, coef = L.pls_of_two(n, sx, sy, xx, xy, k)
        fitted = (sy > 0) & (sy < n)
        weights[f] = np.where(fitted, coef, 0.0)
        bias[f] = np.where(fitted, sy / n - (mx + pivot) @ coef, 0.0)
    return weights, bias


def _neighbours(rows: DataFrame, k: int) -> DataFrame:
    """``query_id, id, w``: neighbours outside a row's fold and their weights."""
    weight = 1 / F.greatest(1 - F.col("sim"), F.lit(1e-12))
    return V.cosine_neighbours(rows, rows, "x", "id", k, apart="fold").select("query_id", "id", weight.alias("w"))


def _votes(rows: DataFrame, near: DataFrame, first: int, last: int) -> DataFrame:
    """Areas of the share of class 1 among the neighbours' weights."""
    lists = near.join(rows.select("id", "bits"), "id").groupBy(F.col("query_id").alias("id")).agg(F.collect_list(F.struct("w", "bits")).alias("near"))
    voted = settled(rows.select("id", "bits").join(lists, "id").select("bits", F.col("near.w").alias("w"), F.col("near.bits").alias("on")), "votes")

    def score(batch: pa.RecordBatch):
        w = batch.column("w").flatten().to_numpy(zero_copy_only=False)
        on = S.packed(batch.column("on").flatten(), last - first)
        starts = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("w")).to_numpy(zero_copy_only=False))[:-1]])
        total = np.add.reduceat(w, starts)[:, None]
        return lambda at, wide: np.add.reduceat(w[:, None] * _part(on, at, wide), starts) / total

    return _areas(voted, score, first, last)


def refit_null(
    df: DataFrame, vector: str, label: str, group: str, folds: str, model: str = "logistic", n_perm: int = 1000, seed: int = 0, strata: str | None = None,
    hyper: float | int | None = None, id_col: str | None = None,
) -> DataFrame:
    """``auroc, p, null_mean, n_perm``: the out-of-fold area of a model and those of refits on ``n_perm`` shuffles of the labels.

    ``model`` is logistic, plsda or knn (which needs a long ``id_col``), with
    ``hyper`` its strength, components or neighbours.  0/1 labels of whole groups
    are shuffled, within ``strata`` if given; every shuffle fits every fold anew
    and is scored against its own labels.  Rows without label, vector, group or
    fold are left out; a fold fitted without one of the classes scores 0.  Folds
    are few; shuffles go by blocks of bounded parameters.
    """
    if model not in HYPER:
        raise ValueError(f"no refits of {model!r}; there are {', '.join(sorted(HYPER))}")
    hyper = HYPER[model] if hyper is None else hyper
    use = df.filter(" and ".join(f"`{c}` is not null" for c in (vector, label, group, folds)))
    names = [r[0] for r in use.select(folds).distinct().orderBy(folds).collect()]
    spot = F.array_position(F.array(*(F.lit(n) for n in names)), F.col(folds)) - 1 if names else F.lit(0)
    columns = [A.doubles(F.col(vector)).alias("x"), spot.cast("int").alias("fold"), F.col(group).alias("_g")] + ([F.col(id_col).cast("long").alias("id")] if id_col else [])
    size = use.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).first()
    if not size.d:
        return S.against_null(df.sparkSession.createDataFrame([], "perm int, auroc double"))
    placed = S.places(use, group, label, strata).withColumnRenamed(group, "_g")
    step = max(1, L.BLOCK // max(1, len(names) * (size.d + 1)))
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = cores * max(1, -(-size.n * min(step, n_perm + 1) // (TASK * cores)))
    near, areas = None, []
    for first in range(-1, n_perm, step):
        last = min(n_perm, first + step)
        labels = _labels(last - first)
        bits = S.label_bits(placed, "_g", first, last, seed)
        rows = use.select(*columns).join(bits, "_g").select("x", "fold", "bits", *(["id"] if id_col else []))
        # rows are small and their shuffles many: tasks by labels, not by bytes
        rows = settled(rows.repartition(tasks), "refit")
        bare = rows.select("x", "fold", "bits")
        if model == "knn":
            near = near or settled(_neighbours(rows, int(hyper)), "near")
            areas.append(_votes(rows, near, first, last))
        elif model == "logistic":
            fit = L.joint_logistic(bare, labels, np.full(last - first, float(hyper)), len(names), tol=1e-6)
            areas.append(_linear(bare, fit.weights, fit.bias, first))
        else:
            areas.append(_linear(bare, *_plsda(bare, len(names), labels, int(hyper)), first))
    return S.against_null(reduce(lambda a, b: a.unionByName(b), areas))
