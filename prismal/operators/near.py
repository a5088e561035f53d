"""Joins of vectors by cosine: pairs above a bound, link counts and nearest neighbours, exact, both sides of any size.

Rows are dealt to the cell of their nearest pivot.  A row can have a partner in
another cell only if that cell's half-space begins within reach, and if the
distances of the cell's rows from their pivot allow it (triangle bounds), so
guests visit those cells only.  Cells are cut in blocks of bounded bytes; each
pair of blocks is a task of its own, and compares its rows by matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismal.functions import arrays as A
from prismal.session import release, settled, ship

#: Bytes of vectors in a block.
BLOCK_BYTES = 8 << 20
#: Pivots at most, one for so many rows.
PIVOTS, ROWS_A_PIVOT = 256, 500
#: Sampled rows, and the share of cells that they may visit for the cells to be worth their guests; results are the same.
SAMPLE, WORTH = 256, 0.3
#: Rows of the left and of the right side whose products are formed at once.
STRIP, TILE = 512, 1024
#: Share of a tile's products above which they are formed anew in 8-byte numbers, and products that are formed one by one at once.
SPARSE, MANY = 1 / 32, 10_000
#: A cosine that exceeds another by less is equal at 12 decimals or nearly so; rows come by id, so a later one that ties does not enter.
TIE = 4e-13


def matrix(column) -> np.ndarray:
    """Unit rows of a list column; a zero vector stays zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-30)
    return x


def _floats(df: DataFrame, vector: str) -> bool:
    return df.schema[vector].dataType.simpleString() == "array<float>"


def _rows(df: DataFrame, vector: str, id_col: str, *carry: str) -> DataFrame:
    """``id, x``; floats stay floats, half the bytes to send: ``matrix`` widens them."""
    x = F.col(vector) if _floats(df, vector) else A.doubles(F.col(vector))
    return df.filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), x.alias("x"), *carry)


def pivots(rows: DataFrame) -> np.ndarray:
    """Distinct unit vectors of a bounded sample in hash order; they only set the cells."""
    few = max(1, min(PIVOTS, rows.count() // ROWS_A_PIVOT))
    x = rows.orderBy(F.xxhash64("id"), "id").limit(few).select("x").toArrow()["x"]
    return np.unique(matrix(x), axis=0) if len(x) else np.zeros((1, 0))


def _distances(u: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((u * u).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * u @ p.T, 0))


def at_home(rows: DataFrame, p: np.ndarray) -> DataFrame:
    """``id, x, cell, far``: the nearest pivot and the distance from it."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(matrix(batch.column(1)), p)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["id", "x", "cell", "far"])

    return rows.mapInArrow(run, "id long, x array<double>, cell int, far double")


def allowed(u: np.ndarray, p: np.ndarray, least: np.ndarray, most: np.ndarray, reach: float) -> np.ndarray:
    """Whether a cell (column) may hold a partner of a row within ``reach``; ``least`` and ``most`` are the distances of a cell's rows from its pivot."""
    d, gaps = _distances(u, p), _distances(p, p)
    own = d.argmin(1)
    near = d[np.arange(len(d)), own]
    # how far the half-space of the rows nearer to another pivot lies
    with np.errstate(divide="ignore", invalid="ignore"):
        border = np.where(gaps[own] > 0, (d * d - (near * near)[:, None]) / (2 * gaps[own]), 0.0)
    slack = reach + 1e-9
    return (border <= slack) & (d <= most + slack) & (d >= least - slack)


def visiting(rows: DataFrame, p: np.ndarray, least: np.ndarray, most: np.ndarray, reach: float) -> DataFrame:
    """``id, x, cell``: each row in every cell that may hold a partner."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STRIP):
                part = batch.slice(at, STRIP)
                row, cell = np.nonzero(allowed(matrix(part.column(1)), p, least, most, reach))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(cell.astype(np.int32))], ["id", "x", "cell"])

    return rows.mapInArrow(run, "id long, x array<double>, cell int")


def in_blocks(left: DataFrame, right: DataFrame, fn, schema: str) -> tuple[DataFrame, int]:
    """``fn(left, right)`` of every pair of blocks that share a cell, and the number of pairs of rows compared.

    ``left`` and ``right`` are written tables ``id, x, cell``.  Rows are sent once
    for each block of the other side.
    """
    width = max((r.d or 1 for r in left.unionByName(right).agg(F.max(F.size("x")).alias("d")).collect()), default=1)
    rows = max(1, BLOCK_BYTES // ((4 if _floats(left, "x") and _floats(right, "x") else 8) * width))
    count = lambda df, n: df.groupBy("cell").agg(F.count("*").alias(n))
    sizes = settled(count(left, "l").join(count(right, "r"), "cell"), "cells")
    number = lambda n: F.ceil(F.col(n) / rows).cast("int")
    sizes = sizes.select("cell", "l", "r", number("l").alias("lb"), number("r").alias("rb"))
    compared = sizes.agg(F.sum(F.col("l") * F.col("r"))).first()[0] or 0

    # both sides may be one table
    own_name = lambda c: F.col(c).alias(c)

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        # a row a cell: at most PIVOTS
        both = df.join(F.broadcast(sizes), "cell").withColumn(own[0], F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
        return both.withColumn(other[0], F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select(own_name("cell"), F.col("l").cast("int").alias("lo"), F.col("r").cast("int").alias("ro"), own_name("id"), own_name("x"))

    key = ["cell", "lo", "ro"]
    pairs = dealt(left, "lb", "rb").groupBy(*key).cogroup(dealt(right, "rb", "lb").groupBy(*key))
    return pairs.applyInArrow(fn, schema), compared


def _prepared(left: DataFrame, right: DataFrame, vector: str, id_col: str, least: float, max_share: float | None):
    a, b = (settled(_rows(df, vector, id_col).withColumn("x", A.doubles(F.col("x"))), name) for df, name in ((left, "left"), (right, "right")))
    p = pivots(b)
    if not p.shape[1]:
        p = pivots(a)
    # a bound of 0 or less is no distance bound: zero vectors are alike to all then
    reach = float(np.sqrt(2 - 2 * least)) if least > 0 else np.inf
    sample = matrix(a.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("x").toArrow()["x"])
    while True:
        home = settled(at_home(b, p), "home")
        lows, highs = np.full(len(p), np.inf), np.full(len(p), -np.inf)
        for r in home.groupBy("cell").agg(F.min("far").alias("lo"), F.max("far").alias("hi")).collect():
            lows[r.cell], highs[r.cell] = r.lo, r.hi
        # where bounds hardly prune, cells would only multiply what is sent
        if len(p) == 1 or not len(sample) or allowed(sample, p, lows, highs, reach).mean() <= WORTH:
            break
        p = p[:1]
    guests = settled(visiting(a, p, lows, highs, reach), "guests")
    if max_share is not None:
        there = home.groupBy("cell").agg(F.count("*").alias("r"))
        met = guests.groupBy("cell").agg(F.count("*").alias("l")).join(there, "cell").agg(F.sum(F.col("l") * F.col("r"))).first()[0] or 0
        whole = max(1, a.count() * b.count())
        if met > max_share * whole:
            raise ValueError(f"{met} of {whole} pairs would be compared, more than the share of {max_share}: vectors this far apart leave nothing to prune")
    return guests, home.drop("far")


def _products(left: pa.Table, right: pa.Table) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """(left rows, right rows, cosines) by strips of left rows and, within, tiles of right ones."""
    x, y = matrix(left["x"]), matrix(right["x"])
    for at in range(0, len(x), STRIP):
        for to in range(0, len(y), TILE):
            yield slice(at, at + STRIP), slice(to, to + TILE), x[at : at + STRIP] @ y[to : to + TILE].T


def near_pairs(left: DataFrame, right: DataFrame, vector: str, id_col: str, least: float = 0.98, max_share: float | None = None) -> DataFrame:
    """Pairs of a left and a right row with a cosine of at least ``least``: ``left_id, right_id, sim``.

    Rows with a null id or vector are left out; a zero vector has cosine 0.  With
    ``max_share`` the pairs that would be compared are counted first, and more than
    that share of all raises.
    """
    guests, home = _prepared(left, right, vector, id_col, least, max_share)

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if a.num_rows and b.num_rows:
            li, ri = a["id"].to_numpy(), b["id"].to_numpy()
            for i, j, s in _products(a, b):
                y, x = np.nonzero(s >= least - 1e-12)
                out.append((li[i][y], ri[j][x], s[y, x]))
        release()
        return pa.table(dict(zip(("left_id", "right_id", "sim"), map(np.concatenate, zip(*out)))))

    return in_blocks(guests, home, compare, "left_id long, right_id long, sim double")[0]


def link_counts(df: DataFrame, vector: str, id_col: str, least: float, max_share: float | None = None) -> DataFrame:
    """``id, n_links``: other rows with a cosine of at least ``least``; pairs are counted where they are compared, not sent."""
    guests, home = _prepared(df, df, vector, id_col, least, max_share)

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        li, ri = a["id"].to_numpy(), b["id"].to_numpy()
        n = np.zeros(len(li), np.int64)
        if len(li) and len(ri):
            for i, j, s in _products(a, b):
                n[i] += ((s >= least - 1e-12) & (li[i, None] != ri[None, j])).sum(1)
        release()
        return pa.table({"id": li, "n": n})

    counts = in_blocks(guests, home, compare, "id long, n long")[0].groupBy("id").agg(F.sum("n").alias("n_links"))
    return _rows(df, vector, id_col).select("id").join(counts, "id", "left").fillna(0, ["n_links"])


def _sides(queries: DataFrame, base: DataFrame, vector: str, id_col: str, apart: str | None) -> tuple[DataFrame, DataFrame]:
    """Written queries and base rows ``id, x, cell``, once where they are one table: one cell, or with ``apart`` one a value, which the base rows of all others visit."""
    if not apart:
        one = lambda df, name: settled(_rows(df, vector, id_col).withColumn("cell", F.lit(0)), name)
        left = one(queries, "queries")
        return left, left if base is queries else one(base, "base")
    two = lambda df, name: settled(_rows(df.filter(F.col(apart).isNotNull()).withColumn("_side", F.col(apart).cast("string")), vector, id_col, "_side"), name)
    left = two(queries, "queries")
    right = left if base is queries else two(base, "base")
    names = F.array(*(F.lit(r[0]) for r in left.select("_side").distinct().orderBy("_side").collect())).cast("array<string>")
    spot = lambda c: F.array_position(names, c).cast("int")
    others = F.transform(F.filter(names, lambda c: c != F.col("_side")), spot)
    return left.select("id", "x", spot(F.col("_side")).alias("cell")), right.select("id", "x", F.explode(others).alias("cell"))


def nearest(queries: DataFrame, base: DataFrame, vector: str, id_col: str, k: int, apart: str | None = None) -> DataFrame:
    """``query_id, id, sim``: at least the ``k`` nearest base rows of every query, itself left out; a block gives ``k`` at most.

    Cosines are rounded to 12 decimals, ties go to the smaller id.  With
    ``apart``, a column of few values, rows that share its value (or have none)
    do not meet.  A tile of products gives what passes a query's k-th so far, so
    that little is sorted.
    """
    left, right = _sides(queries, base, vector, id_col, apart)

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("id")
        # a vector with NaN has no cosine
        (li, x), (ri, y) = ((t["id"].to_numpy()[ok], u[ok]) for t, u, ok in ((t, u, np.isfinite(u).all(1)) for t, u in ((t, matrix(t["x"])) for t in (a, b))))
        sims, found = np.full((len(li), k), -np.inf), np.zeros((len(li), k), np.int64)
        small, other = x.astype(np.float32), y.astype(np.float32)
        # what products of 4-byte numbers may be off by, twice over
        off = (x.shape[1] + 4) * 1.2e-7
        for i in range(0, len(x), STRIP):
            # a first tile sets bounds, few of its columns where all tie
            for j, to in pairwise([0, *range(STRIP, len(y), 2 * TILE), len(y)]) if len(y) else ():
                own, there = slice(i, i + STRIP), slice(j, to)
                row, col = _passing(small[own] @ other[there].T, sims[own, -1], off, k)
                if len(row) > SPARSE * len(x[own]) * len(y[there]):
                    # many are alike: exact products tell which of them tie
                    row, col = _passing(x[own] @ y[there].T, sims[own, -1] + TIE, 0.0, k)
                row, col = row + i, col + j
                v = np.concatenate([np.zeros(0), *(np.round(np.einsum("ij,ij->i", x[row[n : n + MANY]], y[col[n : n + MANY]]), 12) for n in range(0, len(row), MANY))])
                new = (v > sims[row, -1]) & (li[row] != ri[col])
                if new.any():
                    _entered(sims, found, row[new], v[new], ri[col[new]])
        query, place = np.nonzero(sims > -np.inf)
        release()
        return pa.table({"query_id": li[query], "id": found[query, place], "sim": sims[query, place]})

    return in_blocks(left, right, best, "query_id long, id long, sim double")[0]


def _passing(s: np.ndarray, least: np.ndarray, off: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the products that may be among their row's ``k`` largest, which lie above ``least`` so far; products are off by ``off`` at most."""
    if np.isneginf(least).any() and s.shape[1] > k + 1:
        # one more than k, as a row may meet itself
        least = np.maximum(least, np.partition(s, -k - 1, axis=1)[:, -k - 1] - off - 1e-11)
    at = np.flatnonzero(s >= (least - off).astype(s.dtype)[:, None])
    return at // s.shape[1], at % s.shape[1]


def _entered(sims: np.ndarray, found: np.ndarray, row: np.ndarray, v: np.ndarray, ids: np.ndarray) -> None:
    """Put values into the rows' best, in place: the largest first, ties by id; empty places are minus infinity."""
    k = sims.shape[1]
    some = np.unique(row)
    row = np.concatenate([np.repeat(some, k), row])
    v, ids = np.concatenate([sims[some].ravel(), v]), np.concatenate([found[some].ravel(), ids])
    order = np.lexsort((ids, -v, row))
    starts = np.searchsorted(row[order], some)
    top = order[starts[:, None] + np.arange(k)]
    sims[some], found[some] = v[top], ids[top]
