"""Linear models fitted from sums over rows, many at once.

A pass over the rows adds up matrices in every task; tasks send one matrix each,
added up on executors, and the driver keeps parameters only.  PLS needs one such
pass: X'X and X'Y.  Logistic models of any number of label columns, folds and
strengths share every pass: each column has its own limited-memory quasi-Newton
state and its own step, so a pass serves all columns that are not yet done.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismal.session import ship

#: Parameters, folds by columns by width, that one run of passes holds: 8 MB, and the driver 20 times that.
BLOCK = 1_000_000
MEMORY = 8

#: Numbers that a step of a pass holds in each of its matrices, rows by label columns: they stay in a core's cache.
STEP = 500_000
#: Rows that products with label columns take at once.
STRIP = 1000

#: From a batch's label columns to a matrix of 0 and 1, rows by label columns.
Labels = Callable[[list[np.ndarray]], np.ndarray]


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(float, copy=False) if len(column) else np.zeros((0, 0))


def summed(rows: DataFrame, fn: Callable[[pa.RecordBatch], dict[int, np.ndarray]], strip: int | None = None) -> dict[int, np.ndarray]:
    """Sums over all rows of the matrices that ``fn`` gives for a batch, by their number; added up in every task, then by row of a matrix on executors.

    ``fn`` is given ``strip`` rows at a time, or whole batches.
    """
    ship(rows.sparkSession)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, strip or max(1, batch.num_rows)):
                for k, m in fn(batch.slice(at, strip or batch.num_rows)).items():
                    if k in total:
                        total[k] += m
                    else:
                        total[k] = m
        for k, m in total.items():
            lists = pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), np.ravel(m))
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(m), pa.int32()), pa.array(range(len(m)), pa.int32()), lists], ["m", "i", "v"])

    sums = rows.mapInArrow(add, "m int, i int, v array<double>").groupBy("m", "i").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    # parameters only: the sums of a block
    found = sums.toArrow().sort_by([("m", "ascending"), ("i", "ascending")])
    number = found["m"].to_numpy()
    return {int(k): matrix(found.filter(pa.array(number == k))["v"].combine_chunks()) for k in np.unique(number)}


# ---------------------------------------------------------------- PLS from cross products

def pls_from_sums(n: float, sx: np.ndarray, sy: np.ndarray, xx: np.ndarray, xy: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean of x, coefficients, mean of y) of a PLS regression of ``k`` components on scaled columns, from sums over rows.

    The weights are the leading left singular vector of X'Y, which is deflated in
    place of the rows.
    """
    mx, my = sx / n, sy / n
    cov = xx - np.outer(sx, mx)
    sd = np.sqrt(np.maximum(np.diag(cov), 0) / max(1.0, n - 1)) if n > 1 else np.ones(len(sx))
    use = sd > 1e-12
    inv = np.where(use, 1 / np.where(use, sd, 1), 0.0)
    e, f = cov * np.outer(inv, inv), (xy - np.outer(sx, my)) * inv[:, None]
    rs, ps, qs, scale = [], [], [], np.linalg.norm(f)
    for _ in range(min(k, int(use.sum()), max(1, int(n) - 1))):
        u, s, _ = np.linalg.svd(f, full_matrices=False)
        if not s[0] > 1e-12 * max(1.0, scale):
            break
        r = u[:, 0].copy()
        for p, old in zip(ps, rs):
            r = r - (p @ u[:, 0]) * old
        t = r @ e @ r
        if not t > 1e-12:
            break
        p, q = e @ r / t, f.T @ r / t
        f = f - t * np.outer(p, q)
        rs.append(r), ps.append(p), qs.append(q)
    coef = np.array(rs).T @ np.array(qs) if rs else np.zeros_like(xy)
    return mx, inv[:, None] * coef, my


def pls_of_two(n: float, sx: np.ndarray, ones: np.ndarray, xx: np.ndarray, xy: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean of x, coefficients of class 1) of ``pls_from_sums`` on both classes, for all 0/1 label columns at once.

    The centred columns of the two classes are opposite, so X'Y has one direction
    and needs no singular vectors.  A column of one class only has coefficients 0.
    """
    mx = sx / n
    cov = xx - np.outer(sx, mx)
    sd = np.sqrt(np.maximum(np.diag(cov), 0) / max(1.0, n - 1)) if n > 1 else np.ones(len(sx))
    use = sd > 1e-12
    inv = np.where(use, 1 / np.where(use, sd, 1), 0.0)
    e, f = cov * np.outer(inv, inv), (xy - np.outer(sx, ones / n)) * inv[:, None]
    coef, rs, ps = np.zeros_like(f), [], []
    scale = np.sqrt(2 * (f * f).sum(0))
    live = (ones > 0) & (ones < n)
    for _ in range(min(k, int(use.sum()), max(1, int(n) - 1))):
        size = np.sqrt((f * f).sum(0))
        live = live & (np.sqrt(2) * size > 1e-12 * np.maximum(1.0, scale))
        u = np.where(live, f / np.where(live, size, 1.0), 0.0)
        r = u.copy()
        for p, old in zip(ps, rs):
            r -= (p * u).sum(0) * old
        er = e @ r
        t = (r * er).sum(0)
        live = live & (t > 1e-12)
        if not live.any():
            break
        inverse = np.where(live, 1 / np.where(live, t, 1.0), 0.0)
        p, q = er * inverse, (f * r).sum(0) * inverse
        f = f - t * p * q
        coef += r * q
        rs.append(r), ps.append(p)
    return mx, inv[:, None] * coef


def cross_products(rows: DataFrame, labels: Labels, folds: int = 1) -> tuple[np.ndarray, dict[int, tuple]]:
    """A pivot near the mean, and for each fold (n, sum x, sum y, X'X, X'Y) of its own rows, x less the pivot.

    ``rows`` are ``x`` (array), ``fold`` (int, 0 to folds - 1) and columns for ``labels``.
    """
    found = rows.select(array_to_vector("x").alias("x")).agg(Summarizer.mean(F.col("x"))).first()[0]
    if found is None:
        return np.zeros(0), {}
    pivot = found.toArray()

    def fn(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        x, fold = matrix(batch.column(0)) - pivot, batch.column(1).to_numpy()
        y = labels([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]]).astype(float)
        out = {}
        for f in np.unique(fold).tolist():
            own = np.flatnonzero(fold == f)
            one = np.ones((len(own), 1))
            out[f] = np.hstack([one, x[own]]).T @ np.hstack([one, x[own], y[own]])
        return out

    d = len(pivot)
    out = {}
    for f, m in summed(rows, fn, STRIP).items():
        out[f] = (m[0, 0], m[0, 1 : d + 1], m[0, d + 1 :], m[1:, 1 : d + 1], m[1:, d + 1 :])
    return pivot, out


def outside(parts: dict[int, tuple], fold: int | None) -> tuple:
    """Sums over all folds but one; over all for None."""
    rest = [p for f, p in parts.items() if f != fold]
    return tuple(sum(x) for x in zip(*rest)) if rest else ()


# ---------------------------------------------------------------- logistic models, jointly

@dataclass
class Joint:
    """Weights ``[fold][width, column]`` and biases ``[fold][column]`` on raw vectors; passes it took and columns that had not settled."""

    weights: np.ndarray
    bias: np.ndarray
    passes: int
    open: int


def _quasi_newton(value: Callable, width: int, columns: int, passes: int, tol: float) -> tuple[np.ndarray, int, int]:
    """Minimise ``columns`` separate functions of ``width`` numbers; ``value(x, which)`` gives values and gradients of some columns at once."""
    x = np.zeros((width, columns))
    f, g = value(x, np.arange(columns))
    way, step = -g, 1 / np.maximum(1.0, np.abs(g).sum(0))
    old_s, old_y, rho = np.zeros((MEMORY, width, columns)), np.zeros((MEMORY, width, columns)), np.zeros((MEMORY, columns))
    live, done = np.flatnonzero(np.abs(g).max(0) > tol), 1
    while len(live) and done < passes:
        trial = x[:, live] + step[live] * way[:, live]
        f_new, g_new = value(trial, live)
        done += 1
        slope = (g[:, live] * way[:, live]).sum(0)
        good = f_new <= f[live] + 1e-4 * step[live] * slope + 1e-14 * np.abs(f[live])
        bad = live[~good]
        step[bad] *= 0.3
        at = live[good]
        if len(at):
            s, y = trial[:, good] - x[:, at], g_new[:, good] - g[:, at]
            sy = (s * y).sum(0)
            for a, v in ((old_s, s), (old_y, y)):
                a[:-1, :, at] = a[1:, :, at]
                a[-1][:, at] = v
            rho[:-1, at] = rho[1:, at]
            rho[-1, at] = np.where(sy > 1e-14 * (y * y).sum(0), 1 / np.where(sy > 0, sy, 1), 0.0)
            x[:, at], f[at], g[:, at] = trial[:, good], f_new[good], g_new[:, good]
            q, alpha = g[:, at].copy(), np.zeros((MEMORY, len(at)))
            for i in range(MEMORY - 1, -1, -1):
                alpha[i] = rho[i, at] * (old_s[i][:, at] * q).sum(0)
                q -= alpha[i] * old_y[i][:, at]
            yy = (old_y[-1][:, at] ** 2).sum(0)
            q *= np.where(rho[-1, at] > 0, 1 / np.maximum(rho[-1, at] * yy, 1e-300), 1.0)
            for i in range(MEMORY):
                q += old_s[i][:, at] * (alpha[i] - rho[i, at] * (old_y[i][:, at] * q).sum(0))
            way[:, at], step[at] = -q, 1.0
        live = live[(np.abs(g[:, live]).max(0) > tol) & (step[live] > 1e-12)]
    return x, done, len(live)


def _log_products(m: np.ndarray) -> np.ndarray:
    """Sums over rows of the logarithms of numbers from 1 to 2, by products that stay below 2^1000."""
    return sum((np.log(np.multiply.reduce(m[at : at + 1000], axis=0)) for at in range(0, len(m), 1000)), np.zeros(m.shape[1]))


def joint_logistic(
    rows: DataFrame, labels: Labels, strengths: np.ndarray, folds: int = 1, passes: int = 200, tol: float = 1e-7, floor: float = 1e-6, within: bool = False
) -> Joint:
    """L2 logistic regression of every label column for every fold left out, with strength C of its own, fitted together.

    With ``within`` a fold's columns are fitted on its own rows instead, which
    serves tables of different vectors that share their labels, such as layers.

    ``rows`` are ``x``, ``fold`` and columns for ``labels``, better written since
    every pass reads them; with one fold nothing is left out.  A column minimises
    the mean loss with both classes of equal weight plus the weights' squares over
    2 C n, on vectors standardised by the rows it is fitted on (deviations of at
    most ``floor`` count as 1).  A column that has one class only stays zero.  One
    pass reads the rows once for all columns that have not settled.
    """
    columns = len(strengths)
    parts = range(folds)

    def moments(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        x, fold = matrix(batch.column(0)), batch.column(1).to_numpy()
        y = labels([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]])
        out = {}
        for f in np.unique(fold).tolist():
            own = fold == f
            out[2 * f] = np.vstack([np.full(x.shape[1], own.sum()), x[own].sum(0), (x[own] ** 2).sum(0)])
            out[2 * f + 1] = y[own].sum(0, dtype=float)[None, :]
        return out

    sums = summed(rows, moments)
    if not sums:
        return Joint(np.zeros((folds, 0, columns)), np.zeros((folds, columns)), 1, 0)
    width = sums[min(sums)].shape[1]
    left = lambda f, odd: sum((m for k, m in sums.items() if k % 2 == odd and (folds == 1 or (k // 2 == f) == within)), np.zeros((1 if odd else 3, columns if odd else width)))
    means, devs, counts, pos = [], [], [], []
    for f in parts:
        m, p = left(f, 0), left(f, 1)[0]
        n = max(m[0, 0], 1.0)
        mu = m[1] / n
        sd = np.sqrt(np.maximum(m[2] / n - mu * mu, 0))
        means.append(mu), devs.append(np.where(sd > floor, sd, 1.0)), counts.append(m[0, 0]), pos.append(p)
    mean, dev, count, ones = (np.array(v) for v in (means, devs, counts, pos))
    n_all, zeros = count[:, None], count[:, None] - ones
    usable = ((ones > 0) & (zeros > 0)).ravel()
    heavy = np.where(usable.reshape(folds, columns), n_all / np.maximum(2 * ones, 1e-300), 0), np.where(usable.reshape(folds, columns), n_all / np.maximum(2 * zeros, 1e-300), 0)
    c = np.tile(np.asarray(strengths, float), folds)

    def value(theta: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sent = rows.sparkSession.sparkContext.broadcast((theta, which))

        def fn(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
            w, some = sent.value
            x, fold = matrix(batch.column(0)), batch.column(1).to_numpy()
            y_all = labels([col.to_numpy(zero_copy_only=False) for col in batch.columns[2:]])
            out = {}
            for f in parts:
                here = np.flatnonzero(some // columns == f)
                seen = np.flatnonzero((fold == f) == within) if folds > 1 else np.arange(len(fold))
                if not len(here) or not len(seen):
                    continue
                col = some[here] % columns
                z = (x[seen] - mean[f]) / dev[f]
                y = y_all[seen] if len(col) == columns else y_all[np.ix_(seen, col)]
                high, low = heavy[0][f, col], heavy[1][f, col]
                # matrices are large, so most steps are in place
                way, pull = np.where(y, 1.0, -1.0), np.where(y, -high, low)
                margin = z @ w[:-1, here]
                margin += w[-1, here]
                margin *= way
                e = np.abs(margin)
                np.exp(np.negative(e, out=e), out=e)
                more = e + 1
                # a label's loss is log(1 + exp(-margin)); a class has one weight, so its logarithms are one of a product
                every, one = _log_products(more), _log_products(np.where(y, more, 1.0))
                np.copyto(e, 1.0, where=margin <= 0)
                way *= pull
                loss = low * (every - one) + high * one + np.einsum("ij,ij->j", way, np.minimum(margin, 0, out=margin))
                e /= more
                pull *= e
                out[f] = np.vstack([z.T @ pull, pull.sum(0), loss])
            return out

        got = summed(rows, fn, max(512, STEP // columns))
        sent.unpersist()
        out = np.zeros((width + 2, len(which)))
        for f, m in got.items():
            out[:, which // columns == f] = m
        n = np.maximum(count[which // columns], 1.0)
        out /= n
        ridge = 1 / (c[which] * n)
        grad = out[:-1].copy()
        grad[:-1] += ridge * theta[:-1]
        flat = ~usable[which]
        grad[:, flat] = 0
        return out[-1] + 0.5 * ridge * (theta[:-1] ** 2).sum(0), grad

    x, took, still = _quasi_newton(value, width + 1, folds * columns, passes, tol)
    theta = x.reshape(width + 1, folds, columns).transpose(1, 0, 2)
    weights = theta[:, :-1, :] / dev[:, :, None]
    return Joint(weights, theta[:, -1, :] - np.einsum("fd,fdk->fk", mean, weights), took, still)


def given(columns: list[np.ndarray]) -> np.ndarray:
    """Label columns that each hold a number."""
    return np.column_stack(columns) > 0


def with_strengths(labels: Labels, n: int) -> Labels:
    """Every label column ``n`` times over, for as many strengths: columns of one strength stand together."""
    return lambda columns: np.tile(labels(columns), (1, n))
