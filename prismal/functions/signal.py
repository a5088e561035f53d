"""Signal kernels over Arrow batches: DataFrame in, DataFrame out.

Arrays reach NumPy as flat values and offsets; rows of equal lengths form
``[rows, points]`` blocks of a bounded number of values.  A row with a null
among its inputs gives null; a null inside an array counts as nan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismal.functions import kernels as K
from prismal.session import ship

PEAKS = "array<struct<position:double,intensity:double,width:double>>"


class Lists(NamedTuple):
    """A list of structs a row: the row of every entry, ascending, and the entries' fields."""

    row: np.ndarray
    fields: dict[str, np.ndarray]


def _blocks(arrays: list[pa.Array], width: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(rows, their values as ``[rows, points]``, an array a column) for rows that are alike in lengths and not null."""
    starts = [np.asarray(a.offsets)[:-1] for a in arrays]
    sizes = np.stack([np.diff(np.asarray(a.offsets)) for a in arrays], axis=1)
    values = [a.values.to_numpy(zero_copy_only=False) for a in arrays]
    known = np.flatnonzero(np.logical_and.reduce([a.is_valid().to_numpy(zero_copy_only=False) for a in arrays]))
    for shape in np.unique(sizes[known], axis=0):
        rows = known[(sizes[known] == shape).all(axis=1)]
        step = max(1, K.BLOCK // max(1, width, *shape))
        for k in range(0, len(rows), step):
            at = rows[k : k + step]
            yield at, [v[s[at, None] + np.arange(n)] for v, s, n in zip(values, starts, shape)]


def _gathered(parts: list[tuple[np.ndarray, object]], n: int, known: np.ndarray) -> pa.Array:
    """One Arrow column of ``n`` rows from the results of blocks: numbers, arrays or ``Lists``."""
    kind = parts[0][1]
    if not isinstance(kind, Lists) and kind.ndim == 1:
        out = np.full(n, np.nan)
        for rows, v in parts:
            out[rows] = v
        return pa.array(out, mask=np.isnan(out))
    flat = [(rows, v if isinstance(v, Lists) else Lists(np.repeat(np.arange(len(v)), v.shape[1]), {"": v.ravel()})) for rows, v in parts]
    sizes = np.zeros(n, int)
    for rows, v in flat:
        sizes[rows] = np.bincount(v.row, minlength=len(rows))
    offsets = np.append(0, np.cumsum(sizes))
    fields = {f: np.empty(offsets[-1]) for f in flat[0][1].fields}
    for rows, v in flat:
        place = offsets[rows][v.row] + np.arange(len(v.row)) - np.searchsorted(v.row, v.row)
        for f, values in v.fields.items():
            fields[f][place] = values
    columns = [pa.array(v) for v in fields.values()]
    inner = columns[0] if "" in fields else pa.StructArray.from_arrays(columns, list(fields))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner, mask=pa.array(~known))


def over_rows(kernel: Callable[..., object], returns: str, width: int = 0) -> Callable[..., Column]:
    """A column function that gives blocks of its array columns, and the same rows of its number columns, to ``kernel``.

    Array columns come first.  ``kernel`` returns numbers, ``[rows, points]`` or
    ``Lists``, or a dictionary of these for a struct.  ``width`` is the length
    of a result where it may exceed the inputs'.  A null number is nan.
    """
    ship()

    def run(columns: list[pa.Array]) -> pa.Array:
        lists = [c for c in columns if pa.types.is_list(c.type)]
        numbers = [c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns[len(lists) :]]
        n, parts = len(columns[0]), []
        known = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in lists])
        for rows, arrays in _blocks(lists, width):
            parts.append((rows, kernel(*arrays, *(v[rows] for v in numbers))))
        if not parts:
            return pa.nulls(n, kind)
        if not isinstance(parts[0][1], dict):
            return _gathered(parts, n, known).cast(kind)
        fields = {f: _gathered([(r, p[f]) for r, p in parts], n, known) for f in parts[0][1]}
        return pa.StructArray.from_arrays(list(fields.values()), list(fields)).cast(kind)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(returns))

    # one signature a number of columns: Arrow UDFs are told apart by their hints
    def one(a: pa.Array) -> pa.Array:
        return run([a])

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return run([a, b])

    def three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return run([a, b, c])

    return lambda *cols: F.arrow_udf((one, two, three)[len(cols) - 1], returns)(*cols)


def baseline(y: Column, lam: float = 1e5, p: float = 0.01, rounds: int = 10) -> Column:
    """Asymmetric least squares baseline."""
    return over_rows(lambda v: K.als_baseline(v, lam, p, rounds), "array<double>")(y)


def smooth(y: Column, cfg: dict) -> Column:
    s = cfg["smooth"]
    return over_rows(lambda v: K.smooth(v, s["window_cm"], s["polyorder"], cfg["grid_step"]), "array<double>")(y)


def derivative(y: Column, window: int = 11, order: int = 2) -> Column:
    """First derivative of a local polynomial."""
    return over_rows(lambda v: K.savitzky_golay(v, window, order, 1), "array<double>")(y)


def broaden(y: Column, fwhm: float, step: float) -> Column:
    return over_rows(lambda v: K.gaussian_broaden(v, fwhm, step), "array<double>")(y)


def interpolate(x: Column, y: Column, cfg: dict) -> Column:
    g = K.grid(*cfg["window"], cfg["grid_step"])
    return over_rows(lambda a, b: K.rows_to_grid(a, b, g), "array<double>", len(g))(x, y)


def _drawn(g: np.ndarray, at: np.ndarray, height: np.ndarray, width: np.ndarray) -> np.ndarray:
    return K.draw_lines(np.repeat(np.arange(len(at)), at.shape[1]), at.ravel(), height.ravel(), width.ravel(), len(at), g)


def prepare(x: Column, y: Column, cfg: dict, kind: str) -> Column:
    """Measured, simulated or stick signals on the configured grid; sticks are drawn as lines on the scaled axis."""
    g = K.grid(*cfg["window"], cfg["grid_step"])

    def sticks(f: np.ndarray, i: np.ndarray) -> np.ndarray:
        at = f * cfg["dft"]["scale"] * cfg["sim_freq_scale"]
        return K.gaussian_broaden(_drawn(g, at, i, np.full(at.shape, cfg["dft"]["fwhm"])), cfg["sim_extra_fwhm"], cfg["grid_step"])

    return over_rows(sticks if kind == "sticks" else lambda a, b: K.prepare(a, b, cfg, kind), "array<double>", len(g))(x, y)


def render(positions: Column, heights: Column, widths: Column, cfg: dict) -> Column:
    """Lorentzian lines drawn on the grid; widths of at least 1."""
    g = K.grid(*cfg["window"], cfg["grid_step"])
    return over_rows(lambda p, h, w: _drawn(g, p, h, np.maximum(w, 1.0)), "array<double>", len(g))(positions, heights, widths)


def noise(y: Column) -> Column:
    return over_rows(K.robust_noise, "double")(y)


def find_peaks(y: Column, cfg: dict, top: Column | None = None, mask: list[float] | None = None) -> Column:
    """Peaks of a gridded signal after smoothing and scaling by ``top`` (a null top: the maximum)."""
    g = K.grid(*cfg["window"], cfg["grid_step"])

    def run(v: np.ndarray, tops: np.ndarray) -> Lists:
        b = K.pick(g, v, cfg, mask, tops)
        return Lists(b.row, {"position": b.position, "intensity": b.intensity, "width": b.width})

    return over_rows(run, PEAKS)(y, (F.lit(None) if top is None else top).cast("double"))


def peak_shapes(y: Column, rel_height: float = 0.5) -> Column:
    """Every maximum of a signal: ``array<struct<at,prominence,left,right>>`` in points, the width taken at a share of the prominence."""

    def run(v: np.ndarray) -> Lists:
        p = K.batch_peaks(v, rel_height=rel_height)
        return Lists(p.row, {"at": p.at, "prominence": p.prominence, "left": p.left, "right": p.right})

    return over_rows(run, "array<struct<at:double,prominence:double,left:double,right:double>>")(y)


def reference(y: Column, cfg: dict) -> Column:
    """(height, position) of the reference band of the smoothed signal, nulls without one."""
    r, s = cfg["substrate"]["reference_norm"], cfg["smooth"]
    g = K.grid(*cfg["window"], cfg["grid_step"])

    def run(v: np.ndarray) -> dict[str, np.ndarray]:
        smoothed = K.smooth(v, s["window_cm"], s["polyorder"], cfg["grid_step"])
        return dict(zip(("height", "position"), K.reference_bands(g, smoothed, r["ref_cm"], r["ref_tol"], r["ref_min_rel_prominence"])))

    return over_rows(run, "struct<height:double,position:double>")(y)


def shift_axis(y: Column, by: Column, cfg: dict) -> Column:
    """The signal moved along its axis by ``by``; null where that is null."""
    g = K.grid(*cfg["window"], cfg["grid_step"])

    def run(v: np.ndarray, shifts: np.ndarray) -> np.ndarray:
        out = np.empty(v.shape)
        for d in np.unique(shifts[~np.isnan(shifts)]):
            out[shifts == d] = K.resample(g + d, v[shifts == d], g)
        return out

    return F.when(by.isNotNull(), over_rows(run, "array<double>")(y, by.cast("double")))


def bands_of(y: Column, cfg: dict, curve: Column | None = None) -> Column:
    """Reference bands ``array<struct<position,height>>`` of a scaled curve, heights from ``curve`` where given."""
    r, g = cfg["substrate"]["reference_norm"], K.grid(*cfg["window"], cfg["grid_step"])
    least = cfg["substrate"]["catalogue_min_prominence"]

    def run(v: np.ndarray, c: np.ndarray | None = None) -> Lists:
        row, position, height = K.region_bands(v, g, r["cb_regions"], least, cfg["grid_step"], c)
        return Lists(row, {"position": position, "height": height})

    return over_rows(run, "array<struct<position:double,height:double>>")(*([y] if curve is None else [y, curve]))


def catalogue(y: Column, cfg: dict) -> Column:
    """Peak positions ``array<double>`` of a mean curve: prominence as a share of its maximum, 4 axis units apart."""
    g, least = K.grid(*cfg["window"], cfg["grid_step"]), cfg["substrate"]["catalogue_min_prominence"]

    def run(v: np.ndarray) -> Lists:
        row, position, _ = K.region_bands(v / v.max(axis=1, keepdims=True), g, None, least, cfg["grid_step"])
        return Lists(row, {"": position})

    return over_rows(run, "array<double>")(y)


def subtract_reference(y: Column, ref: Column, cfg: dict) -> Column:
    """Struct (rest, scale, shift) of a signal less its aligned and scaled reference; nulls where one of them is null."""
    g = K.grid(*cfg["window"], cfg["grid_step"])
    return over_rows(lambda v, r: K.subtract(v, r, g, cfg)._asdict(), "struct<rest:array<double>,scale:double,shift:double>")(y, ref)


def match_peaks(a: Column, b: Column, tol: float = 20.0) -> Column:
    """Greedy one-to-one matches ``array<struct<a,b>>`` of two peak lists, strongest of the first first."""

    ship()

    @F.pandas_udf("array<struct<a:double,b:double>>")
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        pos = lambda v: [(p["position"], p["intensity"]) for p in v]
        return pd.Series([None if x is None or y is None else [{"a": p, "b": q} for p, q in K.greedy_match(pos(x), pos(y), tol)] for x, y in zip(xs, ys)])

    return run(a, b)


def separated_top(y: Column, cfg: dict, k: int = 3, gap: float = 10.0, axis: list[float] | None = None) -> Column:
    """The strongest points at least ``gap`` apart on the grid or ``axis``, strongest first."""
    g = K.grid(*cfg["window"], cfg["grid_step"]) if axis is None else np.array(axis, float)

    def run(v: np.ndarray) -> Lists:
        points = K.separated_points(v, g, k, gap)
        row, at = np.nonzero(points >= 0)[0], points[points >= 0]
        return Lists(row, {"position": g[at], "height": v[row, at]})

    return over_rows(run, "array<struct<position:double,height:double>>")(y)


#: Preprocessing steps on a vector column, by name; ``lt<cm>`` keeps the components below an axis value.
def apply_steps(df: DataFrame, vector: str, steps: list[str], axis: list[float] | None = None, domain: str | None = None, group: str | None = None) -> DataFrame:
    """A chain of ``bg`` (centre by domain), ``d1``, ``snv``, ``sqrt`` and ``lt<value>``; an unknown step is an error."""
    from prismal.functions import arrays as A
    from prismal.operators.vectors import centre_by_domain

    for s in steps:
        if s == "bg":
            df = centre_by_domain(df, vector, domain, group, "_out").drop(vector).withColumnRenamed("_out", vector)
        elif s == "d1":
            df = df.withColumn(vector, derivative(A.doubles(F.col(vector))))
        elif s == "snv":
            df = df.withColumn(vector, A.standard_rows(A.doubles(F.col(vector))))
        elif s == "sqrt":
            df = df.withColumn(vector, A.root(A.doubles(F.col(vector))))
        elif s[:2] == "lt" and s[2:].replace(".", "", 1).isdigit():
            n = sum(a < float(s[2:]) for a in axis or [])
            df = df.withColumn(vector, F.slice(vector, 1, n))
        else:
            raise ValueError(f"unknown step {s!r}")
    return df
