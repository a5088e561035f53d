"""Line intensities, orientation averages and scale calibration."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prismal.functions import arrays as A
from prismal.functions import kernels as K
from prismal.session import ship

#: Component orders in which six polarisability derivatives may be printed.
ORDERS = (("xx", "yy", "zz", "xy", "xz", "yz"), ("xx", "xy", "yy", "xz", "yz", "zz"), ("xx", "yy", "zz", "xy", "yz", "xz"))


def component(d: Column, order: tuple, name: str) -> Column:
    return F.get(d, F.lit(order.index(name)))


def tensor_invariants(d: Column, order: tuple) -> Column:
    """Struct (a, g2): a third of the trace and the anisotropy of a symmetric tensor."""
    xx, yy, zz, xy, xz, yz = (component(d, order, n) for n in ORDERS[0])
    sq = lambda c: c * c
    g2 = 0.5 * (sq(xx - yy) + sq(yy - zz) + sq(zz - xx)) + 3 * (sq(xy) + sq(xz) + sq(yz))
    return F.struct(((xx + yy + zz) / 3).alias("a"), g2.alias("g2"))


def pick_order(modes: DataFrame) -> DataFrame:
    """Component order that reproduces the printed activities and depolarisations best: ``name, order_id, cv, mae, verified``.

    Modes with a frequency over 1 count; smallest sum of the coefficient of
    variation of the activity ratio and the mean depolarisation error.
    """
    parts = []
    for i, order in enumerate(ORDERS):
        t = modes.filter("freq > 1").withColumn("_t", tensor_invariants(F.col("d"), order))
        s = 45 * F.col("_t.a") * F.col("_t.a") + 7 * F.col("_t.g2")
        rho = F.try_divide(3 * F.col("_t.g2"), 45 * F.col("_t.a") * F.col("_t.a") + 4 * F.col("_t.g2"))
        ratio = F.when((s > 1e-8) & (F.col("activity") > 1e-8), F.col("activity") / s)
        parts.append(t.groupBy("name").agg((F.stddev_pop(ratio) / F.avg(ratio)).alias("cv"), F.avg(F.abs(F.col("depol") - rho)).alias("mae")).withColumn("order_id", F.lit(i)))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("cv", F.coalesce("cv", F.lit(float("inf"))))
    w = W.partitionBy("name").orderBy(F.col("cv") + F.col("mae"), "order_id")
    return every.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("name", "order_id", "cv", "mae", ((F.col("cv") < 0.02) & (F.col("mae") < 0.03)).alias("verified"))


def isotropic(d: Column, order: tuple = ORDERS[0]) -> Column:
    """Orientation average of the squared zz component: a2 + 4 g2 / 45."""
    t = tensor_invariants(d, order)
    return t["a"] * t["a"] + 4 * t["g2"] / 45


def axes(n: int, seed: int = 0) -> np.ndarray:
    """Seeded unit vectors, uniform on the sphere: the third rows of random rotations."""
    v = np.random.default_rng(seed).normal(size=(n, 3))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def oriented(modes: DataFrame, n: int, seed: int = 0, order: tuple = ORDERS[0]) -> DataFrame:
    """Squared zz component of every mode in every orientation: ``*modes, orientation, zz``."""
    spark = modes.sparkSession
    table = spark.createDataFrame([(i, *map(float, a)) for i, a in enumerate(axes(n, seed))], "orientation int, ax double, ay double, az double")
    xx, yy, zz, xy, xz, yz = (component(F.col("d"), order, k) for k in ORDERS[0])
    ax, ay, az = F.col("ax"), F.col("ay"), F.col("az")
    v = ax * ax * xx + ay * ay * yy + az * az * zz + 2 * (ax * ay * xy + ax * az * xz + ay * az * yz)
    # the orientations asked for are a stated set, sent to every mode
    return modes.crossJoin(F.broadcast(table)).withColumn("zz", v * v).drop("ax", "ay", "az")


def intensities(lines: DataFrame, laser_nm: float = 785.0, kelvin: float = 298.15) -> DataFrame:
    """Three conventions of line strength in long form: ``name, freq, convention, value``; only frequencies over 1."""
    rows = lines.filter("freq > 1").withColumn("_f", A.scattering_factor(F.col("freq"), laser_nm, kelvin)).withColumn("_i", A.invariants_from_activity(F.col("activity"), F.col("depol")))
    values = {"activity": F.col("activity"), "int785": F.col("activity") * F.col("_f"), "gapiso785": (F.col("_i.a2") + 4 * F.col("_i.g2") / 45) * F.col("_f")}
    pairs = F.array(*(F.struct(F.lit(k).alias("convention"), v.alias("value")) for k, v in values.items()))
    return rows.select("name", "freq", F.explode(pairs).alias("p")).select("name", "freq", "p.convention", "p.value")


def fit_orientation(modes: DataFrame, target_x: np.ndarray, target_y: np.ndarray, n: int = 200, fwhm: float = 10.0, window=(500.0, 1750.0), seed: int = 0) -> DataFrame:
    """Orientation that fits half a window best, scored on the other half, both ways, for each name.

    Columns ``name, fit_half, best, fit_cos, heldout_cos, heldout_isotropic,
    heldout_median, heldout_percentile``.  A name's modes are few and go to one call.
    """
    ship(modes.sparkSession)
    g = K.grid(window[0], window[1], 1.0)
    want, a = np.interp(g, target_x, target_y), axes(n, seed)
    low = g < sum(window) / 2

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        f = pdf["freq"].to_numpy()
        d = np.array(pdf["d"].tolist(), float).reshape(-1, 6)
        t = d[:, [0, 3, 4, 3, 1, 5, 4, 5, 2]].reshape(-1, 3, 3)
        zz = np.einsum("oi,mij,oj->om", a, t, a) ** 2
        nu0 = 1e7 / 785.0
        fac = (nu0 - f) ** 4 / f / (1 - np.exp(-1.4387769 * f / 298.15))
        lines = (fwhm / 2) ** 2 / ((g - f[:, None]) ** 2 + (fwhm / 2) ** 2)
        sims, iso = (zz * fac) @ lines, (zz.mean(0) * fac) @ lines
        cos = lambda u, m: u[..., m] @ want[m] / (np.linalg.norm(u[..., m], axis=-1) * np.linalg.norm(want[m]) + 1e-30)
        rows = []
        for name, fit, test in (("low", low, ~low), ("high", ~low, low)):
            s, h = cos(sims, fit), cos(sims, test)
            b = int(np.argmax(s))
            rows.append((pdf["name"].iloc[0], name, b, s[b], h[b], float(cos(iso, test)), float(np.median(h)), float((h < h[b]).mean() * 100)))
        return pd.DataFrame(rows, columns=["name", "fit_half", "best", "fit_cos", "heldout_cos", "heldout_isotropic", "heldout_median", "heldout_percentile"])

    schema = "name string, fit_half string, best int, fit_cos double, heldout_cos double, heldout_isotropic double, heldout_median double, heldout_percentile double"
    return modes.filter("freq > 1").groupBy("name").applyInPandas(one, schema)


def calibrate_scale(pairs: DataFrame, scales: list[float] | None = None, tol: float = 20.0) -> DataFrame:
    """Scale of line positions with the smallest median error to reference peaks, more matches first among equals.

    ``pairs`` has ``name, freq, inten, peaks`` (reference peaks); returns one
    row ``scale, median_error, n_bands``.  Scales are a stated set.
    """
    ship(pairs.sparkSession)
    scales = scales or [round(0.94 + 0.001 * i, 3) for i in range(71)]
    kind = "array<struct<scale:double,error:double>>"

    @F.pandas_udf(kind)
    def errors(freq: pd.Series, inten: pd.Series, peaks: pd.Series) -> pd.Series:
        out = []
        for f, i, p in zip(freq, inten, peaks):
            g = K.grid(400.0, 2000.0, 1.0)
            each = []
            for s in scales:
                y = K.lorentzian_sum(np.asarray(f) * s, i, g, 10.0)
                if y.max() <= 0:
                    continue
                y = y / y.max()
                at = K.find_peaks(y, height=0.05)[0]
                found = [(float(g[k]), float(y[k])) for k in at]
                each += [{"scale": s, "error": abs(a - b)} for a, b in K.greedy_match([(q["position"], q["intensity"]) for q in p], found, tol)]
            out.append(each)
        return pd.Series(out)

    rows = pairs.select(F.explode(errors("freq", "inten", "peaks")).alias("e")).select("e.*")
    per = rows.groupBy("scale").agg(F.percentile("error", F.lit(0.5)).alias("median_error"), F.count("*").alias("n_bands"))
    return per.orderBy("median_error", F.desc("n_bands"), "scale").limit(1)


def rank_correlation(df: DataFrame, a: str, b: str, by=None) -> DataFrame:
    """Spearman's rho by tie-averaged ranks: ``*by, rho, n``; null for constant input."""
    by = [by] if isinstance(by, str) else list(by or [])

    def averaged(c: str) -> Column:
        w = W.partitionBy(*by).orderBy(c)
        return F.rank().over(w) + (F.count("*").over(W.partitionBy(*by, c)) - 1) / 2

    r = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_a", averaged(a)).withColumn("_b", averaged(b))
    agg = (A.correlation("_a", "_b").alias("rho"), F.count("*").alias("n"))
    return r.groupBy(*by).agg(*agg) if by else r.agg(*agg)
