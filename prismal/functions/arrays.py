"""Vector expressions on array columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def doubles(v: Column) -> Column:
    """As doubles: sums of floats would be rounded on the way."""
    return v.cast("array<double>")


def unit(v: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    return F.get(F.transform(F.array(F.struct(v.alias("v"), norm(v).alias("n"))), lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(x))), F.lit(0))


def cosine(a: Column, b: Column, guard: float = 1e-30) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(guard))


def standard_rows(v: Column, floor: float = 1e-12) -> Column:
    """A row's values less their mean, over their population deviation or the floor."""
    n = F.nullif(F.size(v), F.lit(0))  # an empty row has no mean and stays empty

    def of(s: Column) -> Column:
        sd = F.greatest(F.sqrt(F.aggregate(s["v"], F.lit(0.0), lambda a, x: a + (x - s["m"]) * (x - s["m"])) / n), F.lit(floor))
        return F.get(F.transform(F.array(F.struct(s["v"].alias("v"), s["m"].alias("m"), sd.alias("sd"))), lambda t: F.transform(t["v"], lambda x: (x - t["m"]) / t["sd"])), F.lit(0))

    return F.get(F.transform(F.array(F.struct(v.alias("v"), (total(v) / n).alias("m"))), of), F.lit(0))


def root(v: Column) -> Column:
    return F.transform(v, lambda x: F.sqrt(F.greatest(x, F.lit(0.0))))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale_to_max(v: Column) -> Column:
    """Over its maximum; one that is not positive raises."""
    top = F.array_max(v)
    return F.when(top > 0, F.get(F.transform(F.array(F.struct(v.alias("v"), top.alias("t"))), lambda s: F.transform(s["v"], lambda x: x / s["t"])), F.lit(0))).otherwise(
        F.raise_error(F.lit("the signal has no positive maximum")).cast("array<double>")
    )


def differences(v: Column) -> Column:
    n = F.size(v)
    return F.when(n > 1, F.zip_with(F.slice(v, 2, n - 1), F.slice(v, 1, n - 1), lambda a, b: a - b)).otherwise(F.array().cast("array<double>"))


def median(v: Column) -> Column:
    """Middle of an array, the mean of two middles for an even size; null for an empty one."""
    def of(s: Column) -> Column:
        n = F.size(s)
        return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)

    return F.get(F.transform(F.array(F.array_sort(v)), of), F.lit(0))


def robust_noise(v: Column) -> Column:
    """1.4826 median absolute deviations of the first differences, over the root of two."""
    def of(d: Column) -> Column:
        return F.get(F.transform(F.array(F.struct(d.alias("d"), median(d).alias("m"))), lambda s: median(F.transform(s["d"], lambda x: F.abs(x - s["m"])))), F.lit(0))

    return F.lit(1.4826) * F.get(F.transform(F.array(differences(v)), of), F.lit(0)) / F.sqrt(F.lit(2.0))


def inside(x: Column, regions) -> Column:
    """In a union of closed intervals."""
    out = F.lit(False)
    for lo, hi in regions:
        out = out | x.between(lo, hi)
    return out


def mask_peaks(peaks: Column, positions: Column, tol: float) -> Column:
    """Peaks farther than ``tol`` from every position."""
    return F.filter(peaks, lambda p: F.forall(positions, lambda q: F.abs(p["position"] - q) > tol))


def split_explained(peaks: Column, bands: Column, tol: float, min_excess: float, min_ratio: float) -> Column:
    """Struct (kept, dropped): a peak goes if its nearest band within ``tol`` explains its height.

    Nearest by distance, then position, then height; a peak stays if it exceeds
    the band by ``min_excess`` and by the factor ``min_ratio``.
    """
    near = lambda p: F.array_min(F.transform(F.filter(bands, lambda b: F.abs(p["position"] - b["position"]) <= tol), lambda b: F.struct(F.abs(p["position"] - b["position"]).alias("d"), b["position"].alias("pos"), b["height"].alias("h"))))
    goes = lambda p: F.coalesce(~((p["intensity"] - near(p)["h"] >= min_excess) & (p["intensity"] >= min_ratio * near(p)["h"])), F.lit(False))
    return F.struct(F.filter(peaks, lambda p: ~goes(p)).alias("kept"), F.filter(peaks, goes).alias("dropped"))


def top_by_intensity(peaks: Column, k: int) -> Column:
    """The ``k`` strongest peaks, by position; equal ones in their order."""
    placed = F.transform(peaks, lambda p, i: F.struct((-p["intensity"]).alias("k"), i.alias("i"), p.alias("p")))
    return F.array_sort(F.transform(F.slice(F.array_sort(placed), 1, k), lambda s: s["p"]))


def lorentz_fwhm(width: Column, rel_height: float) -> Column:
    """Full width at half height of a Lorentzian measured at ``rel_height`` below its top."""
    return width / F.sqrt(F.lit(1.0 / (1.0 - rel_height) - 1.0))


def invariants_from_activity(s: Column, rho: Column) -> Column:
    """(a2, g2): mean and anisotropy invariants of a line's activity and depolarisation, not below 0."""
    # activity = 45 a2 + 7 g2 and rho = 3 g2 / (45 a2 + 4 g2)
    g2 = s * rho / (3 * (1 + rho))
    a2 = (s - 7 * g2) / 45
    return F.struct(F.greatest(a2, F.lit(0.0)).alias("a2"), F.greatest(g2, F.lit(0.0)).alias("g2"))


def scattering_factor(nu: Column, laser_nm: float = 785.0, kelvin: float = 298.15) -> Column:
    """(nu0 - nu)^4 / nu / (1 - exp(-c2 nu / T)), in wavenumbers; c2 is the second radiation constant."""
    return F.pow(F.lit(1e7 / laser_nm) - nu, 4) / nu / (1 - F.exp(-F.lit(1.4387769) * nu / kelvin))


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson's r of an aggregation, null where a side does not vary (the built-in one divides by zero there)."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
