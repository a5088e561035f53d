"""Feature tables ``id, feature, v`` from records and stored signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismal.functions import arrays as A
from prismal.functions import signal as S
from prismal.functions import text as X
from prismal.functions.kernels import grid


def axis(name: str, cfg: dict, width: float = 10.0) -> list[float]:
    """Axis values of a feature's components: bin starts for F1 and F1pos, else the grid."""
    lo, hi = cfg["window"]
    return [lo + width * i for i in range(round((hi - lo) / width))] if name in ("F1", "F1pos") else grid(lo, hi, cfg["grid_step"]).tolist()


def stored(df: DataFrame, cfg: dict) -> DataFrame:
    """``id, v`` of a store with ``x``, or with ``x829`` and ``xsub``: the latter over its maximum where the variant rescales."""
    if "x" in df.columns:
        return df.select("id", A.doubles(F.col("x")).alias("v"))
    sub = A.doubles(F.col("xsub"))
    scaled = F.get(F.transform(F.array(F.struct(sub.alias("v"), F.greatest(F.array_max(sub), F.lit(1e-9)).alias("t"))), lambda s: F.transform(s["v"], lambda v: v / s["t"])), F.lit(0))
    return df.select("id", (scaled if cfg["substrate"]["reference_norm"]["rescale_to_max_after_discard"] else A.doubles(F.col("x829"))).alias("v"))


def present(v: Column) -> Column:
    """1 for components over 0, else 0."""
    return F.transform(v, lambda x: (x > 0).cast("double"))


def feature_table(records: DataFrame, name: str, cfg: dict, store: DataFrame | None = None, width: float = 10.0) -> DataFrame:
    """largest intensity a bin; F1pos: presence; F2: lines drawn again; F3: the stored signal, every id of which must be there."""
    peaks = X.parse_peaks(F.col("text"), cfg)
    lo, hi = cfg["window"]
    if name in ("F1", "F1pos"):
        v = X.raster(peaks, lo, hi, width)
        v = present(v) if name == "F1pos" else v
        out = records.select("id", v.alias("v"))
    elif name == "F2":
        part = lambda f: F.transform(peaks, lambda p: p[f])
        out = records.select("id", S.render(part("position"), part("intensity"), part("width"), cfg).alias("v"))
    elif name == "F3":
        from prismal.operators.vectors import lookup

        if store is None:
            raise ValueError("F3 needs a store")
        out = lookup(records, stored(store, cfg)).select("id", "v")
    else:
        raise ValueError(f"unknown feature {name!r}")
    return out.select("id", F.lit(name).alias("feature"), "v")


def feature_set(records: DataFrame, cfg: dict, store: DataFrame | None = None, names=("F1", "F1pos", "F2", "F3")) -> DataFrame:
    """All features as one table; F3 only where a store is given. F1 and F1pos come from one pass over the texts."""
    names = [n for n in names if n != "F3" or store is not None]
    parts = []
    if {"F1", "F1pos"} <= set(names):
        v = F.col("v")
        both = F.array(F.struct(F.lit("F1").alias("feature"), v.alias("v")), F.struct(F.lit("F1pos").alias("feature"), present(v).alias("v")))
        parts.append(feature_table(records, "F1", cfg).select("id", F.explode(both).alias("f")).select("id", "f.feature", "f.v"))
        names = [n for n in names if n not in ("F1", "F1pos")]
    return reduce(lambda a, b: a.unionByName(b), parts + [feature_table(records, n, cfg, store) for n in names])


def with_steps(features: DataFrame, chains: dict[str, list[list[str]]], axes: dict[str, list[float]], domains: DataFrame | None = None, domain: str | None = None, group: str | None = None) -> DataFrame:
    """Add variants ``feature.step1.step2`` by chains of steps; ``domains`` gives the domain and group of ids."""
    parts = [features]
    for name, lists in chains.items():
        base = features.filter(F.col("feature") == name)
        for steps in lists:
            rows = base.join(domains, "id") if domains is not None else base
            parts.append(S.apply_steps(rows, "v", steps, axes.get(name), domain, group).select("id", F.lit(".".join([name, *steps])).alias("feature"), "v"))
    return reduce(lambda a, b: a.unionByName(b), parts)
