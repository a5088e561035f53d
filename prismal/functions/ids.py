"""Sample ids: normal form, kind, group, strain, condition, pairs and analytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def normal_id(c: Column) -> Column:
    """Drop ``AAs_``/``indoles_`` and repeated ``Cell_`` in front of another prefix."""
    c = F.regexp_replace(c, "^(?:AAs|indoles)_", "")
    return F.regexp_replace(c, "^(?:Cell_|AAs_)+(?=(?:Cell|CB)_|L-)", "")


def kind(c: Column) -> Column:
    return F.when(c.startswith("CB_"), "substrate_only").when(c.startswith("Cell_"), "cell").otherwise("standard")


def group(c: Column, strip_replicate: bool = True) -> Column:
    return F.regexp_replace(c, "_[0-9]+$", "") if strip_replicate else c


def strain(c: Column) -> Column:
    """Second token of at least three; after the last colon if there is one."""
    parts = F.split(F.substring_index(c, ":", -1), "_")
    return F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))).otherwise("?")


def pair_name(c: Column) -> Column:
    return F.when(c.startswith("Cell_"), F.regexp_replace(c, "^Cell_", "CB_")).otherwise(F.concat(F.lit("CB_"), c))


def condition(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "^(Cell|CB)_", ""), "_[0-9]+$", "")


def in_subsample(c: Column, share: float) -> Column:
    """A seed-free share of ids by their CRC-32; all for a share of 1 or more."""
    return F.lit(True) if share >= 1 else F.crc32(F.encode(c, "utf-8")) / F.lit(2.0**32) < share


def solvent(c: Column) -> Column:
    return F.when(c.endswith("_water"), "water")


def rung_key(c: Column) -> Column:
    """Number in a rung's name, for ordering."""
    return F.regexp_replace(c, "[^0-9]", "").try_cast("int")


def family(feature: Column, base: str) -> Column:
    return (feature == base) | feature.startswith(f"{base}.")


def with_analyte(samples: DataFrame, analytes: DataFrame, id_col: str = "id") -> DataFrame:
    """Add ``analyte``, ``smiles`` of the analyte an id names, null where none does.

    A whole name wins, then the longest name inside the id, then a code that is
    a token of the id if only one analyte's is.  The analyte table is a small
    dimension; a size estimate over the session's limit makes Spark shuffle
    instead.  Distinct ids are matched once.
    """
    ids = samples.select(F.col(id_col).alias("_id")).distinct().withColumn("_low", F.lower("_id"))
    names = analytes.select(F.col("name").alias("analyte"), "smiles", F.lower("name").alias("_name"), F.lower("code").alias("_code"))
    whole = (F.col("_low") == F.col("_name")) | (F.col("_low") == F.replace("_name", F.lit(" "), F.lit("_")))
    tokens = F.split("_low", r"[_\-\s]+")
    rule = F.when(whole, 1).when(F.contains("_low", "_name"), 2).when(F.array_contains(tokens, F.col("_code")), 3)
    hits = ids.join(names, F.contains(F.col("_low"), F.col("_name")) | whole | F.array_contains(tokens, F.col("_code"))).withColumn("_rule", rule)
    w = W.partitionBy("_id")
    best = hits.withColumn("_n", F.count("*").over(w.orderBy("_rule").rangeBetween(W.unboundedPreceding, W.currentRow))).withColumn(
        "_k", F.row_number().over(w.orderBy("_rule", -F.length("_name"), "_name"))
    )
    best = best.filter((F.col("_k") == 1) & ((F.col("_rule") < 3) | (F.col("_n") == 1))).select("_id", "analyte", "smiles")
    return samples.join(best, samples[id_col].eqNullSafe(best["_id"]), "left").drop("_id")
