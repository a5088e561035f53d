"""Records, tables and small reports."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismal.functions.text import rounded


def write_records(df: DataFrame, path: str, variant: str = "native") -> None:
    """Records as Parquet, a partition a variant."""
    df.withColumn("variant", F.lit(variant)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("variant").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls left out."""
    df.write.mode("overwrite").json(path)


def write_signals(df: DataFrame, path: str, cfg: dict) -> None:
    """Stored signals with their schema and variant, sorted by id within files."""
    df.withColumn("schema", F.lit(cfg["schema"])).withColumn("variant", F.lit(cfg.get("variant", "native"))).repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(path)


def write_table(df: DataFrame, path: str, columns: list[str] | None = None, decimals: int = 4, compression: str = "none") -> None:
    """CSV with a header: numbers rounded, non-finite ones empty; with ``columns`` those only, missing ones empty."""
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            df = df.withColumn(name, rounded(F.col(name).cast("double"), decimals))
    if columns:
        df = df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))
    df.write.mode("overwrite").option("header", "true").option("compression", compression).csv(path)


def write_predictions(df: DataFrame, chosen: DataFrame, path: str, keys=("feature", "model")) -> None:
    """Out-of-fold rows of the chosen combinations, gzipped."""
    write_table(df.join(F.broadcast(chosen.select(*keys)), list(keys), "left_semi"), path, compression="gzip")


def markdown(rows: list[dict]) -> str:
    """A Markdown table of a few collected rows, columns of the first."""
    if not rows:
        return ""
    names = list(rows[0])
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(names), line(["---"] * len(names)), *(line(r.get(n) for n in names) for r in rows)]) + "\n"


def file_digest(path: str | Path) -> str:
    """SHA-256 of a driver-side file, by blocks."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def digest_files(df: DataFrame) -> DataFrame:
    """SHA-256 of rows of the binary-file source: ``path, sha256``."""
    return df.select("path", F.sha2("content", 256).alias("sha256"))


def text_digest(df: DataFrame, id_col: str, text_col: str, order: str) -> DataFrame:
    """First 16 hex digits of a digest over ids and texts in order: one row ``digest, n``.

    Rows are digested on their own and summed with their places, so nothing is
    gathered; equal tables in equal order give equal digests.
    """
    row = F.sha1(F.concat_ws("\t", F.col(order).cast("string"), F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit(""))))
    part = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.substring(F.sha1(F.concat(F.sum(part).cast("string"), F.lit("\t"), F.count("*").cast("string"))), 1, 16).alias("digest"), F.count("*").alias("n"))


def missing_to_na(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("NA"))
