"""Streaming forms of the stateless row transforms, and gap sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismal.functions import text as X


def budget_stream(stream: DataFrame, text_col: str, limit: int) -> DataFrame:
    """Add estimated tokens and whether they fit; the same expression as in batch."""
    n = X.estimate_tokens(F.col(text_col))
    return stream.withColumn("n_tokens", n).withColumn("fits", n <= limit)


def gap_sessions(stream: DataFrame, ts: str, gap: str, by: list[str], late: str, *aggs: Column) -> DataFrame:
    """Sessions closed by a gap, with a watermark: the streaming twin of gap clusters on a time axis."""
    rows = stream.withWatermark(ts, late).groupBy(*by, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n"), *aggs)
    return rows.select(*by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", *[c for c in rows.columns if c not in (*by, "s", "n")])
