"""Spectrum, stick, table and peak-list files as DataFrames.

Every reader goes through Spark's file sources, so paths may lie in any store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismal import schema

_PATH = "_metadata.file_path"


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.url_decode(F.element_at(F.split(path, "/"), -1)), r"\.[^.]*$", "")


def subset(path: Column, root: str) -> Column:
    """First folder below ``root``, or ``.`` for a file directly in it."""
    rest = F.regexp_replace(F.url_decode(path), "^.*?" + root.rstrip("/").replace("file:", "").replace(".", "\\.") + "/", "")
    return F.when(F.contains(rest, F.lit("/")), F.substring_index(rest, "/", 1)).otherwise(".")


def two_columns(spark: SparkSession, path: str, pattern: str = "*.txt", comments: str = "#;/") -> DataFrame:
    """Signals from two-column text: ``id, subset, x, y`` with x ascending.

    Lines that begin with a comment sign or do not start with two numbers are
    skipped; commas and blanks separate.  Hidden files and readmes are left
    out.  A file without a numeric row raises when it is read.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path).select("value", F.col(_PATH).alias("path"))
    name = F.element_at(F.split("path", "/"), -1)
    lines = lines.filter(~name.startswith(".") & ~F.lower(name).startswith("readme"))
    t = F.trim(F.regexp_replace("value", "[,\\s]+", " "))
    parts = F.split(t, " ")
    num = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    ok = ~F.substring(t, 1, 1).isin(*comments) & num(0).isNotNull() & num(1).isNotNull()
    per = lines.groupBy("path").agg(F.array_sort(F.collect_list(F.when(ok, F.struct(num(0).alias("x"), num(1).alias("y"))))).alias("xy"))
    none = F.raise_error(F.concat(F.lit("no numeric rows in "), F.col("path"))).cast("array<double>")
    pick = lambda f: F.when(F.size("xy") > 0, F.transform("xy", lambda s: s[f])).otherwise(none)
    return per.select(_stem(F.col("path")).alias("id"), subset(F.col("path"), path).alias("subset"), pick("x").alias("x"), pick("y").alias("y"), "path")


def sticks(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """Lines from stick files in their order: ``id, freq, inten`` arrays; rows that are not two numbers are skipped."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True).select("value", F.col(_PATH).alias("path"))
    parts = lambda row: F.split(F.trim(F.regexp_replace(row, "[,\\s]+", " ")), " ")
    num = lambda row, i: F.get(parts(row), F.lit(i)).try_cast("double")
    rows = F.filter(F.transform(F.split("value", "\n"), lambda r: F.struct(num(r, 0).alias("f"), num(r, 1).alias("i"))), lambda s: s["f"].isNotNull() & s["i"].isNotNull())
    return lines.select(_stem(F.col("path")).alias("id"), F.transform(rows, lambda s: s["f"]).alias("freq"), F.transform(rows, lambda s: s["i"]).alias("inten"), "path")


def wide_csv(spark: SparkSession, path: str) -> tuple[DataFrame, list[float]]:
    """Signals from a CSV whose header is the axis and whose first column is the id: (``id, y``, ascending axis).

    A placeholder file or a header that is not numeric is an error.
    """
    raw = spark.read.option("header", "false").option("maxColumns", "100000").csv(path)
    header = spark.read.text(path).first()
    names = (header[0] if header else "").split(",")
    if names[0].startswith("PLACEHOLDER"):
        raise FileNotFoundError(f"{path} is a placeholder")
    try:
        axis = [float(v) for v in names[1:]]
    except ValueError as e:
        raise ValueError(f"{path}: the header is not a numeric axis") from e
    order = sorted(range(len(axis)), key=axis.__getitem__)
    cols = raw.columns
    rows = raw.filter(~F.col(cols[0]).eqNullSafe(F.lit(names[0])) & F.col(cols[0]).isNotNull())
    y = F.array(*(F.col(cols[i + 1]).cast("double") for i in order))
    return rows.select(F.col(cols[0]).cast("double").cast("bigint").alias("id"), y.alias("y")), [axis[i] for i in order]


def id_table(spark: SparkSession, path: str, key: str = "number", value: str = "smiles") -> DataFrame:
    """A small id-to-molecule CSV."""
    return spark.read.option("header", "true").csv(path).select(F.col(key).cast("bigint").alias(key), value)


def analytes(spark: SparkSession, path: str) -> DataFrame:
    """The analyte dimension: name, code, smiles, formula, source."""
    return spark.read.option("header", "true").csv(path)


def peaklists(spark: SparkSession, path: str) -> DataFrame:
    """Peak lists inside prompts of JSON lines: ``path, line, smiles, x, y, w``; a prompt without a JSON object raises when read."""
    rows = spark.read.schema("prompt string, response string").json(path).filter("prompt is not null or response is not null")
    body = F.regexp_extract("prompt", r"^[^{]*(\{[\s\S]*\})\s*$", 1)
    ok = F.when(body == "", F.raise_error(F.lit("a prompt has no peak object")).cast("string")).otherwise(body)
    j = F.from_json(ok, "Wavenumbers string, Intensities string, Widths string")
    arr = lambda k: F.when(F.coalesce(j[k], F.lit("")) == "", F.array().cast("array<double>")).otherwise(F.transform(F.split(j[k], ","), lambda v: F.trim(v).cast("double")))
    smiles = F.trim(F.element_at(F.split("response", "##SMILES:"), -1))
    return rows.select(smiles.alias("smiles"), arr("Wavenumbers").alias("x"), arr("Intensities").alias("y"), arr("Widths").alias("w"))


def records(spark: SparkSession, path: str, variant: str | None = None) -> DataFrame:
    """Records as JSON lines or, with ``variant``, the Parquet partition of that variant; mixed schema versions raise."""
    df = spark.read.parquet(path).filter(F.col("variant") == variant) if variant else spark.read.schema(schema.RECORD).json(path)
    return df


def one_schema(df: DataFrame) -> DataFrame:
    """The table itself; several schema versions in it raise at once."""
    found = [r[0] for r in df.select("schema").distinct().limit(3).collect()]
    if len(found) > 1:
        raise ValueError(f"mixed schema versions: {found}")
    return df


def store(spark: SparkSession, path: str) -> DataFrame | None:
    """Stored signals, or None where there are none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def activations(spark: SparkSession, path: str, position: str, layer: int, ids: DataFrame | None = None) -> DataFrame:
    """``id, v`` at one position and layer, by partition pruning; with ``ids`` only theirs."""
    df = spark.read.parquet(path).filter((F.col("position") == position) & (F.col("layer") == layer)).select("id", "v")
    return df.join(ids.select("id"), "id", "left_semi") if ids is not None else df


def generic_reference(spark: SparkSession, path: str) -> DataFrame:
    """Arrays ``x, mean, p90`` of a three-column reference file with comment lines."""
    t = F.split(F.trim(F.regexp_replace("value", "\\s+", " ")), " ")
    rows = spark.read.text(path).filter(~F.trim("value").startswith("#") & (F.trim("value") != "")).select(*(F.get(t, F.lit(i)).cast("double").alias(n) for i, n in enumerate(("x", "mean", "p90"))))
    a = rows.agg(F.array_sort(F.collect_list(F.struct("x", "mean", "p90"))).alias("r"))
    return a.select(F.transform("r", lambda s: s["x"]).alias("x"), F.transform("r", lambda s: s["mean"]).alias("mean"), F.transform("r", lambda s: s["p90"]).alias("p90"))


def calibration(text: str) -> dict:
    """Scale and intensity convention out of a printed calibration; int785 only where its rho beats activity's by over 0.05."""
    import re

    number = r"(-?[0-9]+(?:\.[0-9]+)?)"
    scale = re.search(rf"scale\D*{number}", text)
    rho = {k: float(m[1]) for k in ("activity", "int785") if (m := re.search(rf"{k}\D*?(?:rho|Spearman)?[^0-9-]*{number}", text))}
    better = rho.get("int785", -1.0) > rho.get("activity", -1.0) + 0.05
    return {"scale": float(scale[1]) if scale else None, "convention": "int785" if better and "int785" in rho else "activity"}


def best_metric(df: DataFrame, scheme: str, value: str = "value") -> DataFrame:
    """Best value per label and feature of a metrics table, without the majority model."""
    return df.filter((F.col("scheme") == scheme) & (F.col("model") != "majority")).groupBy("label", "feature").agg(F.max(value).alias("best"))


def pick_column(df: DataFrame, names=("file", "fname", "filename", "id")) -> str:
    """Name of the id column of a predictions table: the first known one, else the first."""
    low = {c.lower(): c for c in df.columns}
    return next((low[n] for n in names if n in low), df.columns[0])
