"""Mixing sources to target weights by Pareto order sampling.

A source's target, over its size, is how often each of its documents is expected
in the mix: the whole part are certain copies, the rest is a sample.  Documents
larger than their source's mean are grouped by the binary logarithm of their
size; a group's sample has a fixed number of documents, and their inclusion
odds are tilted by size so that the expected number and the expected words are
both right.  Documents are ranked by random odds over inclusion odds, and the
first are taken.  The source's smaller documents, ranked the same way, make up
the words that are left of the target.

No group is ordered as a whole: a histogram of the ranking variable finds the
bucket in which the sample ends, and only that bucket's rows are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prismal.llm.common import BROADCAST_IDS, ranked, written

#: Runs of characters other than blanks and the controls of tab to return. A fixed pattern.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a bucket of the ranking variable, about.
BUCKET = 2048
#: Least inclusion probability that odds are formed of, and one minus the largest.
LEAST = 1 / 1024
#: 2^52: random numbers have so many values.
VALUES = 4503599627370496.0


def _uniform(digest: Column) -> Column:
    """A number between 0 and 1 of 52 bits of a hexadecimal digest."""
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(VALUES)


def _with(rows: DataFrame, side: DataFrame, on: list[str]) -> DataFrame:
    """Join a table of one row a key, written; broadcast where it has few rows, else left to the planner, which splits skewed keys."""
    return rows.join(F.broadcast(side) if side.count() <= BROADCAST_IDS else side, on)


def _key(id_col: str, text_col: str, source_col: str) -> Column:
    """A digest of what tells rows apart: id, source and text."""
    source = F.coalesce(F.concat(F.lit("+"), F.col(source_col).cast("string")), F.lit(","))
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit(""))), source))


def _numbered(rows: DataFrame) -> DataFrame:
    """Add ``copy``, the number from 0 of each of the rows that share a ``key``; ``part`` is dropped.

    Rows are counted by key and part of the table, so equal rows, however many, are
    numbered in parts; equal rows are alike, so which has which number is no matter.
    """
    several = written(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "repeated")
    n = several.count()
    if not n:
        return rows.drop("part").withColumn("copy", F.lit(0).cast("long"))
    side = F.broadcast(several) if n <= BROADCAST_IDS else several
    repeated = rows.join(side, "key", "left_semi")
    before = W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = repeated.groupBy("key", "part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = F.row_number().over(W.partitionBy("key", "part").orderBy("size")) - 1
    counted = repeated.withColumn("copy", inside).join(starts, ["key", "part"]).withColumn("copy", F.col("start") + F.col("copy")).drop("start", "part")
    return rows.join(side, "key", "left_anti").drop("part").withColumn("copy", F.lit(0).cast("long")).unionByName(counted)


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Add ``target`` to a written table ``src, n, source_size``: shares of all sizes by weight, none above ``most`` times its size.

    Sources take ``weights`` in turn, by ``src``.  What sources over their bound
    cannot take is shared out again by weight; each round is two sums.
    """
    at = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = written(ranked(sources, "src").withColumn("weight", at).drop("rank"), "weights")
    bound = most * F.col("source_size")
    whole = sources.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level, capped = 0.0, -1
    while whole.size:
        over = F.lit(level) * F.col("weight") > bound if capped >= 0 else F.lit(False)
        full = sources.filter(over).agg(F.count("*").alias("n"), F.coalesce(F.sum(bound), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
        if full.n == capped:
            break
        level, capped = (whole.size - full.size) / (whole.weight - full.weight), full.n
    return sources.withColumn("target", F.least(F.lit(level) * F.col("weight"), bound.cast("double")))


def strata(rows: DataFrame, seed: int) -> DataFrame:
    """``src, cls`` with what its sample needs: ``rows, words, fixed`` (documents to draw), ``mean`` and ``tilt`` of the inclusion probabilities."""
    square = (F.col("size").cast("decimal(19,0)") * F.col("size").cast("decimal(19,0)")).cast("decimal(38,0)")
    sums = rows.groupBy("src", "cls").agg(F.count("*").alias("rows"), F.sum("size").alias("words"), F.sum(square).cast("double").alias("squares"), F.first("share").alias("share"))
    want = F.col("share") * F.col("rows")
    chance = _uniform(F.md5(F.concat(F.lit(f"{seed}:"), F.col("cls").cast("string"), F.col("src"))))
    sums = sums.withColumn("fixed", (F.floor(want) + (chance < want - F.floor(want)).cast("long")).cast("long")).withColumn("mean", F.col("words") / F.col("rows"))
    spread = F.col("squares") - F.col("words") * F.col("mean")
    tilt = F.when((F.col("cls") >= 0) & (spread > 0), (F.col("share") * F.col("words") - F.col("fixed") * F.col("mean")) / spread).otherwise(0.0)
    level = F.when(F.col("cls") >= 0, F.col("fixed") / F.col("rows")).otherwise(F.col("share"))
    return sums.select("src", "cls", "rows", "words", "fixed", "mean", level.alias("level"), tilt.alias("tilt"))


def drawn(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Rows of ``src, cls`` in the order of ``q`` until their ``unit`` sums come nearest the ``budget``: adds ``take``, 0 or 1.

    ``rows`` and ``budgets`` (``src, cls, rows, budget``) are written tables.  A row is taken if the middle of its stretch
    is within the budget, so that fixed numbers are met exactly and words within half a document.
    """
    on = ["src", "cls"]
    place = F.floor(F.col("q") / (1 + F.col("q")) * F.ceil(F.col("rows") / BUCKET)).cast("long")
    placed = _with(rows, budgets, on).withColumn("place", place)
    hist = placed.groupBy(*on, "place").agg(F.sum("unit").alias("units"), F.first("budget").alias("budget"))
    hist = hist.withColumn("end", F.sum("units").over(W.partitionBy(*on).orderBy("place").rowsBetween(W.unboundedPreceding, 0)))
    last = hist.filter(F.col("end") > F.col("budget")).groupBy(*on).agg(F.min(F.struct("place", (F.col("end") - F.col("units")).alias("before"))).alias("last"))
    ends = written(budgets.select(*on).join(last, on, "left").select(*on, F.col("last.place").alias("last"), F.col("last.before").alias("before")), "ends")
    both = _with(placed, ends, on)
    order = W.partitionBy(*on).orderBy("q", "key", "copy").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("unit").over(order), F.lit(0))
    border = both.filter(F.col("place") == F.col("last")).withColumn("take", (start + F.col("unit") / 2 <= F.col("budget")).cast("int"))
    rest = both.filter(F.col("last").isNull() | (F.col("place") != F.col("last"))).withColumn("take", (F.col("last").isNull() | (F.col("place") < F.col("last"))).cast("int"))
    return rest.unionByName(border).select(*rows.columns, "take")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """How often the mix takes every document: ``doc_id, size, source_size, target, taken, copies, key``.

    A document's size are its words, runs of anything but blanks, tabs and line
    ends; a null text has none.  Sources, ordered by code points and a null last,
    take ``weights`` in turn and share the words of all documents by them, none
    above ``most`` times its own; ``taken`` is ``copies`` times the size, and
    ``copies`` is ``most`` at the most.  A source of which one document is a large part
    comes as near its target as that document lets it.  What a document draws depends on its id, source, text
    and ``seed`` only, so reruns agree.  Rows equal in these are numbered and drawn
    each; rows with a null id are told apart by their text.  Documents without
    words take nothing; an empty table gives no row.  Other columns are ignored,
    whatever their names.
    """
    src = F.coalesce(F.concat(F.lit("+"), F.col(source_col).cast("string")), F.lit(","))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    light = docs.select(F.col(id_col).cast("long").alias("doc_id"), src.alias("src"), size.alias("size"), _key(id_col, text_col, source_col).alias("key"), F.spark_partition_id().alias("part"))
    light = written(light, "sizes")
    sources = written(light.groupBy("src").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")), "sources")
    goal = targets(sources, weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = written(goal.select("src", "n", "source_size", "target", F.floor(rate).cast("long").alias("base"), (rate - F.floor(rate)).alias("share")), "targets")
    # size at most the mean: the documents that fill up
    group = F.when(F.col("size") * F.col("n") <= F.col("source_size"), -1).otherwise(F.length(F.bin("size")) - 1)
    rows = _with(_numbered(light), goal, ["src"]).withColumn("cls", group)
    layers = written(strata(rows, seed), "strata")
    u = _uniform(F.md5(F.concat(F.lit(f"{seed}:"), F.col("copy").cast("string"), F.lit(":"), F.col("key"))))
    chance = F.greatest(F.lit(LEAST), F.least(F.lit(1 - LEAST), F.col("level") + F.col("tilt") * (F.col("size") - F.col("mean"))))
    placed = _with(rows, layers.select("src", "cls", "level", "tilt", "mean"), ["src", "cls"]).withColumn("u", u).withColumn("chance", chance)
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("chance") / (1 - F.col("chance")))
    unit = F.when(F.col("cls") >= 0, 1).otherwise(F.col("size")).cast("long")
    placed = written(placed.select("doc_id", "src", "size", "source_size", "target", "base", "share", "cls", "key", "copy", unit.alias("unit"), odds.alias("q")), "ranks")
    budgets = layers.filter("cls >= 0").select("src", "cls", "rows", F.col("fixed").cast("double").alias("budget"))
    large = written(drawn(placed.filter("cls >= 0"), written(budgets, "budgets")), "large")
    had = large.groupBy("src").agg(F.sum(F.col("size") * F.col("take")).alias("had"))
    left = layers.filter("cls < 0").join(goal.select("src", "source_size", "share"), "src").join(had, "src", "left")
    left = left.select("src", "cls", "rows", (F.col("share") * F.col("source_size") - F.coalesce("had", F.lit(0))).alias("budget"))
    small = drawn(placed.filter("cls < 0"), written(left, "budgets"))
    copies = F.col("base") + F.col("take")
    return large.unionByName(small).select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "key")


def mixed_documents(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """The mix itself: every document as often as ``mix`` takes it, with all its columns.

    Rows equal in id, source and text come as often as they are taken together.
    """
    each = mix(docs, weights, most, seed, id_col, text_col, source_col)
    longest = "_" * max(len(c) for c in docs.columns)
    key, n, times = f"{longest}key", f"{longest}n", f"{longest}times"
    totals = written(each.groupBy(F.col("key").alias(key)).agg(F.sum("copies").alias(times), F.count("*").alias(n)).filter(F.col(times) > 0), "times")
    rows = docs.withColumn(key, _key(id_col, text_col, source_col)).join(totals, key)
    out = rows.filter(F.col(n) == 1).unionByName(rows.filter(F.col(n) > 1).dropDuplicates([key]))
    return out.withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*docs.columns)


def mix_sql(weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 42) -> str:
    """The mix of table ``documents`` as DuckDB SQL, without ``key``."""

    def uniform(text: str) -> str:
        return f"((CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST({VALUES:.0f} AS DOUBLE))"

    least = f"CAST({LEAST!r} AS DOUBLE)"
    return f"""
WITH keyed AS (
  SELECT doc_id, coalesce('+' || source, ',') AS src, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || md5(coalesce(text, '')) || coalesce('+' || source, ',')) AS key FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY key) - 1 AS copy FROM keyed),
sources AS (SELECT src, count(*) AS n, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY src),
weighed AS (SELECT *, CAST(list_value({", ".join(map(str, weights))})[(row_number() OVER (ORDER BY encode(src)) - 1) % {len(weights)} + 1] AS BIGINT) AS weight FROM sources),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum({most} * source_size) OVER w, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS level,
         row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, src) AS turn
  FROM weighed WINDOW w AS (ORDER BY CAST(source_size AS DOUBLE) / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (
  SELECT src, n, source_size, least((SELECT arg_min(level, turn) FROM levels WHERE level * weight <= {most} * source_size) * weight, CAST({most} * source_size AS DOUBLE)) AS target FROM levels),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM goal),
based AS (SELECT *, CAST(floor(rate) AS BIGINT) AS base, rate - floor(rate) AS share FROM rated),
classed AS (SELECT d.*, b.source_size, b.target, b.base, b.share, CASE WHEN d.size * b.n <= b.source_size THEN -1 ELSE length(bin(d.size)) - 1 END AS cls FROM numbered d JOIN based b USING (src)),
sums AS (
  SELECT src, cls, count(*) AS rows, CAST(sum(size) AS BIGINT) AS words, CAST(sum(size * size) AS DOUBLE) AS squares, any_value(share) AS share,
         CAST(sum(size) AS DOUBLE) / count(*) AS mean, any_value(share) * count(*) AS want
  FROM classed GROUP BY src, cls),
fixed AS (SELECT *, CAST(floor(want) + CAST({uniform(f"'{seed}:' || CAST(cls AS VARCHAR) || src")} < want - floor(want) AS INTEGER) AS BIGINT) AS fixed, squares - words * mean AS spread FROM sums),
strata AS (
  SELECT src, cls, fixed, mean, CASE WHEN cls >= 0 THEN CAST(fixed AS DOUBLE) / rows ELSE share END AS level,
         CASE WHEN cls >= 0 AND spread > 0 THEN (share * words - fixed * mean) / spread ELSE 0 END AS tilt
  FROM fixed),
random AS (
  SELECT c.*, s.fixed, {uniform(f"'{seed}:' || CAST(copy AS VARCHAR) || ':' || key")} AS u,
         greatest({least}, least(1 - {least}, level + tilt * (size - mean))) AS chance
  FROM classed c JOIN strata s USING (src, cls)),
ranks AS (SELECT *, (u / (1 - u)) / (chance / (1 - chance)) AS q FROM random),
large AS (SELECT *, CAST(row_number() OVER (PARTITION BY src, cls ORDER BY q, key, copy) <= fixed AS INTEGER) AS take FROM ranks WHERE cls >= 0),
had AS (SELECT src, CAST(sum(size * take) AS BIGINT) AS had FROM large GROUP BY src),
small AS (
  SELECT r.*, CAST(coalesce(sum(size) OVER (PARTITION BY src ORDER BY q, key, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CAST(size AS DOUBLE) / 2
                   <= share * source_size - coalesce(had, 0) AS INTEGER) AS take
  FROM ranks r LEFT JOIN had USING (src) WHERE cls < 0),
both_ AS (SELECT doc_id, size, source_size, target, base, take FROM large UNION ALL SELECT doc_id, size, source_size, target, base, take FROM small)
SELECT doc_id, size, source_size, target, (base + take) * size AS taken, base + take AS copies FROM both_"""
