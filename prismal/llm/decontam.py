"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is in a document when at least ``share`` of its distinct word shingles
are.  Items are partitioned by the binary logarithm of their size.  A partition
sets, from the most shingles M that one of its items may miss, the length 2 M + 1
of its items' MinHash sketches (the smallest hashes of an item) and the least
number of sketch hashes, all but M, that a document must have: a document that
holds the item misses at most M of any of its hashes, so recall is 1.  Of a
document only hashes up to the largest one in any sketch are looked up.  Every
candidate is then verified by exact containment of the shingle texts.  Only
DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismal.llm.common import BROADCAST_IDS, written

#: Sketch rows up to which the sketch table is broadcast (16 bytes each); above, both sides are shuffled.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row: in a lambda's body it would be computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingles(text: Column, size: int) -> Column:
    """Word shingles of a text, repeats included; the whole sequence for fewer words, nothing for none."""

    def of(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.array_join(F.slice(w, i, size), " "))
        return F.when(n >= size, many).when(n > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))

    return _once(words(text), of)


def shingle_hashes(text: Column, size: int) -> Column:
    """Chained XXH64 of the shingles' words, repeats included."""

    def of(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))))
        return F.when(n >= size, many).when(n > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))

    return _once(words(text), of)


def item_table(benchmark: DataFrame, share: float, size: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct items: ``item_id`` (smallest of equal ones), ``grams``, ``n_item``, ``need``; items without words are left out."""
    grams = F.array_sort(F.array_distinct(shingles(F.col(text_col), size)))
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), grams.alias("grams"), F.array_distinct(shingle_hashes(F.col(text_col), size)).alias("hashes"))
    items = items.filter(F.size("grams") > 0).groupBy("grams").agg(F.min("item_id").alias("item_id"), F.first("hashes").alias("hashes"))
    n = F.size("grams")
    # the small excess keeps 0.8 * 5 at 4
    return items.withColumn("n_item", n).withColumn("need", F.ceil(n * F.lit(share) - 1e-9).cast("int"))


def partitions(items: DataFrame) -> DataFrame:
    """``part, misses, length, least`` of every size partition: shingles an item may miss, hashes of a sketch, shingles a document needs."""
    sizes = items.groupBy(F.floor(F.log2("n_item")).cast("int").alias("part")).agg(F.max(F.col("n_item") - F.col("need")).alias("misses"), F.min("need").alias("least"))
    return sizes.withColumn("length", 2 * F.col("misses") + 1)


def sketches(items: DataFrame) -> DataFrame:
    """``h, item_id, hits, least``: the MinHash sketch of every item and the number of its hashes that a document must have."""
    each = items.withColumn("part", F.floor(F.log2("n_item")).cast("int")).join(F.broadcast(partitions(items)), "part")
    smallest = F.slice(F.array_sort("hashes"), F.lit(1), F.col("length"))
    hits = F.greatest(F.lit(1), F.least("length", F.size("hashes")) - F.col("misses"))
    return each.select(F.explode(smallest).alias("h"), "item_id", hits.alias("hits"), "least")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``i, t, text``: what names a row (its id as text, empty for none, and its text's hash) and its text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")).alias("i"), F.xxhash64(text).alias("t"), text.alias("text"))


def candidates(docs: DataFrame, sketch: DataFrame, size: int) -> DataFrame:
    """``i, t, item_id`` of documents (``i, t, text``) that have as many of an item's sketch hashes as its partition asks for."""
    found = sketch.agg(F.max("h").alias("top"), F.count("*").alias("n")).first()
    side = F.broadcast(sketch) if found.n <= BROADCAST_ROWS else sketch
    hashes = docs.select("i", "t", F.array_distinct(shingle_hashes(F.col("text"), size)).alias("hs"))
    probe = hashes.select("i", "t", F.size("hs").alias("n_doc"), F.explode("hs").alias("h")).filter(F.col("h") <= F.lit(found.top if found.n else 0))
    met = probe.join(side, "h").filter(F.col("n_doc") >= F.col("least")).select("i", "t", "item_id", "hits", "h").distinct()
    return met.groupBy("i", "t", "item_id", "hits").agg(F.count("*").alias("n")).filter("n >= hits").select("i", "t", "item_id")


def _verified(docs: DataFrame, benchmark: DataFrame, share: float, size: int, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """``i, t, item_id, n_item, n_shared`` of every row that holds an item."""
    items = written(item_table(benchmark, share, size, item_col, item_text_col), "items")
    rows = _rows(docs, id_col, text_col)
    pairs = written(candidates(rows, written(sketches(items), "sketches"), size), "candidates")
    named = pairs.select("i", "t").distinct()
    few = pairs.count() <= BROADCAST_IDS
    texts = rows.join(F.broadcast(named) if few else named, ["i", "t"], "left_semi").dropDuplicates(["i", "t"])
    grams = texts.select("i", "t", F.array_distinct(shingles(F.col("text"), size)).alias("doc_grams"))
    both = pairs.join(items.select("item_id", "grams", "n_item", "need"), "item_id").join(grams, ["i", "t"])
    shared = both.select("i", "t", "item_id", "n_item", "need", F.size(F.array_intersect("grams", "doc_grams")).alias("n_shared"))
    return shared.filter(F.col("n_shared") >= F.col("need")).drop("need")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, share: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Documents that hold a benchmark item: ``doc_id, item_id, n_item, n_shared, containment``.

    One row per document and distinct item with at least ``share`` of the
    item's distinct shingles of ``size`` words in the whole text; equal items
    count once, under their smallest id.  Shingles are over lower-case letter
    and digit runs; a text of fewer words is one shingle.  Null and empty texts
    hold nothing and are held by nothing.  Rows with a null document id are left
    out, as nothing names them; repeated rows count once; differing texts under one
    id are each compared and the best is returned.  Other columns are ignored,
    whatever their names.
    """
    held = _verified(docs, benchmark, share, size, id_col, text_col, item_col, item_text_col).filter("i <> ''")
    best = held.groupBy(F.col("i").cast("long").alias("doc_id"), "item_id").agg(F.max("n_item").alias("n_item"), F.max("n_shared").alias("n_shared"))
    return best.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, share: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Rows that hold no benchmark item, as ``contaminated`` finds them; columns stay as they are.

    Rows are decided one by one: those without an id go for their text too, and
    of differing texts under one id only those that hold an item go.
    """
    held = _verified(docs, benchmark, share, size, id_col, text_col, item_col, item_text_col)
    longest = "_" * max(len(c) for c in docs.columns)
    i, t = f"{longest}i", f"{longest}t"
    gone = written(held.select(F.col("i").alias(i), F.col("t").alias(t)).distinct(), "held")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    own = F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))
    return docs.join(side, (own == F.col(i)) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(t)), "left_anti")


def contaminated_sql(share: float = 0.8, size: int = 5) -> str:
    """The same over tables ``documents`` and ``benchmark`` as DuckDB SQL."""

    def grams(table: str, key: str) -> str:
        return f"""
  SELECT DISTINCT {key}, CASE WHEN len(w) >= {size} THEN unnest(list_transform(range(1, greatest(len(w) - {size} + 2, 2)), lambda i: array_to_string(w[i:i + {size} - 1], ' '))) ELSE array_to_string(w, ' ') END AS gram
  FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {table}) WHERE len(w) > 0"""

    return f"""
WITH d AS ({grams("documents", "doc_id")}),
b AS ({grams("benchmark", "item_id")}),
sets AS (SELECT item_id, list_sort(list(gram)) AS g FROM b GROUP BY item_id),
firsts AS (SELECT min(item_id) AS item_id, len(g) AS n_item FROM sets GROUP BY g),
hits AS (
  SELECT d.doc_id, b.item_id, count(*) AS n FROM d JOIN b USING (gram) GROUP BY 1, 2)
SELECT h.doc_id, h.item_id, CAST(f.n_item AS INTEGER) AS n_item, CAST(h.n AS INTEGER) AS n_shared, h.n / f.n_item AS containment
FROM hits h JOIN firsts f USING (item_id)
WHERE h.n >= ceil(f.n_item * {share} - 1e-9)"""
