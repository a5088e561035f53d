"""A corpus pipeline of five stages over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismal.llm import decontam, near_copies, packing, simhash, suffix_dedup, toxicity
from prismal.llm.common import documents, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the multiple-instance model does not reject.

    A null text is one empty sentence.  Null and repeated ids and further columns
    are kept; labels with a null, or of no document, are ignored.  Without
    labels of both classes every sentence has the smoothed rate.  An empty table
    stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held = toxicity.remainder("doc_id", 4) == 2
    model = toxicity.fit(docs.select("doc_id", "text").filter(~held), labels.filter(~held))
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash fingerprints at most 3 bits apart, or Jaccard similarity of 5-word shingles of 0.8 or more.

    Operator 1's groups come first; the exact search for what lies further
    apart starts from them, and a group is whatever either links.  The smallest
    id stays; rows without an id come after all others, by their text's hash.
    Rows equal in text are one; differing texts under one id are decided each.
    A null text is empty, texts without words are alike.  Texts are compared
    whole, however long; further columns are kept; an empty table stays empty.
    """
    return near_copies.keep_first(docs, known=simhash.fingerprint_groups)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, later copies of repeated 50-byte strings cut out of its text; ``n_chars`` follows the text.

    Rows without an id come after all others and do not cut each other, nor do
    rows of one id.  A null text stays null, one that goes as a whole is empty.
    Further columns are kept, whatever their names; an empty table stays empty.
    """
    cut = suffix_dedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in cut.columns else cut


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    Rows are decided by id and text, those without an id by their text.  Null
    and empty texts stay; items without words are in nothing.  Further columns
    are kept; an empty table, or benchmark, changes nothing.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its place in a sequence of at most 2048 tokens.

    Null and empty texts are one token, the end mark; longer texts than a
    sequence are pieces.  Null and repeated ids are packed row by row; further
    columns are left out; an empty table gives no row.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("suffix", cut_repeats),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: No SQL: the model, the tokenizer and the fingerprints are beyond it; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
