"""The registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismal.llm import chat, decontam, langid, lexical, merkle, mixing, packing, simhash, suffix_dedup, tiff, token_counts, toxicity, warc_zip
from prismal.llm.common import documents


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held = toxicity.remainder("doc_id", 4) == 2
    model = toxicity.fit(docs.select("doc_id", "text").filter(~held), labels.filter(~held))
    scored = toxicity.score_toxicity(docs, model, 0.3)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted", "n_sentences", F.size("offending").alias("n_offending"))


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    records = warc_zip.archive_round_trip(spark, pages, min_bytes=0)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = toxicity.remainder("doc_id", 5) == 0
    profiles = langid.fit_profiles(docs.filter(~held))
    return langid.identify(docs, profiles).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"), 2048)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(documents(spark, sf_dir), size=50)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), _tokenizer("piece_bpe_32k.model"))


def op9_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.media_digest(tiff.text_media(documents(spark, sf_dir)))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("key")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir), altered={"text": merkle.tampered_text()})


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_groups, op2_toxicity, op3_warc_zip, op4_language, op5_perspectives, op6_packing, op7_suffix_dedup, op8_token_counts,
        op9_tiff, op10_decontamination, op11_mixing, op12_merkle_manifest, op13_lexical_search,
    )
}

ORACLES: dict[str, str] = {
    "op3_warc_zip": warc_zip.round_trip_sql(),
    "op7_suffix_dedup": suffix_dedup.repeated_spans_sql(),
    "op5_perspectives": chat.perspectives_sql(),
    "op10_decontamination": decontam.contaminated_sql(),
    "op11_mixing": mixing.mix_sql(),
    "op12_merkle_manifest": merkle.manifest_sql(),
    "op13_lexical_search": lexical.search_sql(k=10),
}
