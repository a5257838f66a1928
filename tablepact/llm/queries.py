"""The queries of the training-data operators, over whole tables, and their SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, merkle, negatives, ordinal, quality, similarity, tokens, toxicity, urls, vectors, warc
from .common import fold, table

VOCABULARY = "byte_bpe_50k.json"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return back.select(warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of(F.col("refers_to")).alias("refers_to"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


#: Languages that a page may be written in; pages in others are the bad ones of the URL filter.
WANTED = ("en",)
LANG_ATTRIBUTE = r"(?is)^.{0,2000}?<html[^>]*\slang\s*=\s*[\"']?([A-Za-z]+)"


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels from what the pages hold, not from their addresses: a page is bad if the language that its html names isn't one of
    ``WANTED``; pages that name none have no label. Only pages whose crc32(page_id as text) mod 2 is 0 are labelled: what
    templates and hosts learn from these judges the others, on which a test measures it."""
    lang = F.lower(F.regexp_extract("html", LANG_ATTRIBUTE, 1))
    some = table(spark, sf_dir, "pages").where(fold(F.col("page_id"), 2) == 0)
    return some.select("page_id", lang.alias("lang")).where("lang <> ''").select("page_id", (~F.col("lang").isin(*WANTED)).cast("int").alias("bad"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), page_labels(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = fold(F.col("doc_id"), 3)
    model = language.learn(docs.where(part != 1))
    return language.identify(docs, model).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "languages")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")), quality.PROSE)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~quality.passes(quality.BASE)).alias("base_failed"), "kept")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grades = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0).select("doc_id", F.col("quality").alias("grade"))
    graded = ordinal.grade_documents(docs, ordinal.train(docs, grades), 1.0)
    return graded.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.5).alias("kept"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), columns=("n_tokens", "ids_sha256", "decoded_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_matches")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, merkle.lowered(columns, "text"))
    return merkle.manifest(docs, columns=columns, claimed=tampered)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id = F.col("vec_id")
    label = F.when(vec_id % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label")))


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_minhash_dedup, op3_token_counts, op4_decontamination, op5_url_filters, op6_language_id, op7_quality_rules, op8_quality_classifier, op9_bpe, op10_toxicity, op11_merkle_manifest, op12_hard_negatives, op13_vector_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.ORACLE_SQL, "op2_minhash_dedup": similarity.ORACLE_SQL, "op4_decontamination": decontaminate.ORACLE_SQL, "op7_quality_rules": quality.ORACLE_SQL,
            "op11_merkle_manifest": merkle.ORACLE_SQL, "op12_hard_negatives": negatives.ORACLE_SQL, "op13_vector_dedup": vectors.ORACLE_SQL}
