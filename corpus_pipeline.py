"""A corpus pipeline over ``documents``: quality rules, quality classifier, near-duplicate removal, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; what it rejects is gone for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.llm import decontaminate, ordinal, quality, similarity, tokens
from tablepact.llm.common import materialize, table
from tablepact.llm.queries import VOCABULARY

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy PROSE keeps."""
    return quality.filter_documents(docs.select(*COLUMNS), quality.PROSE)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade is at least 1 with a probability of one half; learned from the labels of all documents."""
    grades = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("grade"))
    return ordinal.select_documents(docs.select(*COLUMNS), ordinal.train(table(spark, sf_dir, "documents"), grades), 1.0)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies, whose shingles are alike by 80 percent at least."""
    return similarity.one_of_each(docs.select(*COLUMNS), percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    return decontaminate.clean_documents(spark, docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of the text that they decode to."""
    return tokens.encode(docs, public_tokenizers.path(VOCABULARY), columns=("ids", "n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [("quality_rules", quality_rules), ("quality_classifier", quality_classifier), ("near_dedup", near_dedup), ("decontamination", decontamination), ("encoding", encoding)]
#: The classifier can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
