"""Corpus pipeline: language ID, near-duplicate removal, decontamination, secret redaction, packing.

Every stage takes the documents its predecessor kept. It cannot be told in SQL (a fitted model, a search, a genetic algorithm), so
tests/llm/test_pipeline.py holds each stage against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pickwise.llm import crf_langid, grouping_pack, secret_ledger, set_relation_join, wand_decontaminate
from pickwise.llm.common import held_out
from pickwise.session import cut_lineage, scratch_path

LEAST_SCORE = 0.3  # mean posterior below which no language is believed; clean text scores far above it


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or with no believable language go."""
    model = crf_langid.fit(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang"))
    return crf_langid.known_only(docs, model, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return set_relation_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    question, answer = wand_decontaminate.split_item(F.col("text"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", question.alias("question"), answer.alias("answer"))
    return wand_decontaminate.clean_only(docs, items)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text is masked, and n_chars counted anew; no document goes."""
    clean = secret_ledger.redacted(docs, scratch_path(spark, "ledger"))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 1024 tokens."""
    return grouping_pack.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
    ("redact_secrets", redact_secrets), ("pack", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
