"""Stages of the corpus pipeline. Each takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read
again as the next one's docs. All but the last return the columns of documents. The quality rules take the lines above
their limits out of the texts; the other stages leave the texts of kept documents as they are.

Raking and token files cannot be said in SQL, so the whole has no twin; tests compare it with brute force."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.llm import chosen_path, decontaminate, line_rules, raking, token_files
from lawloom.llm.columns import table
from lawloom.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines above the limits; n_chars is that of the text left."""
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return line_rules.strip_frequent_lines(docs).withColumn("n_chars", n_chars)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates (shingles of five words, similarity 0.8)."""
    return chosen_path.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with tempered shares of sources, languages and topics."""
    return raking.sample_to_targets(docs).filter("sampled").select("row.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents, read back: place, length and checksum of each document."""
    return token_files.token_table(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", token_output),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, "pipeline")
    return docs
