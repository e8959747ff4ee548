"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.llm import (
    chosen_path, decontaminate, hard_negatives, html_mincut, language_zstd, line_rules, partenum_join, passage_mil, raking,
    token_alignment, token_files, url_rules, warc,
)
from lawloom.llm.columns import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.warc_table(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op2_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), size=2)


@query
def op3_passage_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = passage_mil.fit_quality(docs, labels, ~held_out)
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return passage_mil.score_documents(rows, model, carry=["doc_id", "held_out"])


@query
def op4_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return html_mincut.extract(pages, html_mincut.fit_classifier(pages), carry=["page_id", "url"])


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark", "item_id", "text"), ["doc_id"])
    return found.select(
        "row.doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


@query
def op6_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    drawn = raking.sample_to_targets(docs, carry=["doc_id", "source", "lang"])
    return drawn.select("row.*", "topic", "n_tokens", "probability", "sampled")


@query
def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_rules.judge_documents(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return judged.drop("text", "source")


@query
def op8_language_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language_zstd.fit_languages(docs.filter(~F.coalesce(held_out, F.lit(False))))
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return language_zstd.identify(rows, model, carry=["doc_id", "held_out"])


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    read = token_files.token_table(docs, public_tokenizers.path("word_bpe_49k.json"))
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.judge_urls(table(spark, sf_dir, "pages", "page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "pattern_rule", "verdict")


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.align_documents(docs, a, b, carry=["doc_id"]).select("row.*", "*").drop("row")


@query
def op13_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum_join.similar_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
