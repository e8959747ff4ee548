"""Retrieval quality: rank of the expected chunk, hit rates, reciprocal rank, keyword recall."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawloom.functions.text import keyword_text, strip
from lawloom.operators.retrieval import safe_float


def clamped(top_k: int, candidate_top_k: int | None, context_top_k: int, max_candidates: int = 30) -> tuple[int, int, int]:
    """(final, candidate, context) sizes."""
    final = max(top_k, 5)
    return final, max(candidate_top_k or max_candidates, final), min(max(context_top_k, 1), final)


def keywords(c: Column) -> Column:
    """Split at ; or , then normalised, non-empty, distinct in order."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[;,]"), keyword_text)
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def context_part() -> Column:
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in
             ("title", "section_path", "doc_title", "article_title", "text")]
    return F.concat_ws(" ", *shown)


def title_part() -> Column:
    shown = F.coalesce(F.nullif("title", F.lit("")), F.nullif("section_path", F.lit("")), F.lit(""))
    return strip(F.replace(shown, F.lit("\n"), F.lit(" ")))


def score_part() -> Column:
    return F.format_string("%.6f", safe_float(F.coalesce("rerank_score", "score")))


def evaluate(questions: DataFrame, results: DataFrame, context_top_k: int = 3) -> DataFrame:
    """One metric row per question.

    ``questions``: test_id, question, expected_chunk_id, expected_keywords, candidate_count.
    ``results``: test_id, rank, key, title, section_path, doc_title, article_title, text, score,
    rerank_score, rerank_model; at most the final top-k per question, so one group stays small.
    """
    expected = questions.select("test_id", strip(F.col("expected_chunk_id").cast("string")).alias("__expected"))
    tagged = results.join(expected, "test_id")
    in_context = F.when(F.col("rank") <= context_top_k, context_part())
    hit = (F.col("key").cast("string") == F.col("__expected")) & (F.col("__expected") != "")
    listed = lambda c, sep: F.expr(f"listagg({c}, '{sep}') WITHIN GROUP (ORDER BY rank)")
    per_question = (
        tagged.withColumn("__ctx", in_context)
        .withColumn("__key", F.col("key").cast("string"))
        .withColumn("__title", title_part())
        .withColumn("__score", score_part())
        .groupBy("test_id")
        .agg(
            F.min(F.when(hit, F.col("rank"))).alias("expected_rank"),
            listed("__ctx", " ").alias("__context"),
            listed("__key", "|").alias("retrieved_chunk_ids"),
            listed("__title", "|").alias("retrieved_titles"),
            listed("__score", "|").alias("retrieved_scores"),
            F.min_by("rerank_model", "rank").alias("rerank_model"),
            F.count("*").alias("retrieved_count"),
        )
    )
    rank = F.col("expected_rank")
    words = keywords(F.col("expected_keywords"))
    context = keyword_text(F.col("__context"))
    matched = F.size(F.filter(words, lambda w: F.contains(F.col("__normal"), w)))
    recall = F.when(F.size(words) == 0, F.when(rank <= context_top_k, 1.0).otherwise(0.0)).otherwise(
        F.when(F.col("__normal") == "", 0.0).otherwise(matched / F.size(words))
    )
    hit_at = lambda n: F.when(rank <= n, 1).otherwise(0)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return (
        questions.join(per_question, "test_id", "left")
        .withColumn("__normal", F.coalesce(context, F.lit("")))
        .select(
            *questions.columns,
            "expected_rank",
            hit_at(1).alias("hit_at_1"),
            hit_at(3).alias("hit_at_3"),
            hit_at(5).alias("hit_at_5"),
            F.coalesce(F.lit(1.0) / rank, F.lit(0.0)).alias("reciprocal_rank"),
            recall.alias("context_recall"),
            text("retrieved_chunk_ids"),
            text("retrieved_titles"),
            text("retrieved_scores"),
            text("rerank_model"),
            F.coalesce("retrieved_count", F.lit(0)).alias("retrieved_count"),
        )
    )


METRICS = ("hit_at_1", "hit_at_3", "hit_at_5", "reciprocal_rank", "context_recall")


def evaluation_run(
    questions: DataFrame, search: Callable[[DataFrame, int, int], DataFrame], top_k: int = 5,
    candidate_top_k: int | None = None, context_top_k: int = 3,
) -> DataFrame:
    """Search the questions with sizes inside their bounds, and score the results: one metric row per question.

    ``search`` takes the questions, the final size and the number of candidates and returns results as `evaluate` reads
    them; ranks beyond the final size do not count."""
    final, candidates, context = clamped(top_k, candidate_top_k, context_top_k)
    results = search(questions, final, candidates).filter(F.col("rank") <= final)
    return evaluate(questions, results, context)


def summarize(rows: DataFrame) -> DataFrame:
    """Means over all questions, zeros for an empty set."""
    names = {"reciprocal_rank": "mrr"}
    return rows.agg(
        F.count("*").alias("total"),
        *[F.coalesce(F.avg(m), F.lit(0.0)).alias(names.get(m, m)) for m in METRICS],
    )
