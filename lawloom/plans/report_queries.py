"""Registered queries: conversations, dashboard, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lawloom import session
from lawloom.operators import conversations as A
from lawloom.operators import evaluation as E
from lawloom.operators import retrieval as R
from lawloom.plans import inputs as I
from lawloom.plans.registry import query
from lawloom.plans.retrieval_queries import hits, unfiltered
from lawloom.sources import sinks


def _seconds(c):
    return F.unix_seconds(F.col(c)).alias(c)


@query
def ana_1_session_search(spark, sf_dir):
    """Live sessions that mention a word and have no feedback or are newer, one page."""
    s, m, f = I.sessions(spark, sf_dir), I.messages(spark, sf_dir), I.feedback(spark, sf_dir)
    found = A.search_sessions(s, m, f, search="the", has_feedback=True, date_from=F.timestamp_seconds(F.lit(1704067200)))
    return A.session_page(found, limit=20, offset=1).select("session_id", "user_id", "title", _seconds("updated_at"))


@query
def ana_2_last_messages(spark, sf_dir):
    out = A.with_last_message(I.sessions(spark, sf_dir), I.messages(spark, sf_dir))
    return out.select("session_id", "last_message_preview", "message_count")


@query
def ana_3_messages_with_trace(spark, sf_dir):
    owner = I.sessions(spark, sf_dir).select("session_id", "user_id")
    f = I.feedback(spark, sf_dir).filter("again = 0")
    out = A.messages_with_trace(I.messages(spark, sf_dir), I.traces(spark, sf_dir), f, owner)
    return out.select("message_id", "role", "route", "latency_ms", "own_rating")


@query
def ana_4_chat_history(spark, sf_dir):
    return A.last_messages(I.messages(spark, sf_dir), 12).select("session_id", "message_id", "role", "back")


@query
def ana_5_recorded_turns(spark, sf_dir):
    """Every user message and the answer after it, recorded as a turn."""
    m = I.messages(spark, sf_dir)
    asked = A.question_for_answer(m)
    turns = asked.filter("q IS NOT NULL").select(
        F.col("message_id").cast("string").alias("turn_id"), "session_id", F.col("q.text").alias("question"),
        F.col("content").alias("answer"), F.lit("broad").alias("route"), F.col("q.at").alias("started_at"),
        F.col("created_at").alias("finished_at"), F.lit("stub").alias("model_name"),
        F.array(F.col("q.id").cast("string")).alias("sources"), F.array().cast("array<string>").alias("citations"),
    )
    messages, traces, sessions = A.record_turns(I.sessions(spark, sf_dir), turns)
    latency = traces.groupBy().agg(F.sum("latency_ms").alias("n")).select(F.lit("latency").alias("what"), "n")
    roles = messages.groupBy(F.col("role").alias("what")).agg(F.count("*").alias("n"))
    titled = sessions.filter("title IS NOT NULL").groupBy().agg(F.count("*").alias("n")).select(F.lit("titled").alias("what"), "n")
    return roles.unionByName(latency).unionByName(titled)


@query
def ana_6_feedback_upsert(spark, sf_dir):
    f, m, s = I.feedback(spark, sf_dir), I.messages(spark, sf_dir), I.sessions(spark, sf_dir)
    valid = A.valid_feedback(f, m, s)
    out = A.upsert_feedback(valid.filter("again = 0"), valid, ["created_at", "feedback_id"])
    return out.select("message_id", "user_id", "rating", "reason")


@query
def ana_7_feedback_page(spark, sf_dir):
    f = A.filter_feedback(I.feedback(spark, sf_dir), reason="outdated", admin_status="open")
    page = f.orderBy(F.col("created_at").desc(), "feedback_id").offset(1).limit(20)
    return page.select("feedback_id", "rating", "reason", _seconds("created_at"))


@query
def ana_8_question_for_answer(spark, sf_dir):
    out = A.question_for_answer(I.messages(spark, sf_dir))
    return out.select("message_id", F.col("q.id").alias("question_id"), F.length("q.text").alias("chars"))


@query
def ana_9_reviews(spark, sf_dir):
    f = I.feedback(spark, sf_dir)
    reviews = f.filter("rating <= 2").select(
        "feedback_id", F.lit("resolved").alias("admin_status"), F.when(F.col("rating") == 1, "fixed").alias("admin_note"),
        F.lit(99).cast("bigint").alias("reviewer"), F.timestamp_seconds(F.lit(1710000000)).alias("at"),
    )
    return A.review_feedback(f, reviews).select("feedback_id", "admin_status", "admin_note", "reviewed_by", _seconds("reviewed_at"))


@query
def ana_10_totals(spark, sf_dir):
    out = A.dashboard_totals(
        I.sessions(spark, sf_dir), I.messages(spark, sf_dir), I.feedback(spark, sf_dir), I.traces(spark, sf_dir)
    )
    rounded = [F.round(c, 6).alias(c) for c in ("average_rating", "average_latency_ms")]
    return out.select("total_sessions", "total_messages", "total_feedbacks", *rounded)


@query
def ana_11_ratings(spark, sf_dir):
    return A.rating_distribution(I.feedback(spark, sf_dir))


@query
def ana_12_low_rating_reasons(spark, sf_dir):
    return A.low_rating_reasons(I.feedback(spark, sf_dir))


@query
def ana_13_routes(spark, sf_dir):
    return A.route_distribution(I.traces(spark, sf_dir))


@query
def ana_14_recent(spark, sf_dir):
    f = A.recent(I.feedback(spark, sf_dir), "created_at", "feedback_id")
    s = A.recent(I.sessions(spark, sf_dir).filter("deleted_at IS NULL"), "updated_at", "session_id")
    return f.select(F.lit("feedback").alias("what"), F.col("feedback_id").alias("id"), _seconds("created_at")).unionByName(
        s.select(F.lit("session").alias("what"), F.col("session_id").alias("id"), F.unix_seconds("updated_at").alias("created_at"))
    )


@query
def ana_15_soft_delete(spark, sf_dir):
    """Delete the sessions with a rating of 1."""
    s, f = I.sessions(spark, sf_dir), I.feedback(spark, sf_dir)
    bad = f.filter("rating = 1").join(I.messages(spark, sf_dir).select("message_id", "session_id"), "message_id")
    out = A.soft_delete(s, bad.select("session_id"), F.timestamp_seconds(F.lit(1710000000)))
    return out.select("session_id", _seconds("updated_at"), _seconds("deleted_at"))


@query
def ana_16_violations(spark, sf_dir):
    return A.feedback_violations(I.feedback(spark, sf_dir), I.messages(spark, sf_dir))


# --- evaluation ------------------------------------------------------------------------


def evaluation_set(spark, sf_dir, found):
    """One question per label; the expected chunk is the hit at place label % 7 + 1 of its plain query."""
    raw = found.filter("query_index = 0")
    chosen = raw.filter("rank = query_id % 7 + 1").select("query_id", F.col("id").alias("expected_id"))
    counted = found.groupBy("query_id").agg(F.count("*").alias("candidate_count"))
    docs = I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("expected_id"), "source", "lang", "text")
    words = F.concat_ws(";", "source", "lang", F.regexp_replace("text", "[.]", ";"), F.lit("no such term"))
    label = F.col("query_id")
    return (
        counted.join(chosen, "query_id", "left").join(docs, "expected_id", "left")
        .select(
            F.concat(F.lit("t"), label.cast("string")).alias("test_id"),
            F.concat(F.lit("label "), label.cast("string")).alias("question"),
            F.coalesce(F.col("expected_id").cast("string"), F.lit("")).alias("expected_chunk_id"),
            F.when(label % 5 == 4, "").otherwise(words).alias("expected_keywords"),
            "candidate_count",
        )
    )


def evaluation_results(spark, sf_dir, found, top_k=5):
    final = R.rerank(found, F.lit(""), F.lit(""), top_k, enabled=False, fallback_keep="best")
    p = I.points(spark, sf_dir).select("id", "text", "source", "lang", "article_number")
    return final.join(p, "id").select(
        F.concat(F.lit("t"), F.col("query_id").cast("string")).alias("test_id"), F.col("final_rank").alias("rank"),
        F.col("id").alias("key"), F.col("source").alias("title"), F.col("lang").alias("section_path"),
        F.lit(None).cast("string").alias("doc_title"), F.col("article_number").alias("article_title"), "text",
        "score", "rerank_score", "rerank_model",
    )


def evaluated(spark, sf_dir):
    found = session.materialize(hits(spark, sf_dir), "hits")  # one search for the questions and the results
    return E.evaluation_run(evaluation_set(spark, sf_dir, found), lambda _, final, __: evaluation_results(spark, sf_dir, found, final))


@query
def eva_1_keywords(spark, sf_dir):
    c = I.table(spark, sf_dir, "conversations")
    listed = F.regexp_replace("text", "[.]", ";")
    return c.select("conv_id", "turn", F.array_join(E.keywords(listed), "|").alias("keywords"))


@query
def eva_2_expected_ranks(spark, sf_dir):
    return evaluated(spark, sf_dir).select("test_id", "expected_chunk_id", F.coalesce("expected_rank", F.lit(0)).alias("expected_rank"))


@query
def eva_3_context(spark, sf_dir):
    r = evaluation_results(spark, sf_dir, hits(spark, sf_dir)).filter("rank <= 3").withColumn("part", E.context_part())
    text = F.expr("listagg(part, ' ') WITHIN GROUP (ORDER BY rank)")
    from lawloom.functions.text import keyword_text

    return r.groupBy("test_id").agg(text.alias("c")).select("test_id", keyword_text(F.col("c")).alias("context"))


@query
def eva_4_context_recall(spark, sf_dir):
    return evaluated(spark, sf_dir).select("test_id", F.round("context_recall", 6).alias("context_recall"))


@query
def eva_5_question_metrics(spark, sf_dir):
    return evaluated(spark, sf_dir).select(
        "test_id", "hit_at_1", "hit_at_3", "hit_at_5", F.round("reciprocal_rank", 6).alias("reciprocal_rank"),
        "retrieved_count", "candidate_count", "rerank_model",
    )


@query
def eva_6_summary(spark, sf_dir):
    s = E.summarize(evaluated(spark, sf_dir))
    return s.select("total", *[F.round(c, 6).alias(c) for c in s.columns if c != "total"])


@query
def eva_7_compact_lists(spark, sf_dir):
    return evaluated(spark, sf_dir).select("test_id", "retrieved_chunk_ids", "retrieved_titles", "retrieved_scores")


@query
def snk_9_evaluation_files(spark, sf_dir):
    rows = evaluated(spark, sf_dir).withColumns(
        {"expected_document_id": F.lit(""), "expected_chunk_title": F.lit(""), "rank": F.col("expected_rank").cast("string")}
    )
    path = session.scratch_path(spark, "evaluation")
    sinks.write_evaluation(rows, E.summarize(rows), path)
    read = spark.read.option("header", True).option("escape", '"').csv(f"{path}/results")
    total = spark.read.json(f"{path}/summary").select(F.col("total").alias("questions"))
    number = lambda c: F.round(F.col(c).cast("double"), 6).alias(c)
    return read.join(F.broadcast(total)).select(  # the summary is one row
        "test_id", "expected_chunk_id", *[number(c) for c in ("hit_at_1", "hit_at_3", "hit_at_5", "reciprocal_rank", "context_recall")],
        "retrieved_chunk_ids", F.col("retrieved_count").cast("bigint").alias("retrieved_count"), "questions",
    )
