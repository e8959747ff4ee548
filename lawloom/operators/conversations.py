"""Sessions, messages, traces and feedback: lists, merges and the dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawloom.functions.text import generated_title, preview, strip
from lawloom.operators import ordered
from lawloom.operators.ordered import top_per_key

LOW_RATING = 3
# Allowed values of the checked columns.
ROLES = ("user", "assistant")
REASONS = ("incorrect", "incomplete", "irrelevant", "bad_citation", "outdated", "other")
ADMIN_STATUSES = ("open", "reviewed", "resolved")


# --- sessions ------------------------------------------------------------------------


def message_stats(messages: DataFrame) -> DataFrame:
    """Last message and message count per session in one aggregate."""
    return messages.groupBy("session_id").agg(
        F.max_by("content", F.struct("created_at", "message_id")).alias("last_content"),
        F.count("*").alias("message_count"),
    )


def with_last_message(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    joined = sessions.join(message_stats(messages), "session_id", "left")
    return joined.select(
        *sessions.columns,
        preview(F.col("last_content")).alias("last_message_preview"),
        F.coalesce("message_count", F.lit(0)).alias("message_count"),
    )


def search_sessions(
    sessions: DataFrame,
    messages: DataFrame,
    feedback: DataFrame,
    search: str | None = None,
    has_feedback: bool | None = None,
    date_from=None,
    date_to=None,
    user_id=None,
) -> DataFrame:
    """Live sessions that match: title or any message, date range, with or without feedback."""
    found = sessions.filter(F.col("deleted_at").isNull())
    if user_id is not None:
        found = found.filter(F.col("user_id") == user_id)
    if date_from is not None:
        found = found.filter(F.col("updated_at") >= date_from)
    if date_to is not None:
        found = found.filter(F.col("updated_at") <= date_to)
    if search:
        pattern = F.lit(f"%{search.strip()}%")
        named = found.filter(F.ilike("title", pattern))
        hits = messages.filter(F.ilike("content", pattern)).select("session_id").distinct()
        rest = found.filter(~F.coalesce(F.ilike("title", pattern), F.lit(False)))
        found = named.unionByName(rest.join(hits, "session_id", "left_semi"))
    if has_feedback is not None:
        rated = messages.join(feedback.select("message_id").distinct(), "message_id", "left_semi")
        rated = rated.select("session_id").distinct()
        found = found.join(rated, "session_id", "left_semi" if has_feedback else "left_anti")
    return found


def session_page(sessions: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    return sessions.orderBy(F.col("updated_at").desc(), F.col("session_id")).offset(offset).limit(limit)


def soft_delete(sessions: DataFrame, targets: DataFrame, at: Column) -> DataFrame:
    """Mark the target sessions deleted; already deleted ones keep their time."""
    marked = sessions.join(targets.select("session_id").distinct().withColumn("__hit", F.lit(True)), "session_id", "left")
    now = F.col("__hit") & F.col("deleted_at").isNull()
    changes = {c: F.when(now, at).otherwise(F.col(c)).alias(c) for c in ("deleted_at", "updated_at")}
    return marked.select(*[changes.get(c, F.col(c)) for c in sessions.columns])


# --- messages ------------------------------------------------------------------------


def messages_with_trace(messages: DataFrame, traces: DataFrame, feedback: DataFrame, viewer: DataFrame) -> DataFrame:
    """Messages with their trace and, on assistant messages, the session owner's own feedback.

    ``viewer``: session_id, user_id.
    """
    t = traces.select("message_id", "route", "latency_ms")
    own = feedback.select("message_id", "user_id", F.col("rating").alias("own_rating"))
    joined = messages.join(viewer, "session_id", "left").join(t, "message_id", "left")
    return joined.join(
        own.withColumn("__role", F.lit("assistant")),
        (joined["message_id"] == own["message_id"])
        & (joined["user_id"] == own["user_id"])
        & (joined["role"] == F.col("__role")),
        "left",
    ).select(*[joined[c] for c in joined.columns], "own_rating")


def last_messages(messages: DataFrame, limit: int = 12) -> DataFrame:
    """The newest messages of each session with their position in ascending order."""
    newest = top_per_key(
        messages, ["session_id"], [F.col("created_at").desc(), F.col("message_id").desc()], limit, "back"
    )
    return newest


def record_turns(sessions: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages, traces, sessions) after answered turns.

    ``turns``: turn_id, session_id, question, answer, route, started_at, finished_at, model_name, sources,
    citations. A session without a title takes it from its first question.
    """
    user = turns.select(
        F.concat(F.col("turn_id"), F.lit(":u")).alias("message_id"), "session_id", F.lit("user").alias("role"),
        strip(F.col("question")).alias("content"), F.col("started_at").alias("created_at"),
    )
    answer_id = F.concat(F.col("turn_id"), F.lit(":a"))
    assistant = turns.select(
        answer_id.alias("message_id"), "session_id", F.lit("assistant").alias("role"),
        F.coalesce("answer", F.lit("")).alias("content"), F.col("finished_at").alias("created_at"),
    )
    millis = (F.unix_millis("finished_at") - F.unix_millis("started_at")).cast("int")
    empty = F.array().cast(turns.schema["sources"].dataType)
    traces = turns.select(
        answer_id.alias("message_id"), "route", millis.alias("latency_ms"), "model_name",
        F.coalesce("sources", empty).alias("retrieved_contexts"),
        F.when(F.size("citations") > 0, F.col("citations")).otherwise(F.coalesce("sources", empty)).alias("citations"),
    )
    first = turns.groupBy("session_id").agg(
        F.min_by("question", F.struct("started_at", "turn_id")).alias("__q"), F.max("finished_at").alias("__at")
    )
    changes = {
        "title": F.coalesce(F.nullif("title", F.lit("")), generated_title(F.col("__q"))).alias("title"),
        "updated_at": F.coalesce("__at", "updated_at").alias("updated_at"),
    }
    touched = sessions.join(first, "session_id", "left")
    return user.unionByName(assistant), traces, touched.select(
        *[changes.get(c, F.col(c)) for c in sessions.columns]
    )


def question_for_answer(messages: DataFrame) -> DataFrame:
    """As-of join: each assistant message with the latest user message at or before it in its session."""
    # a user message at the same time as the answer still counts, so user rows sort first
    ranked = messages.withColumn("__asks", F.when(F.col("role") == "user", 0).otherwise(1))
    asked = F.when(
        F.col("role") == "user",
        F.struct(F.col("message_id").alias("id"), F.col("content").alias("text"), F.col("created_at").alias("at")),
    )
    found = ordered.running_last(ranked, ["session_id"], ["created_at", "__asks", "message_id"], asked, "q")
    return found.filter(F.col("role") == "assistant").drop("__asks")


# --- feedback ------------------------------------------------------------------------


def valid_feedback(feedback: DataFrame, messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Feedback on assistant messages of the user's own live sessions."""
    live = sessions.filter(F.col("deleted_at").isNull()).select("session_id", "user_id")
    targets = messages.filter(F.col("role") == "assistant").select("message_id", "session_id").join(live, "session_id")
    return feedback.join(targets.select("message_id", "user_id"), ["message_id", "user_id"], "left_semi")


def upsert_feedback(existing: DataFrame, submitted: DataFrame, order: list[str]) -> DataFrame:
    """One row per (message, user): the last submission wins over the stored row."""
    keys = ["message_id", "user_id"]
    others = [c for c in submitted.columns if c not in keys]
    newest = submitted.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("f"))
    newest = newest.select(*keys, "f.*")
    kept = existing.join(newest.select(*keys), keys, "left_anti")
    return kept.unionByName(newest, allowMissingColumns=True)


def filter_feedback(
    feedback: DataFrame, rating=None, reason=None, admin_status=None, date_from=None, date_to=None
) -> DataFrame:
    found = feedback
    for column, value in (("rating", rating), ("reason", reason), ("admin_status", admin_status)):
        if value is not None and value != "":
            found = found.filter(F.col(column) == value)
    if date_from is not None:
        found = found.filter(F.col("created_at") >= date_from)
    if date_to is not None:
        found = found.filter(F.col("created_at") <= date_to)
    return found


def review_feedback(feedback: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews (feedback_id, admin_status, admin_note, reviewer, at): given fields, reviewer and time."""
    r = reviews.select(
        "feedback_id",
        F.col("admin_status").alias("__status"),
        F.col("admin_note").alias("__note"),
        F.col("reviewer").alias("__by"),
        F.col("at").alias("__at"),
    )
    changes = {
        "admin_status": F.coalesce("__status", "admin_status"),
        "admin_note": F.coalesce("__note", "admin_note"),
        "reviewed_by": F.coalesce("__by", "reviewed_by"),
        "reviewed_at": F.coalesce("__at", "reviewed_at"),
    }
    joined = feedback.join(r, "feedback_id", "left")
    return joined.select(*[changes.get(c, F.col(c)).alias(c) for c in feedback.columns])


def feedback_violations(feedback: DataFrame, messages: DataFrame) -> DataFrame:
    """(check_name, row_key) of rows outside the allowed values, and of repeated (message, user) pairs."""
    checks = {
        "rating": ~F.col("rating").between(1, 5),
        "reason": F.col("reason").isNotNull() & ~F.col("reason").isin(*REASONS),
        "admin_status": ~F.col("admin_status").isin(*ADMIN_STATUSES),
    }
    failed = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in checks.items()]))
    rows = feedback.select(F.explode(failed).alias("check_name"), F.col("feedback_id").cast("string").alias("row_key"))
    role = messages.filter(~F.col("role").isin(*ROLES)).select(
        F.lit("role").alias("check_name"), F.col("message_id").cast("string").alias("row_key")
    )
    repeated = (
        feedback.filter(F.col("user_id").isNotNull())
        .groupBy("message_id", "user_id")
        .count()
        .filter("count > 1")
        .select(
            F.lit("unique_message_user").alias("check_name"),
            F.concat_ws(":", F.col("message_id").cast("string"), F.col("user_id").cast("string")).alias("row_key"),
        )
    )
    return rows.unionByName(role).unionByName(repeated)


# --- dashboard -----------------------------------------------------------------------


def dashboard_totals(sessions: DataFrame, messages: DataFrame, feedback: DataFrame, traces: DataFrame) -> DataFrame:
    """One row of counts and means; deleted sessions count too. Each table is reduced to one row, tagged, and
    the four rows are folded into one."""

    def row(df: DataFrame, **aggregates: Column) -> DataFrame:
        wanted = ("total_sessions", "total_messages", "total_feedbacks", "average_rating", "average_latency_ms")
        types = ("bigint", "bigint", "bigint", "double", "double")
        return df.agg(
            *[aggregates.get(n, F.max(F.lit(None).cast(t))).cast(t).alias(n) for n, t in zip(wanted, types)]
        )

    parts = (
        row(sessions, total_sessions=F.count("*"))
        .unionByName(row(messages, total_messages=F.count("*")))
        .unionByName(row(feedback, total_feedbacks=F.count("*"), average_rating=F.avg("rating")))
        .unionByName(row(traces, average_latency_ms=F.avg("latency_ms")))
    )
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])


def rating_distribution(feedback: DataFrame) -> DataFrame:
    """Counts for ratings 1..5, zero where there are none."""
    counted = feedback.groupBy("rating").agg(F.count("*").alias("n"))
    scale = feedback.sparkSession.range(1, 6).select(F.col("id").alias("rating"))
    return scale.join(counted, "rating", "left").select("rating", F.coalesce("n", F.lit(0)).alias("n"))


def low_rating_reasons(feedback: DataFrame) -> DataFrame:
    low = feedback.filter((F.col("rating") <= LOW_RATING) & F.col("reason").isNotNull())
    return low.groupBy("reason").agg(F.count("*").alias("n"))


def route_distribution(traces: DataFrame) -> DataFrame:
    return traces.filter(F.col("route").isNotNull()).groupBy("route").agg(F.count("*").alias("n"))


def recent(rows: DataFrame, time: str, key: str, limit: int = 5) -> DataFrame:
    return rows.orderBy(F.col(time).desc(), F.col(key)).limit(limit)
