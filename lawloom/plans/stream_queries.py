"""Registered queries: streams, run over all input that is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from lawloom import session
from lawloom.plans import inputs as I
from lawloom.plans.registry import query
from lawloom.streaming import ingest, jobs


def _job_columns(events):
    status = (
        "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' "
        "ELSE 'completed' END"
    )
    return events.select(
        (F.col("user_id") * 10 + F.col("event_id") % 10).alias("job_id"), F.col("user_id").alias("document_id"),
        "event_id", F.expr(status).alias("status"), (F.col("event_id") % 4).cast("int").alias("retry_count"), "ts",
    )


@query
def stm_1_ingest_stream(spark, sf_dir):
    d = I.legal_lines(jobs.stream_table(spark, sf_dir, "documents"))
    version = F.col("doc_id").cast("string")
    d = d.select("doc_id", "text", F.concat(F.lit("Document "), version).alias("title"), version.alias("version_id"))
    folder = session.scratch_path(spark, "ingest")
    ingest.ingest_stream(d, folder, session.scratch_path(spark, "progress"))
    return ingest.current_points(spark, folder).select("document_id", "chunk_index", "total_chunks", "chunk_kind")


@query
def stm_2_job_feed(spark, sf_dir):
    return jobs.job_changes(I.jobs(spark, sf_dir))


@query
def stm_2_job_stream(spark, sf_dir):
    stream = jobs.job_change_stream(_job_columns(jobs.stream_table(spark, sf_dir, "events")))
    return jobs.run_to_table(stream, session.scratch_path(spark, "changes"), session.scratch_path(spark, "progress"))


@query
def stm_2_document_snapshots(spark, sf_dir):
    return jobs.document_snapshots(jobs.job_changes(I.jobs(spark, sf_dir), keep=("ts",)))


@query
def stm_2_snapshot_stream(spark, sf_dir):
    events = _job_columns(jobs.stream_table(spark, sf_dir, "events"))
    paths = [session.scratch_path(spark, name) for name in ("jobs", "snapshots", "progress")]
    return jobs.snapshot_stream(events, *paths)


@query
def stm_3_retry_stream(spark, sf_dir):
    events = _job_columns(jobs.stream_table(spark, sf_dir, "events"))
    attempts = events.filter(F.col("status").isin(*jobs.TERMINAL)).select(
        "job_id", F.struct("ts", "event_id").alias("at"), (F.col("status") == "failed").alias("failed")
    )
    known = I.jobs(spark, sf_dir).select("job_id").distinct()
    table = known.select("job_id", F.lit("pending").alias("status"), F.lit(0).alias("retry_count"))
    return jobs.retry_stream(table, attempts, session.scratch_path(spark, "jobs"), session.scratch_path(spark, "progress"))
