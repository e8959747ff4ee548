"""Job feeds as Structured Streaming: changes per job, retries per attempt."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.operators import ordered
from lawloom.operators.versions import MAX_RETRIES

TERMINAL = ("completed", "failed")
CHANGES = "document_id bigint, job_id bigint, event_id bigint, status string, retry_count int, previous_status string"


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table as a stream of its files, whether the table is one file or a folder of them."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder}/{name}*.parquet")


def job_changes(jobs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Batch form: the rows of each job whose status or retry count differs from the row before."""
    now = F.struct("status", "retry_count")
    marked = ordered.previous(jobs, ["document_id", "job_id"], ["ts", "event_id"], now, "before")
    changed = F.col("before").isNull() | (F.col("before") != now)
    return marked.filter(changed).select(
        "document_id", "job_id", "event_id", "status", "retry_count", F.col("before.status").alias("previous_status"), *keep
    )


@dataclass(frozen=True)
class ChangeStream:
    """A stream of job events of which the changes are wanted; `run_to_table` runs it."""

    jobs: DataFrame


def job_change_stream(jobs: DataFrame) -> ChangeStream:
    """Stream form. State is one small row per job, so a busy document spreads over its jobs. Events are put in order
    within a micro-batch; one that arrives in a later batch counts when it arrives."""
    return ChangeStream(jobs)


LAST = "document_id bigint, job_id bigint, last struct<status:string,retry_count:int>"


def _changes_to_table(jobs: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Every micro-batch writes its changes, and the newest state of the jobs that it touches, as batches of their own. It
    reads the states of the batches before it, so a repeated one gives the same rows."""
    spark, states = jobs.sparkSession, f"{checkpoint}/newest"
    keys, now = ["document_id", "job_id"], F.struct("status", "retry_count")

    def step(batch: DataFrame, batch_id: int) -> None:
        # events without a time come last
        rows = batch.select(*keys, "event_id", "status", "retry_count", "ts", F.col("ts").isNull().alias("__late"))
        order = ["__late", "ts", "event_id"]
        marked = ordered.previous(rows, keys, order, now, "before")
        if _has_table(spark, states):
            known = _newest(spark, states, LAST, keys, batch_id).select(*[F.col(k).alias(f"__{k}") for k in keys], "last")
            same = F.lit(True)
            for k in keys:
                same = same & marked[k].eqNullSafe(known[f"__{k}"])
            marked = marked.join(known, same, "left").withColumn("before", F.coalesce("before", "last"))
        changed = marked.filter(F.col("before").isNull() | (F.col("before") != now))
        out = changed.select(*keys, "event_id", "status", "retry_count", F.col("before.status").alias("previous_status"))
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        newest = rows.groupBy(*keys).agg(F.max_by(now, F.struct(*order)).alias("last"))
        newest.write.mode("overwrite").parquet(f"{states}/batch={batch_id}")

    _run(jobs, step, checkpoint)
    return spark.read.schema(f"{CHANGES}, batch int").parquet(path).drop("batch")


def document_snapshots(changes: DataFrame) -> DataFrame:
    """Per document: jobs, open jobs, and whether all jobs have ended. A job's newest event is the last by (ts, event_id)."""
    newest = changes.groupBy("document_id", "job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))
    is_open = F.count(F.when(~F.col("status").isin(*TERMINAL), True))
    return newest.groupBy("document_id").agg(F.count("*").alias("jobs"), is_open.alias("open_jobs")).withColumn(
        "terminal", F.col("open_jobs") == 0
    )


def run_to_table(stream: DataFrame | ChangeStream, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over all data that is there, append to Parquet, and read the result."""
    if isinstance(stream, ChangeStream):
        return _changes_to_table(stream.jobs, path, checkpoint)
    job = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    job.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


# --- retries -------------------------------------------------------------------------


def apply_attempts(jobs: DataFrame, attempts: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Jobs (job_id, status, retry_count) after attempts (job_id, at, failed), which count in order of ``at``.

    Failures before the first success add up; at the limit the job has failed. Ended jobs ignore attempts.
    """
    success = attempts.groupBy("job_id").agg(F.min(F.when(~F.col("failed"), F.col("at"))).alias("done_at"))
    before = (
        attempts.join(success, "job_id")
        .filter(F.col("failed") & (F.col("done_at").isNull() | (F.col("at") < F.col("done_at"))))
        .groupBy("job_id")
        .agg(F.count("*").alias("failures"))
    )
    outcome = success.join(before, "job_id", "left")
    joined = jobs.join(outcome, "job_id", "left")
    total = F.least(F.col("retry_count") + F.coalesce("failures", F.lit(0)), F.lit(max_retries)).cast("int")
    ended = F.col("status").isin(*TERMINAL)
    status = (
        F.when(ended, F.col("status"))
        .when(total >= max_retries, "failed")
        .when(F.col("done_at").isNotNull(), "completed")
        .otherwise("pending")
    )
    return joined.select("job_id", status.alias("status"), F.when(ended, F.col("retry_count")).otherwise(total).alias("retry_count"))


JOB_STATE = "job_id bigint, status string, retry_count int"


def _newest(spark: SparkSession, table: str, schema: str, keys: list[str], before: int | None = None) -> DataFrame:
    """The newest row of each key over the batches of a table (those before a batch)."""
    rows = spark.read.schema(f"{schema}, batch int").parquet(table)
    rows = rows if before is None else rows.filter(F.col("batch") < before)
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r")).select(*keys, "r.*")


def _has_table(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False
    return True


def _run(stream: DataFrame, step, checkpoint: str) -> None:
    job = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    job.awaitTermination()


def retry_stream(jobs: DataFrame, attempts: DataFrame, table: str, checkpoint: str) -> DataFrame:
    """Apply a stream of attempts to the job table, and return its state.

    The first run stores the jobs as batch -1. A micro-batch writes the jobs that it touches as a batch of their own, from
    the batches before it, so a repeated one gives the same rows; a later run goes on with the stored table. Pending jobs
    are what the next trigger picks up."""
    spark = jobs.sparkSession
    if not _has_table(spark, f"{table}/batch=-1"):
        jobs.select("job_id", "status", F.col("retry_count").cast("int")).write.parquet(f"{table}/batch=-1")

    def step(batch: DataFrame, batch_id: int) -> None:
        known = _newest(spark, table, JOB_STATE, ["job_id"], batch_id)
        touched = known.join(batch.select("job_id").distinct(), "job_id", "left_semi")
        apply_attempts(touched, batch).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    _run(attempts, step, checkpoint)
    return _newest(spark, table, JOB_STATE, ["job_id"])


NEWEST = "document_id bigint, job_id bigint, status string, ts timestamp, event_id bigint"


def snapshot_stream(events: DataFrame, table: str, snapshots: str, checkpoint: str) -> DataFrame:
    """Document snapshots as events arrive: every micro-batch stores the newest event of the jobs that it touches, and
    writes a snapshot of the documents that it touches. Returns the newest snapshot of every document."""
    spark = events.sparkSession
    at = F.struct("ts", "event_id")

    def newest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("document_id", "job_id").agg(F.max_by(F.struct("status", "ts", "event_id"), at).alias("r")).select(
            "document_id", "job_id", "r.*"
        )

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("document_id", "job_id", "status", "ts", "event_id")
        if _has_table(spark, table):
            stored = spark.read.schema(f"{NEWEST}, batch int").parquet(table).filter(F.col("batch") < batch_id).drop("batch")
            rows = rows.unionByName(stored.join(batch.select("document_id").distinct(), "document_id", "left_semi"))
        newest(rows).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
        written = spark.read.schema(NEWEST).parquet(f"{table}/batch={batch_id}")
        document_snapshots(written).write.mode("overwrite").parquet(f"{snapshots}/batch={batch_id}")

    _run(events, step, checkpoint)
    return _newest(spark, snapshots, "document_id bigint, jobs bigint, open_jobs bigint, terminal boolean", ["document_id"])
