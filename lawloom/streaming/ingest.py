"""Continuous ingest: document versions are cleaned, chunked and embedded as they arrive, and replaced when they change."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.functions.text import blank_to_null
from lawloom.plans.ingest import CARRY, ingest_chunks, to_points

VERSIONS = "version_id string, checksum string, error string, batch int"


def _versions(spark: SparkSession, folder: str) -> DataFrame:
    """The newest stored state of every version."""
    try:
        return spark.read.schema(VERSIONS).parquet(f"{folder}/versions")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], VERSIONS)


def _newest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("version_id").agg(F.max_by(F.struct("checksum", "error", "batch"), "batch").alias("r")).select("version_id", "r.*")


def ingest_stream(documents: DataFrame, folder: str, checkpoint: str, dim: int = 64, order: str | None = None) -> None:
    """Ingest a stream of (doc_id, text, carried fields) until no more input is there.

    Of several texts of one version in a micro-batch the last by the column `order` counts (a version number or an arrival
    time), of those the one with the largest checksum; without `order` the checksum alone decides.

    A version is ingested when it is new or its text has changed; the stored checksums tell, so no state grows in the
    stream, and a stopped stream goes on where it was. Every micro-batch writes its own directories, so a repeated one
    replaces its output. Versions without text are stored with an error and do not stop the stream.
    """
    spark = documents.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        checksum = F.sha2(F.coalesce("text", F.lit("")), 256)
        row = F.struct("doc_id", "text", *[c for c in CARRY if c != "version_id"], "checksum")
        last = F.struct(*([F.col("__order")] if order else []), F.col("checksum"))
        one = batch.withColumn("checksum", checksum).groupBy("version_id").agg(F.max_by(row, last).alias("r")).select("version_id", "r.*")
        known = _newest(_versions(spark, folder).filter(F.col("batch") < batch_id)).select("version_id", "checksum")
        fresh = one.join(known, ["version_id", "checksum"], "left_anti")
        error = F.when(blank_to_null(F.col("text")).isNull(), F.lit("No text"))
        fresh.select("version_id", "checksum", error.alias("error")).write.mode("overwrite").parquet(f"{folder}/versions/batch={batch_id}")
        found = to_points(ingest_chunks(fresh.filter(error.isNull()).drop("checksum")), dim)
        found.sortWithinPartitions("chunk_kind", "article_number").write.mode("overwrite").parquet(f"{folder}/points/batch={batch_id}")

    job = (
        documents.select("doc_id", "text", *CARRY, *([F.col(order).alias("__order")] if order else []))
        .writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    job.awaitTermination()


def current_points(spark: SparkSession, folder: str) -> DataFrame:
    """The points of every version as it was ingested last."""
    newest = _newest(_versions(spark, folder)).filter("error IS NULL").select("version_id", "batch")
    return spark.read.parquet(f"{folder}/points").join(newest, ["version_id", "batch"], "left_semi").drop("batch")


def ingest_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Versions that could not be ingested when they arrived last."""
    return _newest(_versions(spark, folder)).filter("error IS NOT NULL").select("version_id", "error")
