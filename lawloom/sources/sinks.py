"""Keyed tables on Parquet and file exports.

A write never changes files in place: it merges into a new snapshot directory
and returns its path. A failed or repeated write leaves the old snapshot whole.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructField, StructType

VECTOR_SIZE = 1024


def with_vector_size(points: DataFrame, size: int = VECTOR_SIZE, column: str = "embedding") -> DataFrame:
    """The same rows; a vector of another size fails the job."""
    message = F.concat(F.lit(f"vector size must be {size}, got "), F.size(column).cast("string"))
    checked = F.when(F.size(column) == size, F.col(column)).otherwise(F.raise_error(message).cast("array<float>"))
    return points.withColumn(column, checked)


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``incoming`` replace rows with the same key."""
    return existing.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def delete_keys(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    return rows.join(keys.select(column).distinct(), column, "left_anti")


def deletion_report(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Row counts per key before and after a delete."""
    count = lambda df, side: df.groupBy(column).agg(F.count("*").alias(side))
    joined = count(before, "before").join(count(after, "after"), column, "left")
    return joined.withColumn("after", F.coalesce("after", F.lit(0))).withColumn(
        "deleted", F.col("before") - F.col("after")
    )


def belongs_to_version(version: Column, *columns: Column) -> Column:
    """True when any of the columns names the version; NULL columns do not."""
    out = F.lit(False)
    for c in columns:
        out = out | c.eqNullSafe(version)
    return out


def chunk_rows(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, repeated (version_id, chunk_index) keys)."""
    repeated = chunks.groupBy("version_id", "chunk_index").count().filter("count > 1")
    return chunks, repeated


def set_embedding_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids``: chunk_id, new_embedding_id."""
    joined = chunks.join(ids, "chunk_id", "left")
    return joined.withColumn("embedding_id", F.coalesce("new_embedding_id", "embedding_id")).drop("new_embedding_id")


def cascade_delete(documents: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Remaining rows of each table after its documents are deleted."""
    return {name: delete_keys(df, documents, "document_id") for name, df in tables.items()}


def orphan_artifacts(versions: DataFrame, documents: DataFrame) -> DataFrame:
    """Files of the deleted documents' versions."""
    gone = versions.join(documents.select("document_id").distinct(), "document_id", "left_semi")
    paths = F.array("source_file_path", "raw_text_path", "cleaned_text_path", "layout_json_path")
    kept = F.filter(paths, lambda p: p.isNotNull() & (p != ""))
    return gone.select("document_id", F.explode(kept).alias("path"))


# --- snapshots -----------------------------------------------------------------------


def create_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``; an empty one is written when there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        spark.createDataFrame([], schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def write_snapshot(rows: DataFrame, path: str, partition_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = ()) -> str:
    """Write a table version. Sorting inside files lets readers skip row groups on the hot filter columns."""
    out = rows.sortWithinPartitions(*sort_by) if sort_by else rows
    out.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return path


def upsert_snapshot(spark: SparkSession, old: str, incoming: DataFrame, new: str, key: str = "id") -> str:
    existing = spark.read.schema(incoming.schema).parquet(old)
    return write_snapshot(upsert(existing, incoming, key), new)


# --- artifacts -----------------------------------------------------------------------


def artifact_key(document_id: Column, kind: Column, at: Column, name: Column, suffix: str = "txt") -> Column:
    """documents/text/{yyyy}/{mm}/{document}/{kind}/{name}.{suffix}"""
    year, month = F.year(at).cast("string"), F.date_format(at, "MM")
    return F.concat_ws("/", F.lit("documents/text"), year, month, document_id, kind, F.concat(name, F.lit(f".{suffix}")))


def write_artifacts(artifacts: DataFrame, path: str) -> None:
    """Texts (kind, document_id, at, content) partitioned by kind, year and month."""
    dated = artifacts.withColumn("year", F.year("at")).withColumn("month", F.date_format("at", "MM"))
    dated.write.mode("append").partitionBy("kind", "year", "month").parquet(path)


def chunk_block() -> Column:
    """One chunk as a labelled text block."""
    shown = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.concat_ws(
        "\n",
        F.concat(
            F.lit("=== Chunk "), (F.col("chunk_index") + 1).cast("string"), F.lit("/"),
            F.col("total_chunks").cast("string"), F.lit(" ==="),
        ),
        F.concat(F.lit("chunk_id: "), "chunk_id"),
        F.concat(F.lit("document_id: "), F.col("document_id").cast("string")),
        F.concat(F.lit("chunk_type: "), "chunk_type"),
        F.concat(F.lit("title: "), shown("title")),
        F.concat(F.lit("section_path: "), shown("section_path")),
        F.concat(F.lit("metadata: "), F.to_json("metadata")),
        F.lit("content:"),
        F.col("chunk_text"),
    )


def _as_json(kind: DataType) -> DataType:
    """The type that JSON gives back: the keys of maps are strings."""
    if isinstance(kind, MapType):
        return MapType(StringType(), _as_json(kind.valueType))
    if isinstance(kind, ArrayType):
        return ArrayType(_as_json(kind.elementType))
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, _as_json(f.dataType)) for f in kind])
    return kind


def write_chunk_artifacts(chunks: DataFrame, path: str, buckets: int = 64) -> None:
    """Chunks as JSON rows and as text blocks, gzipped, in directories by a hash of the document; a document's blocks are
    in order in one file, and every block and row names its document.

    The chunks are worked out and shuffled once: the text blocks are made from the JSON rows. A bucket is one compressed
    file, which one task reads."""
    order = ["bucket", "document_id", "chunk_index"]
    bucket = F.pmod(F.xxhash64("document_id"), F.lit(buckets)).alias("bucket")
    rows = chunks.select("*", bucket).repartition("bucket").sortWithinPartitions(*order)
    once = {"compression": "gzip", "maxRecordsPerFile": 0}
    rows.write.options(**once).partitionBy("bucket").json(f"{path}/json")
    written = chunks.sparkSession.read.schema(_as_json(rows.schema)).json(f"{path}/json")
    text = written.select(*order, F.concat(chunk_block(), F.lit("\n")).alias("value")).sortWithinPartitions(*order)
    text.select("value", "bucket").write.options(**once).partitionBy("bucket").text(f"{path}/text")


EVALUATION_COLUMNS = (
    "test_id", "question", "expected_chunk_id", "expected_document_id", "expected_chunk_title", "rank",
    "hit_at_1", "hit_at_3", "hit_at_5", "reciprocal_rank", "context_recall", "retrieved_chunk_ids",
    "retrieved_titles", "retrieved_scores", "rerank_model", "retrieved_count", "candidate_count",
)


def write_evaluation(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """Detail CSV with a fixed column order and a one-row JSON summary."""
    rows.select(*EVALUATION_COLUMNS).write.option("header", True).option("escape", '"').csv(f"{path}/results")
    summary.write.json(f"{path}/summary")
