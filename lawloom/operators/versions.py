"""Versions, uploads and ingest jobs as keyed merges and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lawloom.functions.text import clean
from lawloom.operators import ordered

# The job states `pending`, `processing`, `completed` and `failed` below, and the sentences of upload checks.
MAX_RETRIES = 3
MAX_UPLOAD_BYTES = 20 * 1024 * 1024
# Accepted upload types.
ALLOWED_TYPES = (
    "application/pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "text/plain",
)


# --- version chain --------------------------------------------------------------


def link_versions(uploads: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Next version numbers for a batch of uploads (document_id, version_id, upload_no).

    Numbers continue after the latest existing version; each version names the one before it.
    """
    batch = ordered.scan(uploads, ["document_id"], ["upload_no"], number="rn", before={"in_batch": F.col("version_id")})
    if existing is None:
        latest = None
        base, before = F.lit(0).cast("bigint"), F.lit(None).cast("string")
    else:
        latest = latest_versions(existing).select(
            "document_id", F.col("version_no").alias("base"), F.col("version_id").alias("before")
        )
        base, before = F.coalesce("base", F.lit(0)), F.col("before")
    linked = batch if latest is None else batch.join(latest, "document_id", "left")
    return linked.select(
        "document_id",
        "version_id",
        (base + F.col("rn")).cast("bigint").alias("version_no"),
        F.coalesce(F.col("in_batch").cast("string"), before.cast("string")).alias("previous_version_id"),
        *[c for c in uploads.columns if c not in ("document_id", "version_id", "upload_no")],
    )


def latest_versions(versions: DataFrame) -> DataFrame:
    """The row with the highest version_no per document. An aggregate, so a hot document combines map-side."""
    others = [c for c in versions.columns if c not in ("document_id", "version_no")]
    newest = F.max_by(F.struct("version_no", *others), F.struct("version_no", "version_id"))
    return versions.groupBy("document_id").agg(newest.alias("v")).select("document_id", "v.*")


def with_is_current(versions: DataFrame) -> DataFrame:
    """is_current derived at read time instead of a stored flag."""
    latest = versions.groupBy("document_id").agg(F.max("version_no").alias("latest_no"))
    return versions.join(latest, "document_id").withColumn("is_current", F.col("version_no") == F.col("latest_no"))


def annotate_previous(chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """Link each chunk to its counterpart in the previous version of the document, by article number.

    ``chunks``: chunk_id, version_id, chunk_index, chunk_text, article_number, target_article_number,
    is_amendment. Of several previous chunks with one article the last wins.
    """
    article = F.coalesce("article_number", "target_article_number")
    chain = versions.select(
        F.col("version_id"), F.col("previous_version_id"), (F.col("version_no") - 1).alias("previous_version_number")
    )
    current = chunks.withColumn("article", article).join(chain, "version_id", "left")
    chosen = F.max_by(F.struct("chunk_id", F.left("chunk_text", F.lit(120)).alias("title")), "chunk_index")
    known = (
        chunks.withColumn("article", article)
        .filter(F.col("article").isNotNull())
        .groupBy(F.col("version_id").alias("previous_version_id"), "article")
        .agg(chosen.alias("p"))
    )
    linked = current.join(known, ["previous_version_id", "article"], "left")
    relates = F.col("previous_version_id").isNotNull() & F.col("article").isNotNull()
    relation = F.when(
        relates,
        F.when(F.col("p").isNull(), "new_article").when(F.col("is_amendment"), "amends_article").otherwise(
            "matched_article"
        ),
    )
    return (
        linked.withColumn("relation_to_previous_version", relation)
        .withColumn("previous_chunk_id", F.col("p.chunk_id"))
        .withColumn("previous_chunk_title", F.col("p.title"))
        .withColumn("previous_article_number", F.when(F.col("p").isNotNull(), F.col("article")))
        .drop("p", "article")
    )


# --- identity and uploads ----------------------------------------------------------


def with_checksums(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("source_checksum", F.sha2(F.col(text), 256)).withColumn(
        "checksum", F.sha2(clean(F.col(text)), 256)
    )


def known_by_checksum(uploads: DataFrame, existing: DataFrame) -> DataFrame:
    """Uploads whose content already exists, with the first document that holds it.

    The existing side is reduced to one row per checksum before the join, so a popular text stays one row.
    """
    first = existing.groupBy("checksum").agg(F.min("document_id").alias("existing_document_id"))
    return uploads.join(first, "checksum")


def upload_rejection(mime: Column, name: Column, size: Column) -> Column:
    """Why an upload is refused; NULL when it is accepted."""
    return (
        F.when(~F.coalesce(mime.isin(*ALLOWED_TYPES), F.lit(False)), "Unsupported file type")
        .when(F.coalesce(name, F.lit("")) == "", "Filename is required")
        .when(F.coalesce(size, F.lit(0)) == 0, "File is empty")
        .when(size > MAX_UPLOAD_BYTES, "File size exceeds limit")
    )


def merge_fields(table: DataFrame, updates: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Set the given fields where the update has a value; other rows and fields stay."""
    renamed = updates.select(key, *[F.col(f).alias(f"__new_{f}") for f in fields])
    merged = table.join(renamed, key, "left")
    columns = [
        F.coalesce(f"__new_{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns
    ]
    return merged.select(*columns)


# --- jobs ---------------------------------------------------------------------------


def pending_jobs(
    jobs: DataFrame, document_id=None, version_id=None, limit: int | None = 10, order: tuple[str, ...] = ("job_id",)
) -> DataFrame:
    found = jobs.filter((F.col("status") == "pending") & (F.col("job_type") == "ingest"))
    if document_id is not None:
        found = found.filter(F.col("document_id") == document_id)
    if version_id is not None:
        found = found.filter(F.col("version_id") == version_id)
    found = found.orderBy(*order)
    return found if limit is None else found.limit(limit)


def apply_job_status(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Status changes (job_id, new_status, at, error): first running sets started_at, a terminal one finished_at."""
    new = F.col("new_status")
    joined = jobs.join(changes, "job_id", "left")
    updated = {
        "status": F.coalesce(new, F.col("status")),
        "started_at": F.coalesce("started_at", F.when(new == "running", F.col("at"))),
        "finished_at": F.when(new.isin("completed", "failed"), F.col("at")).otherwise(F.col("finished_at")),
        "error_message": F.coalesce(F.nullif("error", F.lit("")), "error_message"),
    }
    return joined.select(*[updated.get(c, F.col(c)).alias(c) for c in jobs.columns])


def retry_decision(jobs: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Outcome of one attempt per job (``failed`` flag, ``error``): pending again, failed or completed."""
    failed, count = F.col("failed"), F.col("retry_count")
    exhausted = count >= max_retries
    again = ~exhausted & failed & (count + 1 < max_retries)
    gave_up = ~exhausted & failed & (count + 1 >= max_retries)
    return (
        jobs.withColumn(
            "next_status", F.when(exhausted | gave_up, "failed").when(again, "pending").otherwise("completed")
        )
        .withColumn("next_retry_count", F.when(~exhausted & failed, count + 1).otherwise(count).cast("bigint"))
        .withColumn(
            "next_error",
            F.when(exhausted, F.lit(f"Exceeded max retries: {max_retries}")).when(
                gave_up, F.concat(F.lit("Ingest failed: "), F.coalesce("error", F.lit("")))
            ),
        )
    )


def manual_retry(jobs: DataFrame) -> DataFrame:
    """Reset every job except running ones to a fresh pending state."""
    idle = F.col("status") != "running"
    fresh = {
        "status": F.lit("pending"),
        "error_message": F.lit(None).cast("string"),
        "started_at": F.lit(None).cast("timestamp_ntz"),
        "finished_at": F.lit(None).cast("timestamp_ntz"),
        "retry_count": F.lit(0),
    }
    columns = [F.when(idle, fresh[c]).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in jobs.columns]
    return jobs.select(*columns)


# --- lists ----------------------------------------------------------------------------


def document_list(documents: DataFrame, versions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with their latest file, versions_count and chunks_count."""
    latest = latest_versions(versions).select("document_id", F.col("source_file_path").alias("file_path"))
    v = versions.groupBy("document_id").agg(F.count("*").alias("versions_count"))
    c = chunks.groupBy("document_id").agg(F.count("*").alias("chunks_count"))
    listed = documents.join(latest, "document_id", "left").join(v, "document_id", "left").join(c, "document_id", "left")
    return listed.withColumns(
        {
            "source_path": F.coalesce("file_path", "title"),
            "versions_count": F.coalesce("versions_count", F.lit(0)),
            "chunks_count": F.coalesce("chunks_count", F.lit(0)),
        }
    )


def version_list(versions: DataFrame, chunks: DataFrame) -> DataFrame:
    c = chunks.groupBy("version_id").agg(F.count("*").alias("chunks_count"))
    return versions.join(c, "version_id", "left").withColumn("chunks_count", F.coalesce("chunks_count", F.lit(0)))


def page_of(rows: DataFrame, order: list[Column], page: int, page_size: int) -> DataFrame:
    """One page of a list. Order by a unique key last; the plan keeps only offset + limit rows per task."""
    return rows.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def page_count(rows: DataFrame, page_size: int) -> DataFrame:
    total = F.count("*")
    pages = F.when(F.lit(page_size) > 0, F.ceil(total / F.lit(max(page_size, 1)))).otherwise(F.lit(0))
    return rows.agg(total.alias("total"), pages.cast("bigint").alias("total_pages"))


def ingest_context(versions: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(context rows, error rows): versions with their document; missing documents or files are errors."""
    d = documents.select(
        "document_id", F.col("title"), F.coalesce("source_type", F.lit("upload")).alias("source_type"),
        F.lit(True).alias("has_document"),
    )
    joined = versions.join(d, "document_id", "left")
    error = F.when(F.col("has_document").isNull(), "Document not found").when(
        F.coalesce("source_file_path", F.lit("")) == "", "File path is missing"
    )
    checked = joined.withColumn("error", error).drop("has_document")
    return checked.filter("error IS NULL").drop("error"), checked.filter("error IS NOT NULL").select(
        "version_id", "document_id", "error"
    )


def chunks_of_versions(chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """The chunks of each of the versions (version_id) with their place, from 1, in it."""
    w = Window.partitionBy("version_id").orderBy("chunk_index")
    found = chunks.join(versions.select("version_id").distinct(), "version_id", "left_semi")
    return found.withColumn("place", F.row_number().over(w).cast("bigint"))
