"""Registered queries: sources, sinks, versions and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lawloom import session
from lawloom.functions.text import clean
from lawloom.operators import layout as Y
from lawloom.operators import versions as V
from lawloom.plans import inputs as I
from lawloom.plans.registry import query
from lawloom.plans.text_queries import chunk_table
from lawloom.sources import files, sinks


# --- sources ---------------------------------------------------------------------------


@query
def src_1_text_files(spark, sf_dir):
    """Benchmark passages written as one text file each and read back whole."""
    path = session.scratch_path(spark, "texts")
    b = I.table(spark, sf_dir, "benchmark")
    files.write_text_files(b.select(F.concat(F.col("item_id").cast("string"), F.lit(".txt")).alias("name"), "text"), path)
    found = files.read_text_documents(spark, path)
    item = F.col("doc_id").cast("bigint")
    return found.select(item.alias("item_id"), "source_type", "raw_text", F.col("char_count").cast("bigint").alias("char_count"))


@query
def src_2_corpus_scan(spark, sf_dir):
    """All documents as files of a corpus directory, every fourth with a suffix that is not read: facts and texts."""
    path = session.scratch_path(spark, "corpus")
    d = I.table(spark, sf_dir, "documents").filter("text <> ''")
    suffix = F.expr("CASE doc_id % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' WHEN 2 THEN 'RST' ELSE 'dat' END")
    files.write_text_files(d.select(F.concat_ws(".", F.col("doc_id").cast("string"), suffix).alias("name"), "text"), path)
    texts = files.read_corpus_texts(spark, path).hint("merge")  # never broadcast: Spark can't know how much the tasks read
    return files.scan_corpus(spark, path).join(texts, "source_path", "left").select("file_name", "suffix", "bytes", "supported", "raw_text")


@query
def src_3_ocr_pages(spark, sf_dir):
    """Documents as OCR results: one JSON line per text line, then pages joined again."""
    d = I.table(spark, sf_dir, "documents")
    page = lambda x: F.struct(F.struct(x.alias("text")).alias("markdown"))
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    body = F.struct(F.struct(F.array(page(F.col("line"))).alias("layoutParsingResults")).alias("result"))
    rows = lines.select("doc_id", "line_no", F.to_json(body).alias("json"))
    out = Y.pages_to_documents(Y.ocr_pages(rows))
    return out.select("doc_id", "raw_text", "page_count", F.size("ocr_pages").alias("text_pages"))


def layout_documents(spark, sf_dir):
    """Documents as layout JSON: ten lines a page, one block a line, its two halves as spans."""
    cut = F.expr("CAST(length(line) div 2 AS INT)")
    y = (F.col("line_no") % 10 * 10).cast("double")
    span = lambda text, x0, x1: F.struct(
        F.lit("text").alias("type"), text.alias("content"), F.array(F.lit(x0), y, F.lit(x1), y + 9).alias("bbox")
    )
    halves = F.array(span(F.left("line", cut), 0.0, 250.0), span(F.expr("substring(line, length(line) div 2 + 1)"), 250.0, 500.0))
    return I.layout_json(I.plain_lines(I.table(spark, sf_dir, "documents")), halves)


@query
def src_4_layout_entries(spark, sf_dir):
    e = Y.layout_entries(layout_documents(spark, sf_dir))
    return e.groupBy("doc_id", "page_idx").agg(
        F.count("*").alias("entries"),
        F.sum(F.length("text")).alias("chars"),
        F.sum(F.element_at("bbox", 3)).alias("right_edges"),
        F.max("page_size.width").alias("width"),
    )


@query
def src_5_layout_pages(spark, sf_dir):
    return Y.layout_pages(layout_documents(spark, sf_dir)).select("doc_id", "page_no", "text")


@query
def src_6_evaluation_set(spark, sf_dir):
    """Benchmark passages as an evaluation CSV, read back with the fixed schema."""
    path = session.scratch_path(spark, "evaluation")
    b = I.table(spark, sf_dir, "benchmark")
    b.select(
        F.concat(F.lit("t"), F.col("item_id").cast("string")).alias("test_id"), F.col("text").alias("question"),
        F.col("item_id").cast("string").alias("expected_chunk_id"), F.lit(None).cast("string").alias("expected_document_id"),
        F.lit('say "a, b"').alias("expected_chunk_title"), F.lit("one; two").alias("expected_keywords"),
    ).write.option("header", True).option("escape", '"').csv(path)
    return files.read_evaluation_set(spark, path)


@query
def src_7_version_chunks(spark, sf_dir):
    """Chunks of the newest version of every document, in order."""
    newest = V.latest_versions(I.versions(spark, sf_dir)).select("version_id")
    c = V.chunks_of_versions(chunk_table(spark, sf_dir), newest)
    return c.select("version_id", "place", "chunk_index", "title")


@query
def src_8_ingest_context(spark, sf_dir):
    ready, errors = V.ingest_context(I.versions(spark, sf_dir), I.document_table(spark, sf_dir))
    columns = ["version_id", "document_id", "source_type", "title", "error"]
    ok = ready.withColumn("error", F.lit(None).cast("string")).select(*columns)
    bad = errors.withColumn("source_type", F.lit(None).cast("string")).withColumn("title", F.lit(None).cast("string"))
    return ok.unionByName(bad.select(*columns))


# --- sinks -----------------------------------------------------------------------------


def _incoming(points):
    """New vectors: every third point again with another label, and a copy of every fifth under a new id."""
    again = points.filter("id % 3 = 0").withColumn("label", F.col("label") + 100)
    new = points.filter("id % 5 = 0").withColumn("id", F.col("id") + 1_000_000_000)
    return again.unionByName(new)


@query
def snk_1_upsert(spark, sf_dir):
    p = I.points(spark, sf_dir).select("id", "embedding", "label", "document_id")
    out = sinks.upsert(p, _incoming(p))
    return out.select("id", "label", "document_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query
def snk_2_vector_table(spark, sf_dir):
    """Create the table if absent, check vector sizes, write the first version."""
    p = I.points(spark, sf_dir).select("id", "embedding", "chunk_kind", "article_number")
    schema = p.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    path = session.scratch_path(spark, "points")
    empty = sinks.create_table(spark, path, schema)
    full = sinks.upsert(empty, sinks.with_vector_size(p, 64))
    target = sinks.write_snapshot(full, session.scratch_path(spark, "points"), sort_by=("chunk_kind", "article_number"))
    return spark.read.parquet(target).select("id", "chunk_kind", "article_number")


@query
def snk_3_delete_documents(spark, sf_dir):
    """Delete the points of documents that hold a member of label 3; counts before and after."""
    p = I.points(spark, sf_dir).drop("embedding", "text")
    keys = p.filter("label = 3").select("document_id")
    return sinks.deletion_report(p, sinks.delete_keys(p, keys, "document_id"), "document_id")


@query
def snk_4_delete_version(spark, sf_dir):
    """Delete by a version that either of two columns may name; NULL names nothing."""
    v = I.versions(spark, sf_dir)
    p = v.select("document_id", "version_id", F.col("previous_version_id").alias("metadata_version_id"), "version_no")
    gone = sinks.belongs_to_version(F.lit("7"), F.col("version_id"), F.col("metadata_version_id"))
    return p.filter(~gone)


@query
def snk_5_chunk_rows(spark, sf_dir):
    # counts and repeated keys both read the chunks, which are parsed once for them
    chunks = session.materialize(chunk_table(spark, sf_dir).select("version_id", "chunk_index"), "chunks")
    rows, repeated = sinks.chunk_rows(chunks)
    per = rows.groupBy("version_id").agg(F.count("*").alias("n"), F.max("chunk_index").alias("last"))
    clash = repeated.select("version_id", F.lit(True).alias("clash")).distinct()
    joined = per.join(clash, "version_id", "left")
    return joined.select("version_id", "n", "last", F.coalesce("clash", F.lit(False)).alias("clash"))


@query
def snk_6_embedding_ids(spark, sf_dir):
    # the chunks and the new ids are two branches of one table, which is parsed once for them
    c = session.materialize(chunk_table(spark, sf_dir).select("chunk_id", "chunk_index", "embedding_id"), "chunks")
    ids = c.filter("chunk_index % 2 = 0").select("chunk_id", F.concat(F.lit("p-"), "chunk_id").alias("new_embedding_id"))
    return sinks.set_embedding_ids(c, ids).select("chunk_id", "chunk_index", "embedding_id")


@query
def snk_7_artifact_keys(spark, sf_dir):
    m = I.messages(spark, sf_dir)
    """Messages stored as artifacts and read back, with the keys that name them."""
    path = session.scratch_path(spark, "artifacts")
    session_id = F.col("session_id").cast("string")
    sinks.write_artifacts(m.select("message_id", F.col("role").alias("kind"), session_id.alias("document_id"), F.col("created_at").alias("at"), "content"), path)
    key = sinks.artifact_key(F.col("document_id"), F.col("kind"), F.col("at"), F.col("message_id").cast("string"))
    return spark.read.parquet(path).select("message_id", key.alias("artifact_key"), F.length("content").cast("bigint").alias("chars"))


@query
def snk_8_chunk_artifacts(spark, sf_dir):
    """Chunks written as JSON rows and text blocks, and both read back."""
    path = session.scratch_path(spark, "artifacts")
    chunks = chunk_table(spark, sf_dir)
    sinks.write_chunk_artifacts(chunks, path)
    stored = chunks.select("document_id", "chunk_text", "total_chunks").schema  # else all rows are read once more for it
    rows = spark.read.schema(stored).json(f"{path}/json").groupBy(F.col("document_id").cast("string").alias("document_id"))
    counted = rows.agg(F.count("*").alias("chunks"), F.sum(F.length("chunk_text")).alias("chars"), F.max("total_chunks").cast("bigint").alias("total_chunks"))
    block = F.regexp_extract("value", "^document_id: (.*)$", 1)
    blocks = spark.read.text(f"{path}/text").select(block.alias("document_id")).filter("document_id <> ''")
    return counted.join(blocks.groupBy("document_id").agg(F.count("*").alias("blocks")), "document_id", "left")


@query
def snk_10_cascade_delete(spark, sf_dir):
    """Delete the documents without a stored row: remaining versions and their files' owners."""
    v = I.versions(spark, sf_dir)
    gone = v.join(I.document_table(spark, sf_dir), "document_id", "left_anti").select("document_id").distinct()
    left = sinks.cascade_delete(gone, {"versions": v})["versions"]
    kept = left.groupBy("document_id").agg(F.count("*").alias("n")).withColumn("what", F.lit("kept"))
    files_gone = sinks.orphan_artifacts(v, gone).groupBy("document_id").agg(F.count("*").alias("n"))
    return kept.unionByName(files_gone.withColumn("what", F.lit("files")))


# --- versions --------------------------------------------------------------------------


@query
def ver_1_previous_version(spark, sf_dir):
    c = chunk_table(spark, sf_dir).select(
        "chunk_id", "version_id", "chunk_index", "chunk_text", "metadata.article_number",
        "metadata.target_article_number", "metadata.is_amendment",
    )
    out = V.annotate_previous(session.materialize(c, "chunks"), I.versions(spark, sf_dir))
    return out.select(
        "chunk_id", "version_id", "previous_version_id", "relation_to_previous_version", "previous_chunk_id",
        "previous_chunk_title", "previous_article_number",
    )


@query
def ver_2_latest_versions(spark, sf_dir):
    return V.latest_versions(I.versions(spark, sf_dir)).select("document_id", "version_id", "version_no", "source_file_path")


@query
def ver_3_next_versions(spark, sf_dir):
    """Labelled documents uploaded again to their source, after the existing versions."""
    d = I.table(spark, sf_dir, "labels").join(I.table(spark, sf_dir, "documents"), "doc_id")
    batch = d.select(
        F.col("source").alias("document_id"), F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("version_id"),
        F.col("doc_id").alias("upload_no"),
    )
    return V.link_versions(batch, I.versions(spark, sf_dir))


@query
def ver_4_checksums(spark, sf_dir):
    return V.with_checksums(I.dirty(spark, sf_dir)).select("doc_id", "source_checksum", "checksum")


@query
def ver_5_known_content(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"), F.sha2(clean(F.col("text")), 256).alias("checksum")
    )
    d = session.materialize(d, "checksums")
    known = V.known_by_checksum(d, d)
    return known.filter("document_id <> existing_document_id").select("document_id", "existing_document_id")


@query
def ver_6_upload_checks(spark, sf_dir):
    u = I.upload_files(spark, sf_dir)
    reason = V.upload_rejection(F.col("mime_type"), F.col("file_name"), F.col("bytes"))
    return u.select("doc_id", reason.alias("reject_reason"))


@query
def ver_7_field_updates(spark, sf_dir):
    v = I.versions(spark, sf_dir)
    updates = I.table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("version_id"),
        F.when(F.col("quality") == 1, "completed").alias("status"),
        F.when(F.col("toxic") == 1, F.lit("clean.txt")).alias("cleaned_text_path"),
    )
    out = V.merge_fields(v, updates, "version_id", ["status", "cleaned_text_path"])
    return out.select("version_id", "status", "cleaned_text_path", "raw_text_path")


def job_rows(spark, sf_dir):
    """The newest state of every job."""
    j = I.jobs(spark, sf_dir)
    newest = F.max_by(F.struct("document_id", "event_id", "status", "retry_count", "ts", "failed"), F.struct("ts", "event_id"))
    rows = j.groupBy("job_id").agg(newest.alias("j")).select("job_id", "j.*")
    return rows.select(
        "job_id", "document_id", F.col("document_id").cast("string").alias("version_id"), F.lit("ingest").alias("job_type"),
        "status", F.lit(None).cast("timestamp_ntz").alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("finished_at"),
        F.lit(None).cast("string").alias("error_message"), "retry_count", "failed",
    )


@query
def ver_8_pending_jobs(spark, sf_dir):
    return V.pending_jobs(job_rows(spark, sf_dir)).select("job_id", "document_id", "retry_count")


@query
def ver_9_job_states(spark, sf_dir):
    jobs = job_rows(spark, sf_dir)
    at = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    target = F.expr("CASE status WHEN 'pending' THEN 'running' WHEN 'running' THEN 'completed' WHEN 'completed' THEN 'failed' END")
    changes = jobs.filter("status <> 'failed'").select(
        "job_id", target.alias("new_status"), at.alias("at"), F.when(F.col("status") == "completed", "late").alias("error")
    )
    out = V.apply_job_status(jobs, changes)
    text = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return out.select("job_id", "status", text("started_at"), text("finished_at"), "error_message")


@query
def ver_10_retries(spark, sf_dir):
    jobs = job_rows(spark, sf_dir).withColumn("error", F.lit("boom"))
    out = V.retry_decision(jobs)
    reset = V.manual_retry(job_rows(spark, sf_dir)).select(
        "job_id", F.col("status").alias("manual_status"), F.col("retry_count").cast("bigint").alias("manual_count")
    )
    return out.select("job_id", "next_status", "next_retry_count", "next_error").join(reset, "job_id")


@query
def ver_11_document_list(spark, sf_dir):
    v = I.versions(spark, sf_dir)
    c = chunk_table(spark, sf_dir).select("version_id").join(v.select("version_id", "document_id"), "version_id")
    out = V.document_list(I.document_table(spark, sf_dir), v, c)
    return out.select("document_id", "title", "file_path", "source_path", "versions_count", "chunks_count")


@query
def ver_12_version_page(spark, sf_dir):
    order = [F.col("version_no").desc(), F.col("document_id"), F.col("version_id")]
    rows = I.versions(spark, sf_dir).select("document_id", "version_id", "version_no")
    return V.page_of(rows, order, page=2, page_size=20)


@query
def ver_13_page_count(spark, sf_dir):
    return V.page_count(I.versions(spark, sf_dir), 20)
