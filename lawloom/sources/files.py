"""File sources: plain text, corpus directories, OCR results, layouts, evaluation sets."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lawloom.functions.text import strip
from lawloom.operators.layout import ocr_pages

# Suffixes of the corpus scan.
TEXT_SUFFIXES = ("txt", "md", "rst")
SUPPORTED_SUFFIXES = ("pdf", *TEXT_SUFFIXES)
EVALUATION_SCHEMA = (
    "test_id string, question string, expected_chunk_id string, expected_document_id string, "
    "expected_chunk_title string, expected_keywords string"
)


def _file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def _document_id(stem: Column) -> Column:
    return F.replace(F.lower(stem), F.lit(" "), F.lit("_"))


def _local_path(path: Column) -> Column:
    """Undo URL escapes of file paths."""
    return F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def write_text_files(rows: DataFrame, path: str, folders: int = 64) -> None:
    """Rows (name, text) as one UTF-8 file each, in folders by a hash of the name. A task that runs again writes the same
    files again."""
    placed = rows.select("name", "text", F.pmod(F.xxhash64("name"), F.lit(folders)).cast("int").alias("folder"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _file_system(path)
        for batch in batches:
            for row in batch.itertuples():
                fs.create_dir(f"{root}/{row.folder}", recursive=True)
                with fs.open_output_stream(f"{root}/{row.folder}/{row.name}", compression=None) as out:
                    out.write((row.text or "").encode())
            yield batch[["name"]]

    placed.mapInPandas(write, "name string").write.format("noop").mode("overwrite").save()


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"[a-z0-9]+:/", path):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), path


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as documents: UTF-8, else Latin-1. Spark plans no reads for files of zero bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    content = F.col("content")
    text = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(
        F.decode(content, "ISO-8859-1")
    )
    newlines = F.regexp_replace(text, r"\r\n?", "\n")
    name = _file_name(_local_path(F.col("path")))
    return files.select(
        _document_id(_stem(name)).alias("doc_id"),
        _local_path(F.col("path")).alias("source_path"),
        F.lit("txt").alias("source_type"),
        _stem(name).alias("title"),
        strip(newlines).alias("raw_text"),
        name.alias("file_name"),
        F.lit("utf-8").alias("encoding"),
        F.length(strip(newlines)).alias("char_count"),
    )


FOLDER_TASKS = 64  # tasks that list and read the folders of a corpus
READ_BYTES = 16 * 1024 * 1024  # contents that a task holds before it hands them on


def _hidden(name: str) -> bool:
    """Files and folders that Spark's sources leave out."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def _corpus_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """(path, length, content) of the files below a directory that are not empty; contents only where ``suffixes`` are
    given, of the files that end in one. Tasks list the folders below the first level, so no list of files passes through
    the driver."""

    def shown(fs: pafs.FileSystem, at: str) -> str:
        if re.match(r"file:|/|[^:]*$", path):
            return f"file:{at}"
        return path[: path.index(fs_root(path)[1])] + at

    def fs_root(p: str) -> tuple[pafs.FileSystem, str]:
        fs, root = _file_system(p if re.match(r"[a-z0-9]+:/", p) else os.path.abspath(p))
        return fs, root.rstrip("/") or "/"

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = fs_root(path)
        for batch in batches:
            if len(batch):
                here = fs.get_file_info(root)
                found = [here] if here.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root))
                rows = [(f.path, f.type == pafs.FileType.Directory, f.size or 0) for f in found if not _hidden(f.base_name)]
                yield pd.DataFrame(rows, columns=["path", "folder", "length"])

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int]]:
        fs, _ = fs_root(path)
        for batch in batches:
            open_folders = [r.path for r in batch.itertuples() if r.folder]
            yield from ((r.path, r.length) for r in batch.itertuples() if not r.folder)
            while open_folders:
                for f in fs.get_file_info(pafs.FileSelector(open_folders.pop())):
                    if not _hidden(f.base_name):
                        if f.type == pafs.FileType.Directory:
                            open_folders.append(f.path)
                        else:
                            yield f.path, f.size

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = fs_root(path)
        columns, rows, held = ["path", "length", "content"], [], 0
        for at, length in files(batches):
            if not length or (suffixes is not None and not at.lower().endswith(tuple(f".{x}" for x in suffixes))):
                continue
            content = None
            if suffixes is not None:
                with fs.open_input_file(at) as f:
                    content = f.read()
            rows.append((shown(fs, at), length, content))
            held += 200 + len(content or b"")
            if held >= READ_BYTES:
                yield pd.DataFrame(rows, columns=columns)
                rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    top = spark.range(0, 1, 1, 1).mapInPandas(first, "path string, folder boolean, length bigint")
    return top.repartition(FOLDER_TASKS).mapInPandas(read, "path string, length bigint, content binary")


def scan_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Every file below a directory with a ``supported`` flag, so that skipped files stay reportable.

    Only file facts are read; contents stay on storage. Empty files give no rows.
    """
    name = _file_name(F.col("path"))
    suffix = F.lower(F.regexp_extract(name, r"(?<=.)\.([^.]+)$", 1))
    return _corpus_files(spark, path).select(
        F.col("path").alias("source_path"),
        name.alias("file_name"),
        suffix.alias("suffix"),
        F.col("length").alias("bytes"),
        suffix.isin(*SUPPORTED_SUFFIXES).alias("supported"),
    )


def read_corpus_texts(spark: SparkSession, path: str) -> DataFrame:
    """Texts of the corpus files that are read directly; bytes that are not UTF-8 are left out."""
    valid = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    return _corpus_files(spark, path, TEXT_SUFFIXES).select(F.col("path").alias("source_path"), valid.alias("raw_text"))


def read_ocr_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, page_no, text) of OCR result files with one JSON object per line."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    lines = files.select(
        _document_id(_stem(_file_name(_local_path(F.col("_metadata.file_path"))))).alias("doc_id"),
        F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("line_no", "json"),
    )
    return ocr_pages(lines)


def read_layouts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, layout) with one JSON document per file."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    stem = _stem(_file_name(_local_path(F.col("_metadata.file_path"))))
    return files.select(_document_id(stem).alias("doc_id"), F.col("value").alias("layout"))


def read_evaluation_set(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Evaluation rows of CSV files with header (a byte order mark does no harm); missing ids become row_n.

    Rows are numbered by file name and place in the file. A multi-line CSV file is one split, so ids within it increase;
    the offsets of the files are added up over one row per file.
    """
    rows = (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        .option("enforceSchema", True).schema(EVALUATION_SCHEMA).csv(path)
    )
    placed = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__id"))
    per_file = placed.groupBy("__file").agg(F.min("__id").alias("__first"), F.count("*").alias("__rows"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_file.select("__file", "__first", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    numbered = placed.join(offsets, "__file").withColumn("__n", F.col("__offset") + F.col("__id") - F.col("__first") + 1)
    if limit is not None:
        numbered = numbered.filter(F.col("__n") <= limit)
    default = F.concat(F.lit("row_"), F.col("__n").cast("string"))
    texts = {c: F.coalesce(c, F.lit("")) for c in rows.columns if c != "test_id"}
    named = numbered.withColumn("test_id", F.coalesce(F.nullif("test_id", F.lit("")), default)).withColumns(texts)
    return named.select(*rows.columns)
