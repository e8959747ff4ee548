"""Deterministic range shards, and files that become visible only when all of them are written.

Shards are ranges of an integer key. Their bounds come from exact sums of a weight per key interval, so they depend on
the rows alone, not on their partitions, order or a sample. The driver holds a few numbers per shard.

Files are written by the task of their shard under names that no other attempt uses. A task returns one manifest row
per file; Spark's own commit keeps the rows of one attempt of each task. After that the files get their final names,
which may be repeated without harm, and last the manifest is written beside them: a reader that starts from the
manifest sees all files or none.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawloom.session import materialize

CELLS_PER_SHARD = 16


def shard_starts(rows: DataFrame, key: str, weight: Column, target: int) -> list[int]:
    """First keys of shards of about `target` weight, ascending, without the first shard's. A key is never split."""
    k = F.col(key).cast("decimal(20,0)")
    low, high, total = rows.agg(F.min(key), F.max(key), F.sum(weight.cast("double"))).first()
    if low is None or not total or total <= target:
        return []
    cells = int(min(1 << 20, CELLS_PER_SHARD * (total // target + 1)))
    done, open_ranges = [], [(low, -(-(high - low + 1) // cells))]
    while open_ranges:
        heavy = []
        for start, width in open_ranges:
            cell = F.floor((k - start) / F.lit(width).cast("decimal(20,0)")).cast("long")
            inside = rows.filter(F.col(key) >= start).filter(k < F.lit(start).cast("decimal(20,0)") + cells * F.lit(width).cast("decimal(21,0)"))
            sums = inside.groupBy(cell.alias("cell")).agg(F.sum(weight.cast("double")).alias("w")).collect()
            for c, w in sums:
                (heavy if w > target and width > 1 else done).append((start + c * width, w, width))
        cells = CELLS_PER_SHARD * 4
        open_ranges = [(start, -(-width // cells)) for start, _, width in heavy]
    starts, held = [], 0.0
    for start, w, _ in sorted(done):
        if held and held + w > target:
            starts.append(start)
            held = 0.0
        held += w
    return starts


def shard_of(key: str, starts: list[int]) -> Column:
    """Number of the key's shard; null keys belong to the first."""
    if not starts:
        return F.lit(0)
    bounds = np.array(starts, dtype=np.int64)

    @F.pandas_udf("int")
    def number(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(np.int64), side="right"), dtype="int32")

    return number(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))))


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it: a plain path, or a URI that Arrow knows (file, hdfs, s3, gs)."""
    if re.match(r"[a-z0-9]+:/", path):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), path


def write_files(
    rows: DataFrame,
    shards: int,
    order: list[Column],
    folder: str,
    write: Callable[[Iterator[pa.RecordBatch], Callable[[str], str]], Iterator[dict]],
    schema: str,
) -> DataFrame:
    """Bring the rows of each `_shard` into one task in the given order, let `write` write them, publish its files, and
    return the manifest. `write(batches, temporary)` yields one row per file with at least `name`: temporary(name) is
    where it writes that file."""
    attempt_root = f"{folder}/_temporary-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = f"{attempt_root}/{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}"
        fs, made = None, False

        def temporary(name: str) -> str:
            nonlocal fs, made
            if not made:
                fs, path = file_system(root)
                fs.create_dir(path, recursive=True)
                made = True
            return f"{root}/{name}"

        for row in write(batches, temporary):
            yield pa.RecordBatch.from_pylist([row | {"written": f"{root}/{row['name']}", "path": f"{folder}/{row['name']}"}], arrow)

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, source = file_system(row["written"])
                target = file_system(row["path"])[1]
                if fs.get_file_info(source).type != pafs.FileType.NotFound:
                    fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    fs.move(source, target)
                elif fs.get_file_info(target).type == pafs.FileType.NotFound:
                    raise FileNotFoundError(row["path"])
            yield batch

    full = f"{schema}, written string, path string"
    arrow = _arrow_schema(rows, full)
    sorted_rows = rows.repartitionById(max(1, shards), F.col("_shard")).sortWithinPartitions(F.col("_shard"), *order)
    written = materialize(sorted_rows.mapInArrow(run, full), "manifest")
    written.repartition(max(1, min(shards, 64)), "name").mapInArrow(publish, full).drop("written").write.parquet(f"{folder}/_manifest")
    fs, path = file_system(attempt_root)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_dir(path)
    return rows.sparkSession.read.parquet(f"{folder}/_manifest")


def _arrow_schema(rows: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
