"""Tables that every task reads in blocks of bounded size.

A join of a stated set of queries with all rows by a score needs every query beside every row. The queries are written
once to the shared folder; a task holds a bounded slice of its rows and reads the queries block by block, so the rows are
read once, nothing is broadcast or collected, and the memory of a task does not grow with either side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame

from lawloom.session import scratch_path


@dataclass(frozen=True)
class BlockTable:
    """A written table, small enough to send to tasks: its folder and columns."""

    folder: str
    columns: tuple[str, ...]

    def blocks(self, rows: int) -> Iterator[pa.RecordBatch]:
        """The rows, at most `rows` at a time, in the order of the files."""
        fs, path = _file_system(self.folder)
        found = fs.get_file_info(pafs.FileSelector(path))
        for info in sorted((f for f in found if f.base_name.startswith("part-")), key=lambda f: f.path):
            with fs.open_input_file(info.path) as f:
                for batch in pq.ParquetFile(f).iter_batches(batch_size=rows, columns=list(self.columns)):
                    if batch.num_rows:
                        yield batch


def write_blocks(df: DataFrame, name: str = "blocks") -> BlockTable:
    """Write the rows to the shared folder."""
    folder = scratch_path(df.sparkSession, name)
    df.write.parquet(folder)
    return BlockTable(folder, tuple(df.columns))


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[pa.Table]:
    """The rows of a task in slices of about `max_bytes`, one batch at least."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and size + batch.nbytes > max_bytes:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held)


def _file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """A plain path, or a URI that Arrow knows (file, hdfs, s3, gs)."""
    if re.match(r"[a-z0-9]+:/", folder):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))
    return pafs.LocalFileSystem(), folder
