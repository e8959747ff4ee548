"""Benchmark decontamination: the windows of the benchmark items are a broadcast hash set, and every task scans the
windows of its documents against it.

Words are runs of digits, a-z and characters beyond ASCII, after lower-casing A-Z. A window is `size` consecutive words
of an item; an item with fewer words is one window. The scan compares 64-bit window hashes with a bit map and a sorted
array, and confirms each hit on the words themselves, so a hash collision cannot make a hit.

The benchmark is read in blocks of at most `BLOCK_WORDS` words; each block is one broadcast and one pass, and the
passes are put together per document, so the broadcast is bounded whatever the size of the benchmark.

Defined results: null or word-less texts have no words and no hits; items without a word have no windows; equal item
ids count as one item; an item with a null id hits words like any other, but is named and counted nowhere; rows are
judged one by one, so repeated rows are repeated in the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawloom.session import materialize

SIZE = 13
BLOCK_WORDS = 4_000_000  # words of one broadcast block of the benchmark, about 40 MB
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def fold_words(text: str | None) -> list[bytes]:
    """Words as UTF-8. Bytes of characters beyond ASCII are never separators, so splitting bytes is exact."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def _window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(words) - size + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * np.uint64(_BASE) + words[k : k + len(out)]
        return out ^ (out >> np.uint64(29))


def _hashes(words: list[bytes]) -> np.ndarray:
    """One process hashes both sides, so Python's own string hash is enough; hits are confirmed on words."""
    return np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)


class WindowSet:
    """Windows of a block of items by length: bit map, sorted hashes, and the items of each window."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], size: int):
        self.items_of: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
        for item, words in items:
            n = min(size, len(words))
            for i in range(len(words) - n + 1) if n else ():
                ids = self.items_of.setdefault(n, {}).setdefault(tuple(words[i : i + n]), set())
                if item is not None:
                    ids.add(item)
        self.maps: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, windows in self.items_of.items():
            h = np.unique(np.concatenate([_window_hashes(_hashes(list(w)), n) for w in windows]))
            bits = np.zeros(1 << 20, dtype=bool)
            bits[h >> np.uint64(44)] = True
            self.maps[n] = (bits, h)

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the items that hit them."""
        hit, items, h = np.zeros(len(words), dtype=bool), set(), _hashes(words)
        for n, (bits, known) in self.maps.items():
            if len(words) < n:
                continue
            w = _window_hashes(h, n)
            near = np.flatnonzero(bits[w >> np.uint64(44)])
            if len(near):
                at = np.searchsorted(known, w[near])
                near = near[known[np.minimum(at, len(known) - 1)] == w[near]]
            for i in near.tolist():
                found = self.items_of[n].get(tuple(words[i : i + n]))
                if found is not None:
                    hit[i : i + n] = True
                    items |= found
        return hit, items


def benchmark_blocks(benchmark: DataFrame, item_id="item_id", text="text", block_words: int = BLOCK_WORDS) -> Iterator[list]:
    """The items, in blocks of at most `block_words` words; one longer item is a block of its own."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_id).cast("string"), F.col(text)).toLocalIterator():
        words = fold_words(row[1])
        if not words:
            continue
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((row[0], words))
        size += len(words)
    if block:
        yield block


_RANGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_SCHEMA = "n_words long, ranges array<struct<start: int, end: int>>, items array<string>"


def _ranges(hit: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def scan_block(rows: DataFrame, items: list, size: int, last: bool) -> DataFrame:
    """One pass of `row` (what is carried), `text`, `ranges` and `items` over one block of items, which are added to."""
    shared = rows.sparkSession.sparkContext.broadcast(items)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = WindowSet(shared.value, size)
        for batch in batches:
            counts, ranges, found = [], [], []
            for t, before, ids_before in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                words = fold_words(t.as_py())
                hit, ids = windows.scan(words)
                for r in before.as_py():
                    hit[r["start"] : r["end"]] = True
                counts.append(len(words))
                ranges.append(_ranges(hit))
                found.append(sorted(ids.union(ids_before.as_py())))
            text = [] if last else [batch.column(1)]
            cols = [pa.array(counts, pa.int64()), pa.array(ranges, _RANGES), pa.array(found, pa.list_(pa.string()))]
            yield pa.record_batch([batch.column(0), *text, *cols], names=names)

    names = ["row", *([] if last else ["text"]), "n_words", "ranges", "items"]
    kept = rows.select("row") if last else rows.select("row", "text")
    return rows.select("row", "text", "ranges", "items").mapInArrow(scan, f"{kept.schema.toDDL()}, {_SCHEMA}")


def find_hits(docs: DataFrame, benchmark: DataFrame, carry: list[str], text: str = "text", item_id: str = "item_id",
              item_text: str = "text", size: int = SIZE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row: `row` (a struct of the carried columns), n_words, ranges of hit words, items (sorted), n_hit, n_items and
    contaminated (hit words are 5 % of the words or more). More than one block of items means one written pass each."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{text}`").alias("text"),
        F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("ranges"),
        F.expr("cast(array() as array<string>)").alias("items"),
    )
    blocks = benchmark_blocks(benchmark, item_id, item_text, block_words)
    block = next(blocks, [])
    while True:
        after = next(blocks, None)
        rows = scan_block(rows, block, size, last=after is None)
        if after is None:
            break
        rows, block = materialize(rows, "hits"), after
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return rows.select(
        "row", "n_words", "ranges", "items", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows that are not contaminated, unchanged."""
    found = find_hits(docs, benchmark, docs.columns, text, **options)
    return found.filter("NOT contaminated").select("row.*")


def cut_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """All rows, their texts without the hit words; what stands between two hit words goes with them."""
    found = find_hits(docs, benchmark, docs.columns, text, **options)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, edges: pd.Series) -> pd.Series:
        return pd.Series([_cut(t, e.tolist()) for t, e in zip(texts, edges, strict=True)])

    edges = F.flatten(F.transform("ranges", lambda r: F.array(r["start"], r["end"])))
    hit = F.when(F.size("ranges") > 0, F.col("row")[text])
    clean = F.when(F.size("ranges") == 0, F.col("row")[text]).otherwise(cut(F.coalesce(hit, F.lit("")), edges))
    return found.select(*[(clean if c == text else F.col("row")[c]).alias(c) for c in docs.columns])


def _cut(text: str, edges: list[int]) -> str:
    """The text without the words [start, end) of each pair of edges."""
    raw = text.encode("utf-8", "surrogatepass")
    spans = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(_FOLD))]
    out, at = [], 0
    for start, end in zip(edges[::2], edges[1::2], strict=True) if spans else ():
        out.append(raw[at : spans[start][0]])
        at = spans[end - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")
