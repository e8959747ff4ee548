"""Hard negatives by a secondary-sort shuffle.

Scores of pairs are packed into binary keys (anchor, descending score, kind, id) whose byte order is the wanted order:
repartition by the anchor and sortWithinPartitions by the key are the DataFrame form of
repartitionAndSortWithinPartitions. An iterator reads the sorted keys of an anchor once, opens a window at each positive
and emits the negatives that fall into open windows; it holds the open windows only, never the rows of an anchor.

What is shuffled. All pairs would be quadratic, so tasks send only keys that can be in the result. Anchors are a written
table that each task reads in blocks beside a slice of its rows, so the rows are read once per pass. A task sends the
best `k` positives per anchor, and, once those are known, the best `k` negatives of each window. A first pass over one
row in `SEED_ROWS` gives a lower bound per window, below which no later task sends anything; every row is in the main
pass, so the bounds save shuffle and lose nothing.

Scores are exact integers: products of integer-valued floats below 2**24 (single) or 2**53 (double), else of Python
integers, clamped to 64 bits.

Defined results: rows with a null id, label or vector, or a null or non-finite scaled component take no part; vectors
are compared with those of their own length only; ties go by the smaller id; repeated rows count as often as they occur;
rows with the anchor's id are neither its positives nor its negatives; an id that repeats among the anchors is one
anchor, with its smallest (label, vector); a window whose positive has a negative score is empty; extra columns are not
carried; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawloom.session import materialize
from lawloom.sources.blocks import BlockTable, slices, write_blocks

K, LOWER_PERCENT = 5, 80
ANCHORS_PER_BLOCK, ROWS_PER_STEP = 256, 16_384
SLICE_BYTES = 64 << 20  # rows that a task scores against all anchors at once
SEED_ROWS = 16
SCALE = 256

_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_SIGN = np.uint64(1 << 63)
_KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
_KEYS = "key binary"
_PAIRS = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def pack(anchor: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> pa.RecordBatch:
    """Keys whose bytes sort by anchor, descending score, kind (positives first) and id."""
    out = np.empty(len(anchor), _KEY)
    out["anchor"] = anchor.astype(np.int64).view(np.uint64) ^ _SIGN
    out["score"] = ~(score.astype(np.int64).view(np.uint64) ^ _SIGN)
    out["kind"] = kind
    out["id"] = ids.astype(np.int64).view(np.uint64) ^ _SIGN
    offsets = pa.array(np.arange(len(out) + 1, dtype=np.int32) * _KEY.itemsize).buffers()[1]
    return pa.record_batch([pa.Array.from_buffers(pa.binary(), len(out), [None, offsets, pa.py_buffer(out.tobytes())])], names=["key"])


def unpack(keys: pa.Array) -> tuple[np.ndarray, ...]:
    """Anchor, score, kind and id of packed keys."""
    rows = np.frombuffer(b"".join(keys.to_pylist()), _KEY)
    plain = lambda x: (x.astype(np.uint64) ^ _SIGN).view(np.int64)
    return plain(rows["anchor"]), plain(~rows["score"].astype(np.uint64)), rows["kind"], plain(rows["id"])


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer-valued rows, exact: any partial sum is at most the product of the norms."""
    bound = max(1.0, np.sqrt((a * a).sum(axis=1).max(initial=0))) * max(1.0, np.sqrt((b * b).sum(axis=1).max(initial=0))) * 1.001
    if bound < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.float64)
    if bound < 1 << 53:
        return a @ b.T
    ints = [[[int(x) for x in row] for row in side] for side in (a, b)]
    return np.array([[min(_HIGH, max(_LOW + 1, sum(x * y for x, y in zip(p, q, strict=True)))) for q in ints[1]] for p in ints[0]], object)


class Vectors:
    """Usable rows of one vector length: ids, labels and integer-valued vectors."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors


def usable(ids: pa.Array, labels: pa.Array, vectors: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, Vectors]]:
    """Per vector length: positions of the rows that take part, and the rows."""
    lengths = np.diff(vectors.offsets.to_numpy()).astype(np.int64)
    known = ~(ids.is_null().to_numpy(False) | labels.is_null().to_numpy(False) | vectors.is_null().to_numpy(False))
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(flat * scale)
    starts = np.concatenate([[0], np.cumsum(np.where(vectors.is_null().to_numpy(False), 0, lengths))[:-1]]).astype(np.int64)
    ids, labels = (x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (ids, labels))
    for length in np.unique(lengths[known]):
        at = np.flatnonzero(known & (lengths == length))
        matrix = flat[starts[at, None] + np.arange(length)] if length else np.zeros((len(at), 0))
        finite = np.isfinite(matrix).all(axis=1)
        at, matrix = at[finite], matrix[finite]
        if len(at):
            yield at, Vectors(ids[at], labels[at], matrix)


def _column(table: pa.Table, name: str) -> pa.Array:
    out = table.column(name).combine_chunks()
    return out.chunk(0) if isinstance(out, pa.ChunkedArray) else out


def _matrix(lists: pa.Array, at: np.ndarray, width: int, fill: int) -> np.ndarray:
    """Lists of at most `width` longs as the rows of a matrix."""
    out = np.full((len(at), width), fill, np.int64)
    for row, values in enumerate(lists.take(pa.array(at)).to_pylist()):
        out[row, : len(values or ())] = values or ()
    return out


Select = Callable[[Vectors, np.ndarray, np.ndarray, Vectors, int], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def scan(rows: DataFrame, anchors: BlockTable, select: Select, kind: int, k: int, scale: float) -> DataFrame:
    """Keys of the rows that `select` picks, for all anchors. Anchors (id, label, vector, lows, highs) are scaled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE_BYTES):
            mine = {v.vectors.shape[1]: v for _, v in usable(_column(part, "id"), _column(part, "label"), _column(part, "vector"), scale)}
            if not mine:
                continue
            for block in anchors.blocks(ANCHORS_PER_BLOCK):
                for at, a in usable(block.column("id"), block.column("label"), block.column("vector"), 1):
                    if (v := mine.get(a.vectors.shape[1])) is None:
                        continue
                    lows, highs = (_matrix(block.column(c), at, k, fill) for c, fill in (("lows", _HIGH), ("highs", _LOW)))
                    for i, score, ids in select(a, lows, highs, v, k):
                        if len(i):
                            yield pack(a.ids[i], score, kind, ids)

    return rows.select("id", "label", "vector").mapInArrow(run, _KEYS)


def _unlike_own(scores: np.ndarray, a: Vectors, ids: np.ndarray) -> np.ndarray:
    """Scores of rows with the anchor's id are set below all others."""
    for j in np.flatnonzero(np.isin(ids, a.ids)):
        scores[a.ids == ids[j], j] = -np.inf
    return scores


def best_positives(a: Vectors, lows: np.ndarray, highs: np.ndarray, rows: Vectors, k: int):
    """The best k rows of the anchor's label per step, not below the bound in lows[:, 0]."""
    for label in np.intersect1d(a.labels, rows.labels):
        mine, theirs = np.flatnonzero(a.labels == label), np.flatnonzero(rows.labels == label)
        bound = np.where(highs[mine, 0] == _LOW, -np.inf, np.nextafter(lows[mine, 0].astype(np.float64), -np.inf))
        for s in range(0, len(theirs), ROWS_PER_STEP):
            at = theirs[s : s + ROWS_PER_STEP]
            ids = rows.ids[at]
            scores = _unlike_own(exact_scores(a.vectors[mine], rows.vectors[at]), a_of(a, mine), ids)
            least = np.maximum(bound, np.partition(scores, -k, axis=1)[:, -k]) if len(at) > k else bound
            i, j = np.nonzero((scores >= least[:, None]) & (scores != -np.inf))
            found = scores[i, j]
            order = np.lexsort((ids[j], -found, i))
            i, j, found = i[order], j[order], found[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            yield mine[i[first]], found[first].astype(np.int64), ids[j[first]]


def a_of(a: Vectors, at: np.ndarray) -> Vectors:
    return Vectors(a.ids[at], a.labels[at], a.vectors[at])


def best_negatives(a: Vectors, lows: np.ndarray, highs: np.ndarray, rows: Vectors, k: int):
    """The best k rows of other labels per step in each window lows <= score <= highs."""
    open_ = lows <= highs
    if not open_.any():
        return
    # Longs beyond 2**53 round as floats, so the first test is one step wider; the windows below are exact.
    least = np.nextafter(np.where(open_, lows, _HIGH).min(axis=1).astype(np.float64), -np.inf)
    most = np.nextafter(np.where(open_, highs, _LOW).max(axis=1).astype(np.float64), np.inf)
    for s in range(0, len(rows.ids), ROWS_PER_STEP):
        ids, labels = rows.ids[s : s + ROWS_PER_STEP], rows.labels[s : s + ROWS_PER_STEP]
        scores = _unlike_own(exact_scores(a.vectors, rows.vectors[s : s + ROWS_PER_STEP]), a, ids)
        i, j = np.nonzero((scores >= least[:, None]) & (scores <= most[:, None]))
        other = a.labels[i] != labels[j]
        i, j = i[other], j[other]
        found = scores[i, j].astype(np.int64)
        order = np.lexsort((ids[j], -found, i))
        i, j, found = i[order], j[order], found[order]
        start, keep = np.searchsorted(i, i), np.zeros(len(i), bool)
        for w in range(lows.shape[1]):
            inside = (found >= lows[i, w]) & (found <= highs[i, w])
            before = np.concatenate([[0], np.cumsum(inside)])
            keep |= inside & (before[1:] - before[start] <= k)
        yield i[keep], found[keep], ids[j[keep]]


def sorted_keys(keys: DataFrame) -> DataFrame:
    """The secondary sort: the keys of an anchor in one partition, in the order of their bytes."""
    return keys.repartition(F.substring("key", 1, 8)).sortWithinPartitions("key")


def _first_positives(keys: DataFrame, k: int) -> DataFrame:
    """The first k keys of each anchor: anchor, place, score and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, taken = None, 0
        for batch in batches:
            rows = []
            for anchor, score, _, row in zip(*(x.tolist() for x in unpack(batch.column(0))), strict=True):
                last, taken = (last, taken + 1) if anchor == last else (anchor, 1)
                if taken <= k:
                    rows.append((anchor, taken, score, row))
            if rows:
                yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=["anchor", "place", "score", "id"])

    return sorted_keys(keys).mapInArrow(run, "anchor long, place long, score long, id long")


def emit(keys: DataFrame, k: int, percent: int) -> DataFrame:
    """One pass over the sorted keys: positives open windows, negatives are emitted into the open ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, windows = None, []
        for batch in batches:
            out = []
            for anchor, score, kind, row in zip(*(x.tolist() for x in unpack(batch.column(0))), strict=True):
                if anchor != last:
                    last, windows = anchor, []
                if kind == 0:
                    windows.append([row, score, 0])
                    continue
                windows = [w for w in windows if w[2] < k and percent * w[1] <= 100 * score]
                for w in windows:
                    w[2] += 1
                    out.append((anchor, w[0], w[2], row, w[1], score))
            if out:
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.record_batch(columns, names=[c.split()[0] for c in _PAIRS.split(", ")])

    return sorted_keys(keys).mapInArrow(run, _PAIRS)


def scaled_anchors(rows: DataFrame, scale: float) -> DataFrame:
    """Usable anchors with scaled vectors, one per id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, v in usable(batch.column(0), batch.column(1), batch.column(2), scale):
                vectors = pa.array(list(v.vectors), pa.list_(pa.float64()))
                yield pa.record_batch([pa.array(v.ids), pa.array(v.labels), vectors], names=["id", "label", "vector"])

    found = rows.mapInArrow(run, "id long, label long, vector array<double>")
    one = found.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("one"))
    return one.select("id", "one.label", "one.vector")


def mine_hard_negatives(vectors: DataFrame, is_anchor: Column, id: str = "vec_id", label: str = "label", vector: str = "embedding",
                        k: int = K, percent: int = LOWER_PERCENT, scale: float = SCALE) -> DataFrame:
    """Per anchor and each of its first k positives, the first k negatives whose score is at least `percent` of the
    positive's and at most as high: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `is_anchor` marks the anchors among the rows; labels are integers; vector components x count as floor(scale * x)."""
    marked = vectors.withColumn("_is_anchor", is_anchor)
    rows = marked.select(
        F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"), "_is_anchor",
    )
    none = F.expr("cast(array() as array<bigint>)")
    anchors = materialize(scaled_anchors(rows.filter("_is_anchor").select("id", "label", "vector"), scale), "anchors")
    seeds = rows.filter(F.pmod(F.xxhash64("id"), F.lit(SEED_ROWS)) == 0)

    def positives(of: DataFrame, table: DataFrame) -> DataFrame:
        return _first_positives(scan(of, write_blocks(table, "anchors"), best_positives, 0, k, scale), k)

    bare = anchors.select("id", "label", "vector", none.alias("lows"), none.alias("highs"))
    floor = positives(seeds, bare).filter(F.col("place") == k).select(F.col("anchor").alias("id"), "score")
    bounded = anchors.join(floor, "id", "left")
    one = F.when(F.col("score").isNotNull(), F.array("score")).otherwise(none)
    first = materialize(positives(rows, bounded.select("id", "label", "vector", one.alias("lows"), one.alias("highs"))), "positives")

    lists = first.groupBy(F.col("anchor").alias("id")).agg(F.sort_array(F.collect_set("score")).alias("highs"))
    low = _lower(percent)
    windows = anchors.join(lists, "id").withColumn("lows", F.transform("highs", low))
    seen = scan(seeds, write_blocks(windows.select("id", "label", "vector", "lows", "highs"), "anchors"), best_negatives, 1, k, scale)
    bounds = emit(seen.unionByName(_positive_keys(first)), k, percent).filter(F.col("rank") == k)
    bounds = bounds.groupBy(F.col("anchor_id").alias("id")).agg(
        F.map_from_entries(F.collect_set(F.struct("positive_score", "negative_score"))).alias("bounds")
    )
    known = windows.join(bounds, "id", "left")
    known = known.withColumn("lows", F.transform("highs", lambda h: F.coalesce(F.col("bounds")[h], low(h))))
    blocks = write_blocks(known.select("id", "label", "vector", "lows", "highs"), "anchors")
    return emit(scan(rows, blocks, best_negatives, 1, k, scale).unionByName(_positive_keys(first)), k, percent)


def _lower(percent: int) -> Callable[[Column], Column]:
    """The least score n of a window with percent * positive <= 100 * n."""
    hundred = F.lit(100).cast("decimal(3,0)")
    return lambda high: F.ceil(high.cast("decimal(20,0)") * F.lit(percent).cast("decimal(3,0)") / hundred).cast("long")


def _positive_keys(first: DataFrame) -> DataFrame:
    """Keys of the positives (anchor, score, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pack(*(batch.column(c).to_numpy() for c in (0, 1)), 0, batch.column(2).to_numpy())

    return first.select("anchor", "score", "id").mapInArrow(run, _KEYS)
