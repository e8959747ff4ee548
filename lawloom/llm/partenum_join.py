"""Jaccard similarity join on word n-grams by PartEnum signatures.

A document is the set of its distinct shingles of `size` words. Two documents are linked when
100 * |intersection| >= threshold * |union|; components of links share an id. The search is exact: it misses no link.

Size bands. Linked sets have sizes in the ratio of the threshold, so sizes are cut into bands, and a set signs for its
own band and for the bands that its larger partners can lie in. Two linked sets thus meet in the band of the larger one,
[l, r], where at most k = 2 r (100 - threshold) / (100 + threshold) shingles are in one set only.

Signatures. The domain of shingles is cut by a hash into (k + 1) / 2 parts, each of these into three. Among k differences
one part has at most one, so two of its three thirds are equal in both sets: for each part and each choice of two thirds
the sum of the hashes there is a signature, and linked sets share one. Sets below the size at which k is 1 are linked to
equal sets only, and equal sets are one vertex from the start.

Buckets. Documents that share a signature are candidates. Each bucket's documents are first compared with its smallest
member; confirmed links become components. Buckets of one component are done, since no further link there can matter.
In the others every pair of different components is compared, in buckets above `BLOCK` documents block against block;
blocks of one large component are never compared with each other. Parity sketches of 2,048 bits decide which pairs are
worth confirming: the bits in which they differ are a lower bound of the shingles that are in one set only, so they lose
nothing. The most similar partner of each document is confirmed first, the others only where they would join two
components. All links between different texts that matter for the components are confirmed on the full sets.

Defined results: a null text and one without words have an empty set and no links; a text of fewer than `size` words is
one shingle; rows with a null id are not compared and have no component; rows that share an id but not the text are
compared as separate sets under that id, repeated rows get the same result; extra columns are not carried; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawloom.llm.chosen_path import Shingler, confirm
from lawloom.llm.components import components
from lawloom.session import materialize

SIZE, THRESHOLD = 3, 90
BAND_RATIO = 1.4
SKETCH_BITS = 2048
BLOCK = 2048
PAIRS_PER_STEP = 50_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)
_THIRDS = np.arange(3, dtype=np.uint64)


def _mixed(x: np.ndarray, factor: np.uint64 = _MIX) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * factor
    return x ^ (x >> np.uint64(29))


def differences(low: int, high: int, threshold: int) -> int:
    """Most shingles that are in one of two linked sets only, of two sizes that add up to low + high."""
    return (low + high) * (100 - threshold) // (100 + threshold)


class Bands:
    """Bands of set sizes for a threshold, and the signatures of sets in them."""

    def __init__(self, threshold: int):
        self.threshold, ratio = threshold, max(BAND_RATIO, 105 / threshold)
        self.starts = [1]
        while self.starts[-1] < 1 << 40:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * ratio)))

    def of(self, size: int) -> range:
        """Numbers of the bands that a set of this size signs for."""
        largest = 100 * size // self.threshold
        first, last = (int(np.searchsorted(self.starts, s, side="right")) - 1 for s in (size, largest))
        return range(first, last + 1)

    def signatures(self, shingles: np.ndarray) -> np.ndarray:
        """All signatures of a set of 64-bit hashes."""
        out, h = [], _mixed(shingles)
        values, thirds = _mixed(shingles, _MIX2), ((h & np.uint64(0xFFFFFFFF)) * np.uint64(3) >> np.uint64(32)).astype(np.int64)
        for band in self.of(len(shingles)):
            top = self.starts[band + 1] - 1
            k = differences(top, top, self.threshold)
            if k == 0:
                continue
            parts = k // 2 + 1  # more than half of k, so that one part has one difference at most
            cell = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64) * 3 + thirds
            sums = np.zeros(parts * 3, np.uint64)
            np.add.at(sums, cell, values)
            sums = sums.reshape(parts, 3)
            place = (np.uint64(band) << np.uint64(48)) + np.arange(parts, dtype=np.uint64)[:, None] * np.uint64(3) + _THIRDS
            out.append(_mixed(sums.sum(axis=1, keepdims=True) - sums + _mixed(place)).ravel())
        return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def parity_sketch(shingles: np.ndarray) -> bytes:
    """Bits that are set where an odd number of the shingles fall."""
    at = (_mixed(shingles, _MIX2) >> np.uint64(17)) % np.uint64(SKETCH_BITS)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes()


def signed_sets(docs: DataFrame, size: int, threshold: int, doc_id: str, text: str) -> DataFrame:
    """Per row: doc_id, n (set size), digest, sketch and signatures of the set."""
    names = ["doc_id", "n", "digest", "sketch", "signatures"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, bands = Shingler(size), Bands(threshold)
        for batch in batches:
            rows = []
            for t in batch.column(1):
                s = shingler.shingles(t.as_py())
                # Two sums and the size tell sets apart as 128 bits do.
                digest = np.array([_mixed(s).sum(), _mixed(s, _MIX2).sum()]).tobytes() + len(s).to_bytes(4, "big") if len(s) else None
                rows.append((len(s), digest, parity_sketch(s) if len(s) else None, bands.signatures(s) if len(s) else None))
            types = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            columns = [pa.array([r[c] for r in rows], t) for c, t in enumerate(types)]
            yield pa.record_batch([batch.column(0), *columns], names=names)

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, digest binary, sketch binary, signatures array<long>")


def _close(n: str, m: str, threshold: int) -> Column:
    """Sizes that linked sets can have."""
    return (F.col(n) * 100 >= F.col(m) * threshold) & (F.col(m) * 100 >= F.col(n) * threshold)


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def sketch_filter(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches do not rule out a link, with the number of bits that differ."""
    left, right = (sets.select("rep", "n", "sketch").toDF(x, f"n_{x}", f"sketch_{x}") for x in "ab")
    rows = pairs.select("a", "b").join(left, "a").join(right, "b").filter(_close("n_a", "n_b", threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                differ = _bits(_words(batch.column(4)), _words(batch.column(5)))
                total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
                out = pa.record_batch([batch.column(0), batch.column(1), pa.array(differ)], names=["a", "b", "differ"])
                yield out.filter(pa.array(differ * (100 + threshold) <= total * (100 - threshold)))

    return rows.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long, differ long")


def bucket_pairs(rows: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs of documents of different components in the same bucket (bucket, rep, comp) that their sizes and sketches do
    not rule out: of each document the most similar partner per bucket is marked as best."""
    full = rows.join(sets.select("rep", "n", "sketch"), "rep").select("bucket", "rep", "n", "comp", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy() for c in range(4)] + [_words(batch.column(4))]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            last = np.searchsorted(now[0], now[0][-1])
            held = [x[last:].copy() for x in now]
            yield from _compared(*(x[:last] for x in now), threshold)
        if held is not None:
            yield from _compared(*held, threshold)

    found = full.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long, differ long")
    return found.groupBy("a", "b").agg(F.min("differ").alias("differ"))


def _compared(bucket, rep, n, comp, sketch, threshold: int) -> Iterator[pa.RecordBatch]:
    """Candidates in runs of equal buckets, which are sorted."""
    for d in range(1, len(bucket)):
        same = bucket[d:] == bucket[:-d]
        if not same.any():
            return
        same &= (comp[d:] != comp[:-d]) & (n[d:] * 100 >= n[:-d] * threshold) & (n[:-d] * 100 >= n[d:] * threshold)
        at = np.flatnonzero(same)
        for i in range(0, len(at), PAIRS_PER_STEP):
            x = at[i : i + PAIRS_PER_STEP]
            y = x + d
            differ = _bits(sketch[x], sketch[y])
            keep = differ * (100 + threshold) <= (n[x] + n[y]) * (100 - threshold)
            if keep.any():
                x, y = rep[x[keep]], rep[y[keep]]
                columns = [np.minimum(x, y), np.maximum(x, y), differ[keep]]
                yield pa.record_batch([pa.array(c) for c in columns], names=["a", "b", "differ"])


def split_buckets(rows: DataFrame, block: int) -> DataFrame:
    """Buckets (bucket, rep, comp, n_docs) above `block` documents as one bucket for each two blocks that hold different
    components; the others as they are. A component of more than a block has blocks of its own, the others share."""
    small = rows.filter(F.col("n_docs") <= block).select("bucket", "rep", "comp")
    large = rows.filter(F.col("n_docs") > block).select("bucket", "rep", "comp")
    per = large.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    own = per.filter(F.col("n") > block).withColumn("cuts", F.ceil(F.col("n") / block))
    rest = per.filter(F.col("n") <= block).groupBy("bucket").agg(F.ceil(F.sum("n") / block).alias("shared"))
    named = large.join(own.select("bucket", "comp", "cuts"), ["bucket", "comp"], "left").join(rest, "bucket", "left")
    number = F.when(F.col("cuts").isNotNull(), F.pmod(F.xxhash64("rep"), "cuts")).otherwise(F.pmod(F.xxhash64("comp"), "shared"))
    named = named.select("bucket", "rep", "comp", F.when(F.col("cuts").isNotNull(), F.col("comp")).alias("of"), number.alias("number"))
    blocks = named.select("bucket", "of", "number").distinct()
    left, right = blocks.toDF("bucket", "of", "number"), blocks.toDF("bucket", "of_2", "number_2")
    mark, mark_2 = F.struct("of", "number"), F.struct("of_2", "number_2")
    differ = ~F.coalesce(F.col("of") == F.col("of_2"), F.lit(False)) & (mark <= mark_2)
    met = left.join(right, "bucket").filter(differ).withColumn("pair", F.xxhash64("bucket", "of", "number", "of_2", "number_2"))
    sides = met.select("bucket", "of", "number", "pair").unionByName(
        met.select("bucket", F.col("of_2").alias("of"), F.col("number_2").alias("number"), "pair")
    )
    sides = sides.distinct()
    same = (F.col("l.bucket") == F.col("r.bucket")) & F.col("l.of").eqNullSafe(F.col("r.of")) & (F.col("l.number") == F.col("r.number"))
    split = named.alias("l").join(sides.alias("r"), same).select(F.col("r.pair").alias("bucket"), "l.rep", "l.comp")
    return small.unionByName(split)


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """rows with `rep` and the component of rep."""
    if labels is None:
        return rows.withColumn("comp", F.col("rep"))
    return rows.join(labels.withColumnRenamed("v", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))


def _apart(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Pairs whose ends are in different components."""
    if labels is None:
        return pairs
    joined = pairs.join(labels.toDF("a", "x"), "a", "left").join(labels.toDF("b", "y"), "b", "left")
    return joined.filter(F.coalesce("x", "a") != F.coalesce("y", "b")).select(*pairs.columns)


def similar_documents(docs: DataFrame, size: int = SIZE, threshold: int = THRESHOLD, doc_id: str = "doc_id", text: str = "text",
                      block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id (smallest id reachable by links)."""
    found = materialize(signed_sets(docs, size, threshold, doc_id, text), "sets")
    usable = found.filter("n > 0 AND doc_id IS NOT NULL")
    vertices = usable.groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("signatures").alias("signatures")
    )
    vertices = materialize(vertices, "vertices")
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("rep"), F.col(f"`{text}`").alias("text"))
    labels, links = None, []

    def settle(pairs: DataFrame) -> DataFrame | None:
        """The components after the pairs that are linked have joined theirs."""
        links.append(materialize(confirm(pairs, texts, size, threshold), "links"))
        if links[-1].isEmpty():
            return labels
        every = links[0]
        for more in links[1:]:
            every = every.unionByName(more)
        return components(every)

    signed = vertices.select(F.explode("signatures").alias("bucket"), "rep")
    buckets = signed.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.max("rep").alias("high"))
    buckets = buckets.filter("pivot <> high").drop("high")
    members = materialize(signed.join(buckets, "bucket"), "buckets")
    sets = vertices.select("rep", "n", "sketch")
    stars = members.filter("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    labels = settle(sketch_filter(stars, sets, threshold))

    rows = _labelled(members.select("bucket", "rep"), labels)
    mixed = rows.groupBy("bucket").agg(F.count("*").alias("n_docs"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    rows = materialize(rows.join(mixed.filter("low <> high").select("bucket", "n_docs"), "bucket"), "mixed")
    pairs = materialize(bucket_pairs(split_buckets(rows, block), sets, threshold), "pairs")
    pairs = materialize(pairs.join(stars, ["a", "b"], "left_anti"), "pairs")
    ends = pairs.select("a", "b", "differ", F.explode(F.array("a", "b")).alias("v"))
    best = ends.groupBy("v").agg(F.min(F.struct("differ", "a", "b")).alias("best")).select("best.a", "best.b").distinct()
    best = materialize(best, "best")
    labels = settle(best)
    labels = settle(_apart(pairs.select("a", "b").join(best, ["a", "b"], "left_anti"), labels))

    named = _labelled(vertices.select("digest", "rep"), labels).select("digest", "comp")
    known = F.col("doc_id").isNotNull()
    out = found.select("doc_id", "n", F.when(known, F.col("digest")).alias("digest")).join(named, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(known, F.coalesce("comp", "doc_id")).alias("component_id"))
