"""Near duplicates by a chosen-path set similarity join.

A document is the set of its distinct shingles of `size` words. Two documents are linked when
100 * |intersection| >= threshold * |union|; links are confirmed on the full sets, and components of links share an id.

Search. A document has `TOKENS` minwise tokens. In each of `TREES` independent trees a node chooses one token position
by a hash of its path, and for one node in four a second one; its documents go on to the child named by their token
there. Nodes of at most `SMALL` documents are compared exhaustively, larger ones branch again. Two documents with
similarity s stay together with probability s per chosen position, so the expected number of common children at 0.8 is
one or more. The chance that all trees part them at the threshold grows with the depth at which they are compared: 6e-7
at depth 3, 6e-4 at 8, 0.0019 at 10 and 0.0044 at 12 (independent tokens assumed). It falls quickly above the threshold.

Large groups of copies. Equal sets are one vertex from the start. From depth `STAR_DEPTH` on, the documents of a node
that is still large are compared with its smallest member, and confirmed links become components; then nodes of at most
`MEDIUM` documents are compared exhaustively as well, first for the most similar document of another component, then,
with what that joined, for all such documents. Nodes whose documents are all in one component are dropped, as no further
link there can matter. What is larger branches on, and at depth `DEPTH` is compared block against block, so that no
document is left out and no task holds more than two blocks. Candidate pairs are confirmed for the most similar partner
of each document first, the others only where they would join two components.

Sketches of 64 bytes, in the larger nodes then of 1024, decide which pairs are worth confirming; a linked pair fails
these tests with a probability of about one in fifty thousand at the threshold, and less above it. Nothing about all documents is collected; every step is written to the shared
folder and read back.

Defined results: a null text and one without words have an empty set and no links; a text of fewer than `size` words
is one shingle; rows with a null id are not compared, have no component and are kept; rows that share an id but not the
text are compared as separate sets under that id, repeated rows get the same result; extra columns are not carried; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawloom.llm.components import components
from lawloom.session import materialize

SIZE, THRESHOLD = 5, 80
TOKENS, SKETCH, TREES, SMALL, MEDIUM, STAR_DEPTH, DEPTH = 128, 64, 14, 64, 4096, 3, 12
WIDE = 1024
# Bytes of two sketches, and how many must be equal: at a similarity of 0.8 the mean is 51.2 of 64 with a deviation of
# 3.2, 205 of 256 with 6.4, 819 of 1024 with 12.8; the least is more than four deviations below.
STAGES = ((64, 36), (256, 177), (1024, 765))
BLOCK = 1024
KNOWN_WORDS = 200_000
RECENT_CHARS = 8_000_000  # texts whose shingles a task remembers while it confirms pairs

_MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(0, 1 << 63, WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _rng.integers(0, 1 << 63, WIDE, dtype=np.uint64)


class Shingler:
    """Sorted distinct 64-bit shingle hashes of whole texts; remembers the hashes of recent words."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        try:
            return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(self.known) > KNOWN_WORDS:
                self.known.clear()
            for w in set(words).difference(self.known):
                self.known[w] = xxhash.xxh64_intdigest(w)
            return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    def shingles(self, text: str | None) -> np.ndarray:
        """A-Z are lower-cased and words are runs without ASCII white space; both are exact on UTF-8 bytes."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        h, n = self.hashes(words), min(self.size, len(words))
        out = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            out = (out ^ h[k : k + len(out)]) * _MIX
            out ^= out >> np.uint64(31)
        return np.unique(out)


def minwise(shingles: np.ndarray, count: int = TOKENS) -> np.ndarray:
    """Minwise tokens of 16 bits."""
    least, step = np.full(count, np.iinfo(np.uint64).max, np.uint64), 262_144 // count
    for i in range(0, len(shingles), step):
        part = shingles[i : i + step, None] * _FACTORS[:count] + _TERMS[:count]
        np.minimum(least, part.min(axis=0), out=least)
    return ((least * _MIX) >> np.uint64(48)).astype("<u2")


def linked(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= threshold * (len(a) + len(b) - both)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def wide_sketches(texts: DataFrame, size: int) -> DataFrame:
    """(digest, sketch) of texts (rep, text): sketches of WIDE bytes, which begin as the short ones do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            found = [s for t in batch.column(0) if len(s := shingler.shingles(t.as_py()))]
            digests, sketches = [_digest(s) for s in found], [minwise(s, WIDE).astype(np.uint8).tobytes() for s in found]
            yield pa.record_batch([pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())], names=["digest", "sketch"])

    return texts.select("text").mapInArrow(run, "digest binary, sketch binary").dropDuplicates(["digest"])


def shingle_sets(docs: DataFrame, size: int, doc_id: str, text: str) -> DataFrame:
    """Per row: doc_id, n (set size), digest of the set, tokens and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            counts, digests, tokens, sketches = [], [], [], []
            for t in batch.column(1):
                s = shingler.shingles(t.as_py())
                m = minwise(s) if len(s) else None
                counts.append(len(s))
                digests.append(_digest(s) if len(s) else None)
                tokens.append(None if m is None else m.tobytes())
                sketches.append(None if m is None else m[:SKETCH].astype(np.uint8).tobytes())
            columns = [pa.array(counts, pa.int64()), *(pa.array(x, pa.binary()) for x in (digests, tokens, sketches))]
            yield pa.record_batch([batch.column(0), *columns], names=["doc_id", "n", "digest", "tokens", "sketch"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, digest binary, tokens binary, sketch binary")


def _children(path: Column, tokens: Column) -> Column:
    """Paths of the node's children that hold a document with these tokens."""
    first, second = (F.pmod(F.xxhash64(path, F.lit(k)), F.lit(TOKENS)).cast("int") for k in (1, 2))
    to = lambda c: F.xxhash64(path, c, F.substr(tokens, c * 2 + 1, F.lit(2)))
    more = (F.pmod(F.xxhash64(path, F.lit(3)), F.lit(4)) == 0) & (first != second)
    return F.filter(F.array(to(first), F.when(more, to(second))), lambda x: x.isNotNull())


def _compare(batches: Iterator[pa.RecordBatch], threshold: int, best_only: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of documents of different components in runs of equal paths that their sketches say may be linked."""
    held, search = None, _best_pairs if best_only else _all_pairs
    for batch in batches:
        path, rep, n, comp = (batch.column(k).to_numpy() for k in range(4))
        if not batch.num_rows:
            continue
        sketch = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        now = [path, rep, n, comp, sketch, _padded(batch.column(5))]
        if held is not None:
            width = max(held[5].shape[1], now[5].shape[1])
            held[5], now[5] = (np.pad(x[5], ((0, 0), (0, width - x[5].shape[1])), constant_values=_NO_PATH) for x in (held, now))
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        last = np.searchsorted(now[0], now[0][-1]) if len(now[0]) else 0
        held = [x[last:].copy() for x in now]
        yield from search(*(x[:last] for x in now), threshold)
    if held is not None:
        yield from search(*held, threshold)


_NO_PATH = np.iinfo(np.int64).max


def _padded(lists: pa.ListArray) -> np.ndarray:
    """Lists of paths as the rows of a matrix, filled up with a value above all paths."""
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.full((len(lists), max(1, lengths.max(initial=0))), _NO_PATH, np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy()
    return out


def _near(path, n, comp, sketch, threshold) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(rows x, distance d, equal sketch bytes): rows x and x + d may be linked."""
    for d in range(1, len(path)):
        same = path[d:] == path[:-d]
        if not same.any():
            return
        same &= (comp[d:] != comp[:-d]) & (n[d:] * 100 >= n[:-d] * threshold) & (n[:-d] * 100 >= n[d:] * threshold)
        at = np.flatnonzero(same)
        for i in range(0, len(at), 50_000):
            x = at[i : i + 50_000]
            for width, least in STAGES:
                if width <= sketch.shape[1] and len(x):
                    equal = (sketch[x, :width] == sketch[x + d, :width]).sum(axis=1)
                    x, equal = x[equal >= least], equal[equal >= least]
            if len(x):
                yield x, d, equal


def _pair_batch(x: np.ndarray, y: np.ndarray, equal: np.ndarray) -> pa.RecordBatch:
    columns = [np.minimum(x, y), np.maximum(x, y), equal.astype(np.int32)]
    return pa.record_batch([pa.array(c) for c in columns], names=["a", "b", "equal"])


def _all_pairs(path, rep, n, comp, sketch, others, threshold) -> Iterator[pa.RecordBatch]:
    """Every pair, in the first by path of the nodes that both are in (where `others` names them)."""
    for x, d, equal in _near(path, n, comp, sketch, threshold):
        for i in range(0, len(x), 4096):
            at = x[i : i + 4096]
            a, b = others[at], others[at + d]
            before = ((a[:, :, None] == b[:, None, :]).any(axis=2) & (a < path[at][:, None])).any(axis=1)
            if not before.all():
                at = at[~before]
                yield _pair_batch(rep[at], rep[at + d], equal[i : i + 4096][~before])


def _best_pairs(path, rep, n, comp, sketch, others, threshold) -> Iterator[pa.RecordBatch]:
    """Each row with its most similar one only."""
    best, partner = np.zeros(len(path), np.int64), np.zeros(len(path), np.int64)
    for x, d, equal in _near(path, n, comp, sketch, threshold):
        for row, other in ((x, x + d), (x + d, x)):
            up = equal > best[row]
            best[row[up]], partner[row[up]] = equal[up], other[up]
    found = np.flatnonzero(best)
    if len(found):
        yield _pair_batch(rep[found], rep[partner[found]], best[found])


def _node_pairs(nodes: DataFrame, sets: DataFrame, threshold: int, best_only: bool = False, once: bool = False) -> DataFrame:
    """Candidate pairs of the documents of each node (path, rep, comp), compared exhaustively. With `once`, rows carry the
    nodes of their document, and a pair that is together in several nodes is written in one of them."""
    rows = nodes.select("path", "rep", "comp").join(sets.select("rep", "n", "sketch"), "rep")
    if once:
        rows = rows.join(nodes.groupBy("rep").agg(F.collect_set("path").alias("others")), "rep")
    else:
        rows = rows.withColumn("others", F.expr("cast(array() as array<bigint>)"))
    rows = rows.select("path", "rep", "n", "comp", "sketch", "others").repartition("path").sortWithinPartitions("path")
    found = rows.mapInArrow(lambda b: _compare(b, threshold, best_only), "a long, b long, equal int")
    return found.groupBy("a", "b").agg(F.max("equal").alias("equal"))


def _star_pairs(nodes: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """For documents of large nodes (path, rep, comp, pivot): the most similar of their nodes' smallest members."""
    wide = sets.select("rep", "n", "sketch")
    pivots = nodes.select("path", "pivot").distinct().join(wide.toDF("pivot", "pivot_n", "pivot_sketch"), "pivot")
    rows = nodes.filter("rep <> pivot").join(pivots.drop("pivot"), "path").join(wide, "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SKETCH) for k in (2, 3))
                equal = (x == y).sum(axis=1).astype(np.int32)
                out = pa.record_batch([batch.column(0), batch.column(1), pa.array(equal)], names=["rep", "pivot", "equal"])
                yield out.filter(pa.array(equal >= STAGES[0][1]))

    close = (F.col("n") * 100 >= F.col("pivot_n") * threshold) & (F.col("pivot_n") * 100 >= F.col("n") * threshold)
    near = rows.filter(close).select("rep", "pivot", "sketch", "pivot_sketch").mapInArrow(run, "rep long, pivot long, equal int")
    best = near.groupBy("rep").agg(F.max(F.struct("equal", (-F.col("pivot")).alias("p"))).alias("best"))
    return best.select((-F.col("best.p")).alias("a"), F.col("rep").alias("b"))


def confirm(pairs: DataFrame, docs: DataFrame, size: int, threshold: int) -> DataFrame:
    """The pairs (a, b) that are linked, on the full sets of docs (rep, text)."""
    rows = pairs.select("a", "b").join(docs.toDF("a", "text_a"), "a").join(docs.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, recent, held = Shingler(size), {}, 0

        def shingles(text: str) -> np.ndarray:
            nonlocal held
            if text not in recent:
                if held > RECENT_CHARS:
                    recent.clear()
                    held = 0
                recent[text] = shingler.shingles(text)
                held += len(text)
            return recent[text]

        for batch in batches:
            pairs = zip(batch.column(2), batch.column(3), strict=True)
            same = [linked(shingles(x.as_py()), shingles(y.as_py()), threshold) for x, y in pairs]
            yield batch.select([0, 1]).filter(pa.array(same, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long").distinct()


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """rows with `rep` and the component of rep."""
    if labels is None:
        return rows.withColumn("comp", F.col("rep"))
    return rows.join(labels.withColumnRenamed("v", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))


def _apart(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Pairs whose ends are in different components."""
    if labels is None:
        return pairs
    a, b = labels.toDF("a", "x"), labels.toDF("b", "y")
    joined = pairs.join(a, "a", "left").join(b, "b", "left")
    return joined.filter(F.coalesce("x", "a") != F.coalesce("y", "b")).select(*pairs.columns)


def near_duplicates(docs: DataFrame, size: int = SIZE, threshold: int = THRESHOLD, doc_id: str = "doc_id", text: str = "text",
                    small: int = SMALL, medium: int = MEDIUM, trees: int = TREES, star_depth: int = STAR_DEPTH, depth: int = DEPTH) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable) and kept (it is its own component's id)."""
    found = materialize(shingle_sets(docs, size, doc_id, text), "sets")
    usable = found.filter("n > 0 AND doc_id IS NOT NULL")
    group = usable.groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch")
    )
    group = materialize(group, "vertices")
    sets = group.select("digest", "rep", "n", "tokens", "sketch")
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("rep"), F.col(f"`{text}`").alias("text"))

    labels, links, candidates = None, [], []

    def settle(pairs: DataFrame) -> DataFrame | None:
        """The components after the pairs that are linked have joined theirs."""
        links.append(materialize(confirm(pairs, texts, size, threshold), "links"))
        return labels if links[-1].isEmpty() else components(_union(links))

    roots = F.explode(F.transform(F.sequence(F.lit(1), F.lit(trees)), lambda r: F.xxhash64(F.lit("root"), r)))
    nodes = sets.select("rep", "tokens", roots.alias("root")).select(F.explode(_children(F.col("root"), F.col("tokens"))).alias("path"), "rep")
    nodes = nodes.withColumn("comp", F.col("rep"))
    for level in range(1, depth + 1):
        nodes = materialize(nodes, "nodes")
        sizes = nodes.groupBy("path").agg(F.count("*").alias("n_docs"), F.min("rep").alias("pivot"),
                                          F.min("comp").alias("low"), F.max("comp").alias("high"))
        mixed = sizes.filter("low <> high").select("path", "n_docs", "pivot")
        nodes = materialize(nodes.join(mixed, "path"), "nodes")
        candidates.append(materialize(_node_pairs(nodes.filter(F.col("n_docs") <= small), sets, threshold), "pairs"))
        large = nodes.filter(F.col("n_docs") > small)
        if large.isEmpty():
            break
        if level >= star_depth:
            labels = settle(_apart(_star_pairs(large, sets, threshold), labels))
            near = large.filter(F.col("n_docs") <= medium).drop("comp")
            # Wide sketches, only for the documents of these nodes, leave few pairs to confirm on the sets.
            wide = materialize(wide_sketches(texts.join(near.select("rep").distinct(), "rep"), size), "wide")
            wide = sets.select("digest", "rep", "n").join(wide, "digest").select("rep", "n", "sketch")
            labels = settle(_node_pairs(_labelled(near, labels), wide, threshold, best_only=True))
            labels = settle(_node_pairs(_labelled(near, labels), wide, threshold, once=True))
            large = large.filter(F.col("n_docs") > medium)
            if large.isEmpty():
                break
        if level == depth:
            blocks = _blocks(_labelled(large.drop("comp"), labels))
            candidates.append(materialize(_node_pairs(blocks, sets, threshold), "pairs"))
            break
        onward = large.select("path", "rep").join(sets.select("rep", "tokens"), "rep")
        onward = onward.select(F.explode(_children(F.col("path"), F.col("tokens"))).alias("path"), "rep")
        nodes = _labelled(onward.distinct(), labels)
    pairs = _apart(_union(candidates).groupBy("a", "b").agg(F.max("equal").alias("equal")), labels)
    pairs = materialize(pairs, "pairs")
    ends = pairs.select("a", "b", "equal", F.explode(F.array("a", "b")).alias("v"))
    rank = F.struct("equal", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))
    best = ends.groupBy("v").agg(F.max(rank).alias("best")).select((-F.col("best.a")).alias("a"), (-F.col("best.b")).alias("b")).distinct()
    best = materialize(best, "best")
    labels = settle(best)
    labels = settle(_apart(pairs.select("a", "b").join(best, ["a", "b"], "left_anti"), labels))
    named = _labelled(group.select("digest", "rep"), labels).select("digest", "comp")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    out = found.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(named, "digest", "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _blocks(nodes: DataFrame) -> DataFrame:
    """Nodes (path, rep, comp, n_docs) as one node for each two blocks of their documents."""
    count = F.ceil(F.col("n_docs") / BLOCK).cast("int")
    rows = nodes.withColumn("count", count).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("count")).cast("int"))
    rows = rows.select("path", "rep", "comp", "block", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("other"))
    path = F.xxhash64("path", F.least("block", "other"), F.greatest("block", "other"))
    return rows.select(path.alias("path"), "rep", "comp")


def keep_first(docs: DataFrame, size: int = SIZE, threshold: int = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are the first of their component, unchanged; rows with a null id stay."""
    judged = near_duplicates(docs, size, threshold, doc_id, text)
    gone = judged.filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[doc_id] == gone["_gone"], "left_anti")
