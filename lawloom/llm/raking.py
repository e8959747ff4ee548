"""Mixing sources to target weights: iterative proportional fitting of token weights to the marginals of source, language
and topic, then sampling of documents by the calibrated probabilities.

Every cell (source, language, topic) has the sum of its documents' tokens. The fit finds a factor per source, language
and topic, so that the weighted sums have the target shares in each of the three. Sources are many and stay distributed:
their factors are worked out from their own row, and one small aggregate over languages x topics comes back per round.
A document's probability is its cell's weight over a reference weight, 1 at most, and its draw a hash of its id, so the
sample is the same on every run. The reference is the least weight above which cells hold no more than a share `TRIM` of
the tokens: these cells are kept whole, so that a few rare cells do not thin out all others, and the expected tokens of
the sample have the fitted shares but for that share. With `trim=0` it is the largest weight, and the shares are exact.

Default targets are the observed shares to the power of `TEMPER`, which lifts small groups and lowers large ones.
Defined results: null sources, languages and topics are groups named ""; a text without words has no tokens, weighs
nothing in the fit, and gets the probability of its cell, or 1 where the cell weighs nothing; a null id draws by a hash
of the text, so rows of null id and equal text draw alike; equal ids draw alike; an empty table gives no rows. Target values that no document has are left out and the
others scaled up; result columns replace input columns of the same name.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawloom.session import materialize

TEMPER = 0.9
TOPICS, SUBJECT_LETTERS = 8, 6
ROUNDS, TOLERANCE = 100, 1e-7
TRIM, BINS = 0.01, 64  # share of the tokens in cells that are kept whole; steps of the reference per factor of two
MAX_CELLS = 200_000  # languages x topics, which the driver holds
BROADCAST_SOURCES = 100_000  # more sources are joined by a shuffle


@dataclass(frozen=True)
class Fit:
    """Factors by language and topic, a table of factors by source, and the weight that stands for probability 1."""

    langs: dict[str, float]
    topics: dict[str, float]
    sources: DataFrame
    reference: float
    rounds: int


def subject(words: list[str]) -> str | None:
    """The most frequent word of at least SUBJECT_LETTERS characters, the first by name among equals."""
    counts = Counter(w for w in words if len(w) >= SUBJECT_LETTERS)
    return min(counts, key=lambda w: (-counts[w], w)) if counts else None


def topic_of(words: list[str]) -> str:
    """Topic for tables without one: a bucket of the text's subject word."""
    word = subject(words)
    return "t-none" if word is None else f"t{zlib.crc32(word.encode('utf-8', 'replace')) % TOPICS}"


def with_tokens_and_topic(docs: DataFrame, text: str = "text", carry: list[str] | None = None, topic: str | None = None) -> DataFrame:
    """`row` (a struct of the carried columns), n_tokens (words of the whole text) and topic: the carried column of that
    name, or without one the bucket of the text's subject word."""
    names = docs.columns if carry is None else carry
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [(t.as_py() or "").lower().split() for t in batch.column(1)]
            topics = [topic_of(w) if topic is None else None for w in split]
            columns = [pa.array([len(w) for w in split], pa.int64()), pa.array(topics, pa.string())]
            yield pa.record_batch([batch.column(0), *columns], names=["row", "n_tokens", "topic"])

    read = rows.mapInArrow(run, rows.select("row").schema.toDDL() + ", n_tokens long, topic string")
    return read if topic is None else read.withColumn("topic", _group(topic))


def tempered(sums: dict[str, float], power: float = TEMPER) -> dict[str, float]:
    """Shares of sums to a power."""
    raised = {k: v**power for k, v in sums.items() if v > 0}
    total = sum(raised.values()) or 1.0
    return {k: v / total for k, v in raised.items()}


def _shares(targets: dict[str, float], present: dict[str, float]) -> dict[str, float]:
    kept = {k: v for k, v in targets.items() if present.get(k, 0) > 0 and v > 0}
    total = sum(kept.values()) or 1.0
    return {k: v / total for k, v in kept.items()}


def rake(cells: DataFrame, langs: dict[str, float] | None = None, topics: dict[str, float] | None = None,
         sources: DataFrame | None = None, power: float = TEMPER, rounds: int = ROUNDS, trim: float = TRIM) -> Fit:
    """Fit cells (source, lang, topic, w) to target shares; `sources` has (source, target). Targets default to tempered
    shares."""
    cells = cells.filter("w > 0")
    by_lang = {r[0]: r[1] for r in cells.groupBy("lang").agg(F.sum("w")).collect()}
    by_topic = {r[0]: r[1] for r in cells.groupBy("topic").agg(F.sum("w")).collect()}
    if len(by_lang) * len(by_topic) > MAX_CELLS:
        raise ValueError(f"{len(by_lang)} languages x {len(by_topic)} topics are too many to fit")
    to_lang = _shares(langs if langs is not None else tempered(by_lang, power), by_lang)
    to_topic = _shares(topics if topics is not None else tempered(by_topic, power), by_topic)
    names_l, names_t = sorted(to_lang), sorted(to_topic)
    place = F.create_map(*[F.lit(x) for i, k in enumerate(names_l) for x in (k, i)]) if names_l else F.lit(None)
    place_t = F.create_map(*[F.lit(x) for i, k in enumerate(names_t) for x in (k, i)]) if names_t else F.lit(None)
    inside = cells.filter(F.col("lang").isin(names_l) & F.col("topic").isin(names_t))
    at = F.element_at(place, F.col("lang")) * len(names_t) + F.element_at(place_t, F.col("topic")) if names_l and names_t else F.lit(0)
    per_source = inside.groupBy("source").agg(F.sum("w").alias("total"), F.collect_list(F.struct(at.alias("at"), F.col("w").cast("double").alias("w"))).alias("cells"))
    if sources is None:
        per_source = per_source.withColumn("target", F.pow("total", F.lit(power)))
    else:
        per_source = per_source.join(sources.select("source", "target"), "source").filter("target > 0")
    per_source = materialize(per_source.select("source", "target", F.col("cells.at").alias("at"), F.col("cells.w").alias("w")), "sources")
    scale = per_source.agg(F.sum("target")).first()[0] or 1.0
    b, c = np.ones(len(names_l)), np.ones(len(names_t))
    goal_l, goal_t = np.array([to_lang[k] for k in names_l]), np.array([to_topic[k] for k in names_t])
    done = 0
    for done in range(1, rounds + 1):
        sums = _weighted(per_source, b, c, scale)
        seen = np.zeros(len(b) * len(c))
        for r in sums.groupBy("at").agg(F.sum("v").alias("v")).collect():
            seen[r["at"]] = r["v"]
        seen = seen.reshape(len(b), len(c))
        error = max(np.abs(seen.sum(1) - goal_l).max(initial=0), np.abs(seen.sum(0) - goal_t).max(initial=0))
        if error < TOLERANCE:
            break
        up = np.divide(goal_l, seen.sum(1), out=np.ones_like(b), where=seen.sum(1) > 0)
        b, seen = b * up, seen * up[:, None]
        c = c * np.divide(goal_t, seen.sum(0), out=np.ones_like(c), where=seen.sum(0) > 0)
    factors = _factors(per_source, b, c, scale)
    reference = factors.agg(F.max("most")).first()[0] or 1.0
    held, bins = 0.0, sorted(_bins(per_source, b, c, scale).groupBy("bin").agg(F.sum("w")).collect(), reverse=True)
    total = sum(w for _, w in bins)
    for place, w in bins:
        if held + w > trim * total:
            reference = min(reference, 2.0 ** ((place + 1) / BINS))
            break
        held += w
    return Fit(dict(zip(names_l, b.tolist(), strict=True)), dict(zip(names_t, c.tolist(), strict=True)),
               factors.select("source", "factor"), reference, done)


def _by_source(per_source: DataFrame, b: np.ndarray, c: np.ndarray, scale: float, out, schema: str) -> DataFrame:
    outer = np.outer(b, c).ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, target, at, w in zip(*batch.columns, strict=True):
                at, w = np.array(at.as_py(), np.int64), np.array(w.as_py(), float)
                factor = target.as_py() / scale / float((w * outer[at]).sum())
                yield out(source, factor, at, w, outer)

    return per_source.mapInArrow(run, schema)


def _weighted(per_source: DataFrame, b: np.ndarray, c: np.ndarray, scale: float) -> DataFrame:
    def out(_, factor, at, w, outer):
        return pa.record_batch([pa.array(at), pa.array(factor * w * outer[at])], names=["at", "v"])

    return _by_source(per_source, b, c, scale, out, "at long, v double")


def _bins(per_source: DataFrame, b: np.ndarray, c: np.ndarray, scale: float) -> DataFrame:
    """Tokens by the logarithm of their cell's weight; a few hundred bins in all."""

    def out(_, factor, at, w, outer):
        return pa.record_batch([pa.array(np.floor(BINS * np.log2(factor * outer[at])).astype(np.int64)), pa.array(w)], names=["bin", "w"])

    return _by_source(per_source, b, c, scale, out, "bin long, w double")


def _factors(per_source: DataFrame, b: np.ndarray, c: np.ndarray, scale: float) -> DataFrame:
    def out(source, factor, at, w, outer):
        names = ["source", "factor", "most"]
        return pa.record_batch([pa.array([source.as_py()], pa.string()), pa.array([factor]), pa.array([factor * float(outer[at].max())])], names=names)

    return materialize(_by_source(per_source, b, c, scale, out, "source string, factor double, most double"), "factors")


def _group(name: str) -> Column:
    return F.coalesce(F.col(f"row.`{name}`").cast("string"), F.lit(""))


def sample_to_targets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang",
                      carry: list[str] | None = None, power: float = TEMPER, seed: int = 0, topic: str | None = None,
                      **targets) -> DataFrame:
    """All rows: `row` (a struct of the carried columns), topic, n_tokens, probability and sampled. `topic` names a column
    of topics; without it the topic is one of TOPICS hash buckets of the text's subject word, or t-none."""
    need = list(dict.fromkeys([doc_id, source, lang, *([] if topic is None else [topic])]))
    read = with_tokens_and_topic(docs, text, need, topic)
    groups = [_group(source).alias("source"), _group(lang).alias("lang"), "topic"]
    cells = materialize(read.groupBy(*groups).agg(F.sum("n_tokens").alias("w")), "cells")
    fit = rake(cells, power=power, **targets)
    names = docs.columns if carry is None else carry
    # xxhash64 skips nulls and is never null itself, so a null id must be asked for.
    drawn_by = F.when(F.col(f"`{doc_id}`").isNull(), F.col(f"`{text}`")).otherwise(F.col(f"`{doc_id}`").cast("string"))
    drawn = "_draw"
    while drawn in (c.lower() for c in docs.columns):  # a column of that name is the caller's
        drawn += "_"
    rows = with_tokens_and_topic(docs.withColumn(drawn, F.xxhash64(F.lit(seed), drawn_by)),
                                 text, list(dict.fromkeys([*names, *need, drawn])), topic)
    rows = rows.withColumn("_source", _group(source)).withColumn("_lang", _group(lang))
    factors = fit.sources.withColumnRenamed("source", "_source")
    # The source table is broadcast only while it is known to be small.
    rows = rows.join(F.broadcast(factors) if factors.count() <= BROADCAST_SOURCES else factors, "_source", "left")
    weight = F.col("factor") * _lookup(fit.langs, F.col("_lang")) * _lookup(fit.topics, F.col("topic"))
    probability = F.coalesce(F.least(weight / F.lit(fit.reference), F.lit(1.0)), F.lit(1.0))
    draw = F.col(f"row.{drawn}").cast("double") / F.lit(2.0**64) + F.lit(0.5)
    return rows.select(
        F.struct(*[F.col(f"row.`{c}`") for c in names]).alias("row"), "topic", "n_tokens",
        probability.alias("probability"), (draw < probability).alias("sampled"),
    )


def _lookup(values: dict[str, float], key: Column) -> Column:
    if not values:
        return F.lit(None).cast("double")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)
