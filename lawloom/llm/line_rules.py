"""Quality rules: lines that many documents of a host share are removed, and documents that lose most of their words
with them are rejected. Only DataFrame functions on the main path.

A line counts once per distinct text, so exact copies do not make their own lines frequent. The first document of the
host that holds a line keeps it, so a passage never vanishes with all its copies.

Defined results: a null text has no words and no lines; lines without a word are never counted; a null host is a host
of its own; rows equal in id and text get the same verdict; a null id is judged like any other row. Extra columns of
the input are carried through; names that clash with a result column are replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawloom.llm.columns import SPACE_RUN, SPACES, ascii_lower, bind, words

WINDOW = 8


@dataclass(frozen=True)
class LineLimits:
    """A line is removed when more than `min_texts` distinct texts and more than `host_percent` of the host's distinct
    texts hold it. A document is rejected when less than `left_percent` of its words are left."""

    min_texts: int = 10
    host_percent: int = 10
    left_percent: int = 30


def text_rules(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    text = F.coalesce(text, F.lit(""))
    return bind(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            duplicate_lines(text).alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def duplicate_lines(text: Column) -> Column:
    return bind(lines_with_words(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeated_words(w: Column) -> Column:
    """Words inside 8-word windows that the text holds twice or more, the first of them included."""

    def covered(hashes: Column) -> Column:
        marked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = bind(
            marked,
            lambda s: F.filter(
                s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]).eqNullSafe(True) | (x["h"] == F.get(s, i + 1)["h"]).eqNullSafe(True)
            ),
        )
        places = F.sort_array(F.transform(again, lambda x: x["i"]))
        return bind(
            places,
            lambda p: F.aggregate(
                F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
                F.lit(0),
                lambda a, x: a + x,
            ),
        )

    def windows(v: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(v) - WINDOW + 1, F.lit(1)))
        return F.transform(at, lambda i: F.xxhash64(F.slice(v, i, WINDOW)))

    def found(v: Column) -> Column:
        again = bind(windows(v), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
        return F.when(F.size(v) > WINDOW, again).otherwise(0).cast("long")

    return bind(w, found)


def normal_line(line: Column) -> Column:
    """ASCII lower case, digits as 0, single spaces."""
    plain = F.regexp_replace(F.btrim(ascii_lower(line), F.lit(SPACES)), SPACE_RUN, " ")
    return F.regexp_replace(plain, "[0-9]", "0")


def _lines(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """One row per line with a word: row key, host key, line hash, words of the line."""
    lines = F.transform(
        lines_with_words(F.col(f"`{text}`")),
        lambda x: F.struct(F.xxhash64(normal_line(x)).alias("line"), F.size(words(x)).alias("n")),
    )
    return docs.select(
        F.col(f"`{doc_id}`").alias("id"), F.xxhash64(f"`{text}`").alias("body"), F.xxhash64(f"`{host}`").alias("host"), F.explode(lines).alias("x")
    ).select("id", "body", "host", "x.line", "x.n")


def frequent_lines(docs: DataFrame, doc_id="doc_id", text="text", host="source", limits: LineLimits = LineLimits()) -> DataFrame:
    """Lines above the limits per host: host and line hash, number of distinct texts, and the document that keeps it."""
    held = _lines(docs, doc_id, text, host)
    counted = held.groupBy("host", "line").agg(F.count_distinct("body").alias("n_texts"), F.min("id").alias("keeper"))
    hosts = docs.groupBy(F.xxhash64(host).alias("host")).agg(F.count_distinct(F.xxhash64(text)).alias("host_texts"))
    return (
        counted.filter(F.col("n_texts") > limits.min_texts)
        .join(hosts, "host")
        .filter(F.col("n_texts") * 100 > F.col("host_texts") * limits.host_percent)
        .select("host", "line", "n_texts", "keeper")
    )


def judge_documents(docs: DataFrame, doc_id="doc_id", text="text", host="source", limits: LineLimits = LineLimits()) -> DataFrame:
    """All rows with the text rules, `base_failed`, `n_removed_words` and `kept`."""
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept")
    names = [c for c in docs.columns if c.lower() not in added]
    return _judged(docs, names, doc_id, text, host, limits, F.sum("n").alias("gone")).select("row.*", "rules.*", *added[5:])


def _judged(docs: DataFrame, names: list[str], doc_id: str, text: str, host: str, limits: LineLimits, *sums: Column) -> DataFrame:
    """All rows: `row` (a struct of the named columns), `text`, `rules`, the verdict, and the aggregates of their lines
    above the limits; `gone`, the words of these lines, must be among them."""
    removed = (
        _lines(docs, doc_id, text, host)
        .join(frequent_lines(docs, doc_id, text, host, limits), ["host", "line"])
        .filter(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("id", "body")
        .agg(*sums)
    )
    more = [c for c in removed.columns if c not in ("id", "body", "gone")]
    rows = docs.groupBy(F.col(doc_id).alias("id"), F.xxhash64(text).alias("body")).agg(F.count("*").alias("rows"))
    removed = removed.join(
        rows, removed["id"].eqNullSafe(rows["id"]) & (removed["body"] == rows["body"])
    ).select(removed["id"], removed["body"], (F.col("gone") / F.col("rows")).cast("long").alias("gone"), *more)
    based = _rows(docs, names, doc_id, text).withColumn("rules", text_rules(F.col("text")))
    failed = (F.col("rules.n_words") < 20) | (100 * F.col("rules.n_repeat_words") > 30 * F.col("rules.n_words"))
    gone = F.coalesce(F.col("gone"), F.lit(0))
    enough = 100 * (F.col("rules.n_words") - gone) >= limits.left_percent * F.col("rules.n_words")
    joined = based.join(removed, based["row_id"].eqNullSafe(removed["id"]) & (based["row_body"] == removed["body"]), "left")
    return joined.select(
        "row", "text", "rules", failed.alias("base_failed"), gone.alias("n_removed_words"), (~failed & enough).alias("kept"), *more
    )


def _rows(docs: DataFrame, names: list[str], doc_id: str, text: str) -> DataFrame:
    """The named columns as one struct, so that no name can clash, beside the row's key and text."""
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    return docs.select(row, F.col(f"`{doc_id}`").alias("row_id"), F.xxhash64(f"`{text}`").alias("row_body"), F.col(f"`{text}`").alias("text"))


def strip_frequent_lines(docs: DataFrame, doc_id="doc_id", text="text", host="source", limits: LineLimits = LineLimits()) -> DataFrame:
    """Kept documents, their texts without the lines above the limits; other columns as they are."""
    judged = _judged(docs, docs.columns, doc_id, text, host, limits, F.sum("n").alias("gone"), F.collect_set("line").alias("gone_lines"))
    lines = F.split(F.col("text"), "\n")
    left = F.array_join(F.filter(lines, lambda x: ~F.array_contains(F.col("gone_lines"), F.xxhash64(normal_line(x)))), "\n")
    cleaned = F.when(F.col("gone_lines").isNull(), F.col("text")).otherwise(left)
    return judged.filter("kept").select(*[cleaned.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
