"""Exact filtered vector search, re-ranking, relations between chunks, citations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lawloom.functions import legal as L
from lawloom.functions.hooks import pair_score
from lawloom.functions.text import collapse, fold_collapsed, let, strip
from lawloom.operators.nearest import Clusters
from lawloom.operators.ordered import top_per_key
from lawloom.session import materialize
from lawloom.sources.blocks import BlockTable, slices, write_blocks

# A task holds points of this many bytes and reads the queries in blocks of this many.
SLICE_BYTES = 64 * 1024 * 1024
QUERY_BLOCK_BYTES = 8 * 1024 * 1024
FILTER_SETS = 64  # combinations of filters that reach the scan
MAX_CANDIDATES = 30
CANDIDATE_CHARS = 8000
RELATED_LIMIT = 5
FALLBACK_MODEL = "vector_score_fallback"
QUERY = ["query_id", "query_index"]


# --- vector search -----------------------------------------------------------------


def vector_topk(
    points: DataFrame,
    queries: DataFrame,
    filter_columns: tuple[str, ...] = (),
    block_bytes: int = QUERY_BLOCK_BYTES,
) -> DataFrame:
    """Exact cosine top-k: (query_id, query_index, id, score, rank).

    ``points``: id, embedding, and the filter columns; ``queries``: query_id, query_index, vector, k,
    filters (map of column to required value, may be NULL or empty).

    The queries are a written table. The points are read once: each task holds a slice of bounded bytes, reads the queries
    block by block, and keeps the best k per query and slice, so no (query, point) pairs are ever written out and more
    queries mean no more scans. Where all queries have filters, and few different ones, these reach the scan.
    Scores are rounded to 6 decimals, ties go to the smaller id.
    """
    rule = F.array_sort(F.map_entries(F.coalesce("filters", F.expr("cast(map() as map<string,string>)"))))
    asked = queries.select(*QUERY, F.col("vector").cast("array<double>").alias("vector"), F.coalesce(F.col("k").cast("int"), F.lit(0)).alias("k"), rule.alias("rule"))
    blocks = write_blocks(asked.filter("vector IS NOT NULL"), "queries")
    written = queries.sparkSession.read.schema(asked.schema).parquet(blocks.folder)
    largest, width = written.agg(F.max("k"), F.max(F.size("vector"))).first()
    corpus = points.select("id", "embedding", *[F.col(c).cast("string").alias(c) for c in filter_columns]).filter("embedding IS NOT NULL")
    corpus = _with_shared_filters(corpus, written, filter_columns)
    id_type = points.schema["id"].dataType.simpleString()
    schema = (
        f"query_id {queries.schema['query_id'].dataType.simpleString()},"
        f"query_index {queries.schema['query_index'].dataType.simpleString()},k int,id {id_type},score double"
    )
    # as many tasks as cores: each sends k rows a query, and slices bound what it holds
    corpus = corpus.coalesce(max(2, queries.sparkSession.sparkContext.defaultParallelism))
    found = corpus.mapInArrow(_searcher(blocks, max(1, block_bytes // (8 * (width or 0) + 256))), schema)
    # a literal bound first, so that Spark limits rows per query before the shuffle
    ranked = top_per_key(found, QUERY, [F.col("score").desc(), F.col("id")], largest or 0)
    return ranked.filter(F.col("rank") <= F.col("k")).drop("k")


def _with_shared_filters(corpus: DataFrame, queries: DataFrame, filter_columns: tuple[str, ...]) -> DataFrame:
    """The points that any query may see, where at most FILTER_SETS different filters say so."""
    rules = [tuple((e["key"], e["value"]) for e in r["rule"]) for r in queries.select("rule").distinct().limit(FILTER_SETS + 1).collect()]
    named = queries.select(F.explode("rule.key").alias("c")).distinct().filter(~F.col("c").isin(list(filter_columns))).limit(5).collect()
    if named:
        raise ValueError(f"no such filter columns: {sorted(r['c'] for r in named)}")
    if not rules or () in rules or len(rules) > FILTER_SETS:
        return corpus
    return corpus.filter(_any_choice(set(rules)))


def _any_choice(choices: set[tuple]) -> Column:
    out = F.lit(False)
    for choice in choices:
        must = F.lit(True)
        for column, value in choice:
            must = must & (F.col(column) == value)
        out = out | must
    return out


def _searcher(blocks: BlockTable, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task: the best k points of every query in each slice of the task's points."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE_BYTES):
            ids = pa.concat_arrays(part.column("id").chunks)
            vectors = pa.concat_arrays(part.column("embedding").chunks).flatten().to_numpy(zero_copy_only=False)
            ranks = np.empty(len(ids), np.int64)
            ranks[np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(ids))
            clusters, masks = Clusters(vectors.reshape(len(ids), -1), ranks), {}
            for block in blocks.blocks(rows):
                members: dict[tuple, list[int]] = {}
                for q, entries in enumerate(block.column("rule").to_pylist()):
                    members.setdefault(tuple((e["key"], e["value"]) for e in entries), []).append(q)
                for rule, at in members.items():
                    if rule not in masks:
                        masks = masks if len(masks) < FILTER_SETS else {}
                        masks[rule] = _mask(part, rule)
                    asked = block.take(pa.array(at))
                    queries = asked.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
                    query, point, score = clusters.best(queries, asked.column("k").to_numpy(zero_copy_only=False), masks[rule])
                    if len(query):
                        of_query = asked.select([*QUERY, "k"]).take(pa.array(query))
                        columns = [*of_query.columns, ids.take(pa.array(point)), pa.array(score)]
                        yield pa.record_batch(columns, names=[*QUERY, "k", "id", "score"])

    return search


def _mask(part: pa.Table, rule: tuple) -> np.ndarray | None:
    """Points that have the values of the rule; None for all."""
    out = None
    for column, value in rule:
        same = pc.fill_null(pc.equal(part.column(column), value), False).to_numpy()
        out = same if out is None else out & same
    return out


def with_payload(hits: DataFrame, points: DataFrame) -> DataFrame:
    """Join the stored fields back for the ranked rows only; vectors stay behind."""
    return hits.join(points.drop("embedding"), "id")


def chunk_payload(chunks: DataFrame) -> DataFrame:
    """The stored fields of a chunk next to its vector."""
    return chunks.select(
        "chunk_id", "document_id", "version_id", "chunk_type", "section_path", "title", "chunk_index",
        "total_chunks", F.col("chunk_text").alias("text"), "metadata",
    )


def embedding_text(title: Column, path: Column, text: Column) -> Column:
    head = lambda label, c: F.concat(F.lit(label), F.nullif(c, F.lit("")))
    return F.concat_ws("\n", head("Tiêu đề: ", title), head("Mục: ", path), text)


# --- candidates --------------------------------------------------------------------


def safe_float(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def result_key(
    chunk_id: Column, id_: Column, meta_chunk: Column, meta_point: Column, document: Column, path: Column, title: Column
) -> Column:
    """Identity of a hit: its chunk, else its point, else ids in the metadata, else document::path::title."""
    some = lambda c: F.nullif(c.cast("string"), F.lit(""))
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.coalesce(
        some(chunk_id), some(id_), some(meta_chunk), some(meta_point),
        F.concat_ws("::", shown(document), shown(path), shown(title)),
    )


def evaluation_key(
    id_: Column, meta_point: Column, meta_raw: Column, meta_id: Column, chunk_id: Column, meta_chunk: Column
) -> Column:
    """Identity of a hit in evaluation: the point id comes first."""
    some = lambda c: F.nullif(c.cast("string"), F.lit(""))
    return F.coalesce(
        some(id_), some(meta_point), some(meta_raw), some(meta_id), some(chunk_id), some(meta_chunk), F.lit("")
    )


def deduplicate(hits: DataFrame, key: str = "key", keep: str = "best") -> DataFrame:
    """One row per (query_id, key). ``best`` keeps the highest score, ``first`` the earliest occurrence.

    ``hits`` has query_index and rank, which order the occurrences. Adds matched_query_count.
    """
    others = [c for c in hits.columns if c not in ("query_id", key)]
    early = F.struct(-F.col("query_index"), -F.col("rank"))
    order = early if keep == "first" else F.struct(safe_float(F.col("score")), early)
    grouped = hits.groupBy("query_id", key).agg(
        F.max_by(F.struct(*others), order).alias("h"), F.count("*").alias("matched_query_count")
    )
    return grouped.select("query_id", key, "h.*", "matched_query_count")


def limit_candidates(hits: DataFrame, limit: int = MAX_CANDIDATES, key: str = "key") -> DataFrame:
    order = [safe_float(F.col("score")).desc(), F.col("query_index"), F.col("rank"), F.col(key)]
    return top_per_key(hits, ["query_id"], order, max(limit, 1), "candidate_rank")


def candidate_text(*parts: Column, max_chars: int = CANDIDATE_CHARS) -> Column:
    """Non-empty parts, one per line, first ``max_chars`` characters."""
    shown = [F.when(p != "", strip(p)) for p in parts]
    return F.left(F.concat_ws("\n", *shown), F.lit(max_chars))


def rerank(
    hits: DataFrame,
    query: Column,
    text: Column,
    top_k: int | Column,
    load: Callable | None = None,
    enabled: bool = True,
    fallback_keep: str = "first",
    model_name: str = "lexical_overlap",
    key: str = "key",
    all_hits: DataFrame | None = None,
) -> DataFrame:
    """Deduplicate, limit, score pairs, order by (pair score, vector score), keep top_k per query.

    Disabled, or with a scorer that is not available, hits keep their vector order. A query with a pair that could not
    be scored falls back as a whole, from all its hits (``all_hits`` where ``hits`` are candidates only).
    """
    order = [F.col("rerank_score").desc(), safe_float(F.col("score")).desc(), F.col("query_index"), F.col("rank"), F.col(key)]

    def by_vector(found: DataFrame) -> DataFrame:
        unique = deduplicate(found, key, fallback_keep)
        return unique.withColumn("rerank_score", safe_float(F.col("score"))).withColumn("rerank_model", F.lit(FALLBACK_MODEL))

    if not enabled:
        return top_per_key(by_vector(hits), ["query_id"], order, top_k, "final_rank")
    unique = limit_candidates(deduplicate(hits, key, "best"), key=key).drop("candidate_rank")
    scored = unique.withColumn("rerank_score", pair_score(query, text, load)).withColumn("rerank_model", F.lit(model_name))
    if load is not None:
        # Written once: the scores are costly, and both the ranking and the list of failed queries read them.
        scored = materialize(scored, "scores")
        failed = scored.groupBy("query_id").agg(F.bool_or(F.col("rerank_score").isNull()).alias("f")).filter("f").drop("f")
        fallen = by_vector((hits if all_hits is None else all_hits).join(failed, "query_id", "left_semi"))
        scored = scored.join(failed, "query_id", "left_anti").unionByName(fallen, allowMissingColumns=True)
    return top_per_key(scored, ["query_id"], order, top_k, "final_rank")


def expanded_queries(question: Column, expansions: Column) -> Column:
    """Original question first, trimmed, non-empty, distinct by folded text in order."""
    cleaned = F.filter(
        F.transform(F.concat(F.array(question), F.coalesce(expansions, F.array().cast("array<string>"))), strip),
        lambda x: x.isNotNull() & (x != ""),
    )
    keyed = F.transform(cleaned, lambda x: F.struct(fold_collapsed(x).alias("key"), x.alias("text")))
    first = F.aggregate(
        keyed,
        F.array().cast("array<struct<key:string,text:string>>"),
        lambda seen, x: F.when(F.exists(seen, lambda s: s["key"] == x["key"]), seen).otherwise(
            F.concat(seen, F.array(x))
        ),
    )
    texts = F.transform(first, lambda s: s["text"])
    return let(texts, lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(question)))


def explode_queries(questions: DataFrame, expansions: Column) -> DataFrame:
    """One row per (question, expanded query) with its position."""
    return questions.select(
        "*", F.posexplode(expanded_queries(F.col("question"), expansions)).alias("query_index", "retrieval_query")
    )


# --- related chunks ----------------------------------------------------------------

# Kinds of relation, in the order they are added.
RELATIONS = ("amendment_to_original", "original_to_amendment", "referenced_appendix")


def version_relations(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, source_rank, source_chunk_id, chunk_id, relation, position).

    An amendment hit leads to the chunk it amends; any other hit to the amendments of it. ``hits``: query_id,
    final_rank, chunk_id, is_amendment, previous_chunk_id; ``chunks``: chunk_id, is_amendment, previous_chunk_id.
    """
    base = hits.select("query_id", F.col("final_rank").alias("source_rank"), F.col("chunk_id").alias("source_chunk_id"),
                       F.col("is_amendment").alias("from_amendment"), F.col("previous_chunk_id").alias("original"))
    forward = base.filter("from_amendment AND original IS NOT NULL").join(
        chunks.select("chunk_id"), F.col("original") == F.col("chunk_id")
    )
    backward = base.filter("NOT coalesce(from_amendment, false)").join(
        chunks.filter("is_amendment").select("chunk_id", "previous_chunk_id"),
        F.col("previous_chunk_id") == F.col("source_chunk_id"),
    )
    columns = ["query_id", "source_rank", "source_chunk_id", "chunk_id"]
    return (
        forward.select(*columns, F.lit(RELATIONS[0]).alias("relation"))
        .unionByName(backward.select(*columns, F.lit(RELATIONS[1]).alias("relation")))
        .withColumn("position", F.lit(0).cast("bigint"))
    )


def appendix_numbers_in_path(path: Column, longest: Column) -> Column:
    """Every reference that the six ILIKE spellings would find in a path: the prefixes of each number after the word, up
    to the length of the longest number that is looked for."""
    found = F.regexp_extract_all(path, F.lit(r"(?iu)(?=((?:phụ lục|phu luc) ([0-9a-z]+)))"), F.lit(2))
    prefixes = F.flatten(
        F.transform(
            found,
            lambda x: F.transform(
                F.sequence(F.lit(1), F.least(F.length(x), longest)), lambda n: F.upper(F.left(x, n))
            ),
        )
    )
    return F.array_distinct(prefixes)


def appendix_relations(hits: DataFrame, chunks: DataFrame, limit: int = RELATED_LIMIT, strict: bool = False) -> DataFrame:
    """Appendix chunks of the same document that a hit's text refers to, up to ``limit`` per reference.

    By number first; references without such a chunk by their spelling in the section path. The path search
    is an equi join on (document, number prefix), so no chunk is compared with hits of other numbers.
    ``hits``: query_id, final_rank, chunk_id, document_id, reference_text; ``chunks``: chunk_id, document_id,
    chunk_kind, appendix_number, section_path.
    """
    refs = hits.select(
        "query_id",
        F.col("final_rank").alias("source_rank"),
        F.col("chunk_id").alias("source_chunk_id"),
        "document_id",
        F.posexplode(L.appendix_references(collapse(F.col("reference_text")))).alias("position", "ref"),
    )
    refs = materialize(refs, "references")  # read three times, each with a search through all texts if they were not written
    wanted = refs.select("document_id", "ref").distinct()
    appendix = chunks.filter(F.col("chunk_kind") == "appendix")
    by_number = wanted.join(
        appendix.select("document_id", F.col("appendix_number").alias("ref"), "chunk_id"), ["document_id", "ref"]
    )
    by_number = top_per_key(by_number, ["document_id", "ref"], [F.col("chunk_id")], limit, "rn")
    found = by_number
    if not strict:
        missing = wanted.join(by_number.select("document_id", "ref").distinct(), ["document_id", "ref"], "left_anti")
        spelled = missing.select(
            "document_id", "ref", F.explode(F.array_compact(F.array("ref", L.roman_to_digit(F.col("ref"))))).alias("n")
        )
        longest = spelled.groupBy("document_id").agg(F.max(F.length("n")).alias("longest")).filter("longest > 0")
        paths = appendix.join(longest, "document_id").select(
            "document_id", "chunk_id", F.explode(appendix_numbers_in_path(F.col("section_path"), F.col("longest"))).alias("n")
        )
        by_path = spelled.join(paths, ["document_id", "n"]).select("document_id", "ref", "chunk_id").distinct()
        found = by_number.unionByName(top_per_key(by_path, ["document_id", "ref"], [F.col("chunk_id")], limit, "rn"))
    return refs.join(found, ["document_id", "ref"]).select(
        "query_id", "source_rank", "source_chunk_id", "chunk_id", F.lit(RELATIONS[2]).alias("relation"),
        (F.col("position") * limit + F.col("rn")).cast("bigint").alias("position"),
    )


def append_related(hits: DataFrame, relations: DataFrame, with_position: bool = False) -> DataFrame:
    """Related chunks that are not hits yet, once per query: the earliest source and relation wins.

    ``with_position`` adds related_order, their place (from 1) among those of the query."""
    order = F.struct(
        "source_rank",
        F.array_position(F.array(*[F.lit(r) for r in RELATIONS]), F.col("relation")).alias("kind"),
        "position",
        "source_chunk_id",
    )
    unseen = relations.join(hits.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_anti")
    first = unseen.withColumn("place", order).groupBy("query_id", "chunk_id").agg(
        F.min_by(F.struct("relation", "source_chunk_id", "source_rank"), "place").alias("r"), F.min("place").alias("place")
    )
    out = first.select("query_id", "chunk_id", "r.*", F.lit("supporting").alias("source_role"), "place")
    if with_position:
        w = Window.partitionBy("query_id").orderBy("place", "chunk_id")
        out = out.withColumn("related_order", F.row_number().over(w).cast("bigint"))
    return out.drop("place")


def related_title(previous_title: Column, amendment_title: Column, doc_title: Column) -> Column:
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(some(previous_title), some(amendment_title), some(doc_title))


# --- citations ---------------------------------------------------------------------


def citations(hits: DataFrame, documents: DataFrame, latest: DataFrame, order: list[Column]) -> DataFrame:
    """Numbered sources per query with the document's type and the latest version's file.

    ``hits``: query_id, document_id, title, section_path, text, file_path, mime_type, source (may be NULL).
    """
    d = documents.select("document_id", F.col("mime_type").alias("__mime"))
    v = latest.select("document_id", F.col("source_file_path").alias("__file"))
    w = Window.partitionBy("query_id").orderBy(*order)
    joined = hits.join(d, "document_id", "left").join(v, "document_id", "left")
    file_path = F.coalesce("file_path", "__file")
    return (
        joined.withColumn("citation_id", F.row_number().over(w).cast("bigint"))
        .withColumn("source", F.coalesce("source", file_path, F.col("document_id").cast("string")))
        .withColumn("file_path", file_path)
        .withColumn("mime_type", F.coalesce("mime_type", "__mime"))
        .withColumn("preview_url", F.lit(None).cast("string"))
        .drop("__mime", "__file")
    )


SOURCE_INDENT = " " * 16


def context_block() -> Column:
    """One [SOURCE n] block; sources without text give NULL."""
    shown = lambda c: F.coalesce(F.col(c), F.lit(""))
    n = F.col("citation_id").cast("string")
    block = F.concat(
        F.lit("[SOURCE "), n, F.lit(f"]\n{SOURCE_INDENT}Title: "), shown("title"),
        F.lit(f"\n{SOURCE_INDENT}Section: "), shown("section_path"),
        F.lit(f"\n\n{SOURCE_INDENT}"), F.col("text"), F.lit(f"\n{SOURCE_INDENT}[/SOURCE "), n, F.lit("]"),
    )
    return F.when(F.col("text") != "", block)


def contexts(cited: DataFrame) -> DataFrame:
    """The context string of each query; at most top-k plus related sources go into one string."""
    return cited.withColumn("block", context_block()).groupBy("query_id").agg(
        F.coalesce(
            F.expr("listagg(block, '\\n\\n') WITHIN GROUP (ORDER BY citation_id)"), F.lit("")
        ).alias("context"),
        F.count("*").alias("sources"),
    )
