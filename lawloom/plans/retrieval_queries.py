"""Registered queries: search, ranking, relations, routing, prompts, model hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lawloom import session
from lawloom.functions import hooks as H
from lawloom.functions import legal as L
from lawloom.functions import text as T
from lawloom.operators import retrieval as R
from lawloom.operators import routing as Q
from lawloom.operators import versions as V
from lawloom.plans import answer as A
from lawloom.plans import ingest as N
from lawloom.plans import inputs as I
from lawloom.plans.registry import query
from lawloom.plans.text_queries import chunk_table

FILTERS = ("chunk_kind", "is_amendment", "article_number")


def unfiltered(spark, sf_dir, k=8):
    return I.query_vectors(spark, sf_dir, k).withColumn("filters", F.lit(None).cast("map<string,string>"))


def hits(spark, sf_dir):
    found = R.vector_topk(I.points(spark, sf_dir), unfiltered(spark, sf_dir))
    return found.withColumn("key", F.col("id"))


@query
def ret_1_embeddings(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents").select("doc_id", "text")
    e = H.embed(d, "text", dim=64)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return e.select("doc_id", F.size("embedding").alias("dim"), F.round(norm, 3).alias("norm"))


@query
def ret_2_embedding_text(spark, sf_dir):
    c = chunk_table(spark, sf_dir)
    text = R.embedding_text(F.col("title"), F.col("section_path"), F.col("chunk_text"))
    return c.select("chunk_id", text.alias("text"))


@query
def ret_3_payload(spark, sf_dir):
    p = R.chunk_payload(chunk_table(spark, sf_dir))
    return p.select("chunk_id", "document_id", "version_id", "chunk_type", "section_path", "title", "chunk_index",
                    "total_chunks", F.length("text").alias("chars"), "metadata.chunk_kind")


@query
def ret_4_vector_topk(spark, sf_dir):
    return hits(spark, sf_dir).drop("key")


@query
def ret_5_filtered_topk(spark, sf_dir):
    return R.vector_topk(I.points(spark, sf_dir), I.query_vectors(spark, sf_dir), FILTERS)


@query
def ret_6_expanded_hits(spark, sf_dir):
    """All hits of all expanded queries with their payload."""
    found = R.with_payload(hits(spark, sf_dir).drop("key"), I.points(spark, sf_dir))
    return found.select("query_id", "query_index", "rank", "id", "document_id", "chunk_kind", "source")


@query
def ret_7_best_per_chunk(spark, sf_dir):
    return R.deduplicate(hits(spark, sf_dir)).select("query_id", "id", "score", "matched_query_count")


@query
def ret_8_first_per_chunk(spark, sf_dir):
    return R.deduplicate(hits(spark, sf_dir), keep="first").select("query_id", "id", "query_index", "rank", "score")


@query
def ret_9_result_keys(spark, sf_dir):
    p = I.points(spark, sf_dir)
    own = F.when(F.col("id") % 2 == 0, F.col("id"))
    meta = F.when(F.col("id") % 3 == 0, F.concat(F.lit("m"), F.col("id").cast("string")))
    none, empty = F.lit(None).cast("string"), F.lit("")
    key = R.result_key(own, empty, meta, none, F.col("document_id"), F.col("lang"), F.col("source"))
    return p.select("id", key.alias("key"), R.evaluation_key(empty, none, none, meta, own, none).alias("evaluation_key"))


@query
def ret_10_candidates(spark, sf_dir):
    found = R.vector_topk(I.points(spark, sf_dir), unfiltered(spark, sf_dir, 20)).withColumn("key", F.col("id"))
    out = R.limit_candidates(R.deduplicate(found))
    return out.select("query_id", "id", "candidate_rank")


@query
def ret_11_candidate_text(spark, sf_dir):
    p = I.points(spark, sf_dir)
    text = R.candidate_text(F.col("source"), F.col("lang"), F.lit(""), F.lit(None).cast("string"), F.col("article_number"), F.col("text"))
    return p.select("id", text.alias("candidate"))


@query
def ret_12_reranked(spark, sf_dir):
    """Pairs of a label's article number and hit texts scored by word overlap."""
    p = I.points(spark, sf_dir).select("id", "source", "lang", "text", "chunk_kind")
    found = hits(spark, sf_dir).join(p, "id")
    question = F.concat_ws(" ", "lang", F.lit("the la der de"), "chunk_kind")
    text = R.candidate_text(F.col("source"), F.col("lang"), F.col("text"))
    out = R.rerank(found, question, text, 5)
    return out.select("query_id", "id", "final_rank", F.round("rerank_score", 6).alias("rerank_score"), "rerank_model")


@query
def ret_13_vector_fallback(spark, sf_dir):
    out = R.rerank(hits(spark, sf_dir), F.lit(""), F.lit(""), 5, enabled=False)
    return out.select("query_id", "id", "final_rank", "rerank_score", "rerank_model")


@query
def ret_14_safe_float(spark, sf_dir):
    e = I.table(spark, sf_dir, "events")
    mixed = F.expr("CASE event_id % 3 WHEN 0 THEN CAST(value AS string) WHEN 1 THEN event_type END")
    return e.select("event_id", R.safe_float(mixed).alias("number"))


@query
def ret_15_expanded_queries(spark, sf_dir):
    """Each question with its own text again, lower case, and each of its sentences."""
    c = I.table(spark, sf_dir, "conversations")
    sentences = F.concat(F.array(F.lower("text"), F.lit(" "), F.concat(F.lit(" "), "text")), F.split("text", "[.] "))
    out = R.expanded_queries(F.col("text"), sentences)
    return c.select("conv_id", "turn", F.size(out).alias("n"), F.array_join(out, "|").alias("queries"))


def linked_chunks(spark, sf_dir):
    c = chunk_table(spark, sf_dir)
    flat = c.select(
        "chunk_id", "document_id", "version_id", "chunk_index", "chunk_text", "section_path",
        F.col("metadata.article_number").alias("article_number"),
        F.col("metadata.target_article_number").alias("target_article_number"),
        F.col("metadata.is_amendment").alias("is_amendment"),
        F.col("metadata.chunk_kind").alias("chunk_kind"),
        F.col("metadata.appendix_number").alias("appendix_number"),
    )
    stored = session.materialize(flat, "chunks")
    return session.materialize(V.annotate_previous(stored, I.versions(spark, sf_dir)), "linked")


def chunk_hits(linked):
    """Every chunk of the corpus as the one hit of a query."""
    return linked.withColumn("query_id", F.col("chunk_id")).withColumn("final_rank", F.lit(1).cast("bigint"))


@query
def ret_16_version_relations(spark, sf_dir):
    linked = linked_chunks(spark, sf_dir).select(
        "chunk_id", "article_number", "is_amendment", "previous_chunk_id"
    )
    out = R.version_relations(chunk_hits(linked), linked)
    return out.select("query_id", "source_chunk_id", "chunk_id", "relation")


@query
def ret_17_appendix_relations(spark, sf_dir):
    """Appendix chunks that every chunk's text refers to."""
    c = chunk_table(spark, sf_dir).select(
        "chunk_id", "document_id", "section_path", F.col("chunk_text").alias("reference_text"),
        F.col("metadata.chunk_kind").alias("chunk_kind"),
        F.expr("CASE WHEN CAST(document_id AS bigint) % 2 = 0 THEN metadata.appendix_number END").alias("appendix_number"),
    )
    c = session.materialize(c, "chunks")
    every = c.withColumn("query_id", F.col("chunk_id")).withColumn("final_rank", F.lit(1).cast("bigint"))
    out = R.appendix_relations(every, c)
    return out.select("source_chunk_id", "chunk_id", "position")


@query
def ret_18_appendix_references(spark, sf_dir):
    d = I.legal(spark, sf_dir)
    refs = L.appendix_references(F.col("text"))
    return d.select("doc_id", F.array_join(refs, ",").alias("refs"))


@query
def ret_19_numerals(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents")
    digit = (F.col("doc_id") % 12).cast("string")
    roman = L.canonical_appendix(digit)
    return d.select(
        "doc_id", roman.alias("roman"), L.roman_to_digit(roman).alias("digit"),
        F.array_join(L.appendix_patterns(roman), "|").alias("patterns"),
    )


@query
def ret_20_appended(spark, sf_dir):
    linked = linked_chunks(spark, sf_dir).select("chunk_id", "article_number", "is_amendment", "previous_chunk_id")
    found = chunk_hits(linked)
    return R.append_related(found, R.version_relations(found, linked)).select("query_id", "chunk_id", "relation", "source_role")


def cited_points(spark, sf_dir):
    return I.points(spark, sf_dir).select(
        "id", "embedding", "chunk_kind", "is_amendment", "article_number", "text",
        F.col("source").alias("document_id"),
        F.concat(F.lit("Chunk "), F.col("id").cast("string")).alias("title"),
        F.when(F.col("id") % 2 == 0, F.col("lang")).alias("section_path"),
        F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("string").alias("mime_type"),
        F.lit(None).cast("string").alias("source"),
    )


def _cited(spark, sf_dir):
    points = cited_points(spark, sf_dir)
    ranked = A.retrieve_and_rank(points, unfiltered(spark, sf_dir), 5)
    return A.cite(ranked, points, I.document_table(spark, sf_dir), V.latest_versions(I.versions(spark, sf_dir)))


@query
def ret_21_citations(spark, sf_dir):
    cited, _ = _cited(spark, sf_dir)
    return cited.select("query_id", "citation_id", "id", "source", "file_path", "mime_type", "title", "section_path")


@query
def ret_22_recent_history(spark, sf_dir):
    out = Q.recent_messages(I.messages(spark, sf_dir))
    return out.select("session_id", "back", "message_id", "role", F.length("content").alias("chars"))


@query
def ret_23_retrieval_queries(spark, sf_dir):
    q = Q.last_questions(I.messages(spark, sf_dir))
    return q.select("session_id", Q.retrieval_query(F.col("question"), F.col("history")).alias("retrieval_query"))


def _route_columns(route):
    return [
        route["strategy"].alias("strategy"),
        F.array_join(F.array_sort(F.transform(F.map_entries(route["filters"]), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "&").alias("filters"),
        route["top_k"].alias("top_k"),
        route["candidate_top_k"].alias("candidate_top_k"),
        route["use_expansion"].alias("use_expansion"),
        route["use_related"].alias("use_related"),
    ]


@query
def ret_24_routes(spark, sf_dir):
    q = Q.route_questions(I.questions(spark, sf_dir), model_answer="model_answer")
    return q.select("conv_id", "turn", *_route_columns(F.col("route")))


@query
def ret_25_rule_routes(spark, sf_dir):
    q = I.questions(spark, sf_dir)
    folded = T.fold_collapsed(F.col("question"))
    r = q.withColumn("r", Q.rule_route(folded, F.lit(3))).filter("r IS NOT NULL")
    return r.select("conv_id", "turn", *_route_columns(F.col("r")))


@query
def ret_26_model_routes(spark, sf_dir):
    q = I.questions(spark, sf_dir).withColumn("d", Q.model_decision(F.col("model_answer")))
    folded = T.fold_collapsed(F.col("question"))
    r = q.withColumn("r", Q.model_route(folded, F.lit(3), F.col("d"))).filter("r IS NOT NULL")
    return r.select(
        "conv_id", "turn", *_route_columns(F.col("r")), F.round("r.confidence", 6).alias("confidence"), "r.rejected"
    )


@query
def ret_27_intents(spark, sf_dir):
    q = I.questions(spark, sf_dir).withColumn("f", T.fold_collapsed(F.col("question")))
    f = F.col("f")
    return q.select(
        "conv_id", "turn", Q.wants_list(f).alias("list"), Q.wants_directory(f).alias("directory"),
        Q.wants_appendix(f).alias("appendix"), Q.wants_amendment(f).alias("amendment"),
        Q.article_number(f).alias("article_number"), Q.appendix_number(f).alias("appendix_number"),
    )


@query
def ret_28_model_json(spark, sf_dir):
    q = I.questions(spark, sf_dir).withColumn("d", Q.model_decision(F.col("model_answer")))
    return q.select(
        "conv_id", "turn", "d.strategy", "d.article_number", "d.appendix_number", "d.confidence",
        F.array_join(Q.expansion_list(F.lit("q"), F.col("model_answer")), "|").alias("expansions"),
    )


@query
def ret_29_prompts(spark, sf_dir):
    q = Q.last_questions(I.messages(spark, sf_dir))
    now = F.lit("2024-05-06 20:30:00").cast("timestamp")
    return q.select("session_id", Q.answer_prompt(F.col("question"), F.lit("ctx"), F.col("history"), now).alias("prompt"))


@query
def ret_29_model_prompts(spark, sf_dir):
    """Prompts for every user question: to expand it, to route it, and to answer it without context."""
    q = I.questions(spark, sf_dir)
    now = F.lit("2024-05-06 20:30:00").cast("timestamp")
    asked = F.col("question")
    return q.select(
        "conv_id", "turn", Q.expand_prompt(asked, now, "expand").alias("expand"), Q.route_prompt(asked, now, "route").alias("route"),
        Q.low_context_prompt(asked, F.lit(None).cast("string"), now, "low").alias("low"),
    )


@query
def ret_30_answer_batch(spark, sf_dir):
    """Questions (mean vectors of each label) to cited context: search, fallback ranking, citations."""
    _, contexts = _cited(spark, sf_dir)
    return contexts


@query
def ret_31_answers(spark, sf_dir):
    """Every session's last question against the chunks of all legal texts: route, search, rank, cite, answer."""
    docs = I.legal(spark, sf_dir).select(
        "doc_id", "text", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        F.col("doc_id").cast("string").alias("version_id"),
    )
    points = session.materialize(N.to_points(N.ingest_chunks(docs)), "points").withColumns(
        {"file_path": F.lit(None).cast("string"), "mime_type": F.lit(None).cast("string"), "source": F.lit(None).cast("string")}
    ).withColumn("document_id", F.col("document_id").cast("string"))
    asked = Q.last_questions(I.messages(spark, sf_dir)).select(F.col("session_id").alias("query_id"), "question", "history")
    latest = V.latest_versions(I.versions(spark, sf_dir))
    out = A.answer_questions(asked, points, I.document_table(spark, sf_dir), latest)
    return out.select("query_id", "strategy", "sources", F.length("answer").alias("answer_chars"))


# --- model hooks -----------------------------------------------------------------------


def letter_embedder():
    """A stand-in for a model: vowel counts."""
    return lambda texts: [[float(t.count(c)) for c in "aeiou"] for t in texts]


def length_scorer():
    return lambda pairs: [float(min(len(q), len(t))) for q, t in pairs]


def echo_generator():
    return lambda prompt: prompt[:40]


@query
def udf_1_embedder(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents").select("doc_id", "text")
    e = H.embed(d, "text", letter_embedder)
    return e.select("doc_id", F.size("embedding").alias("dim"), F.round(F.col("embedding")[0].cast("double"), 4).alias("first"))


@query
def udf_2_pair_scorer(spark, sf_dir):
    b = I.table(spark, sf_dir, "documents")
    return b.select("doc_id", H.pair_score(F.col("lang"), F.col("text"), length_scorer).alias("score"))


@query
def udf_3_generator(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents").select("doc_id", "text")
    return H.generate(d, "text", echo_generator).select("doc_id", "answer")
