"""Questions to answers: retrieve, re-rank, relate, cite, answer - all questions in one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawloom import session
from lawloom.functions.hooks import embed, generate
from lawloom.functions.legal import canonical_appendix
from lawloom.functions.text import keyword_text
from lawloom.operators import retrieval as R
from lawloom.operators import routing as Q
from lawloom.session import materialize


FILTERS = ("article_number", "chunk_kind", "appendix_key", "is_amendment")


def retrieve_and_rank(
    points: DataFrame,
    query_vectors: DataFrame,
    top_k: int | Column,
    filter_columns: tuple[str, ...] = (),
    questions: DataFrame | None = None,
    load_scorer: Callable | None = None,
    fallback_keep: str = "first",
) -> DataFrame:
    """Final hits per question. Without question texts the vector order stands.

    Only ids and scores pass through ranking; stored fields join back for the ranked rows. ``questions``: query_id,
    question (the text that is scored) and the columns that a column ``top_k`` names.
    """
    hits = R.vector_topk(points, query_vectors, filter_columns).withColumn("key", F.col("id"))
    if questions is None:
        return R.rerank(hits, F.lit(""), F.lit(""), top_k, enabled=False, fallback_keep=fallback_keep)
    text = R.candidate_text(F.col("title"), F.col("section_path"), F.col("text"))
    hits = materialize(hits, "hits")  # the pairs and all hits are read from it: one search
    if load_scorer is None:  # the words of a question and of a chunk are worked out once, not for each of their pairs
        questions = session.materialize(questions.withColumn("question", keyword_text(F.col("question"))), "questions")
        text = keyword_text(text)
    found = points.join(hits.select("id").distinct(), "id", "left_semi")
    texts = session.materialize(found.select("id", text.alias("candidate")), "candidates")
    paired = R.limit_candidates(R.deduplicate(hits), key="key").drop("candidate_rank", "matched_query_count")
    paired = paired.join(questions, "query_id").join(texts, "id")
    ranked = R.rerank(
        paired, F.col("question"), F.col("candidate"), top_k, load=load_scorer, fallback_keep=fallback_keep,
        all_hits=hits.join(questions, "query_id"),
    )
    return ranked.drop("candidate", "question")


def canonical_filters(filters: Column) -> Column:
    """Route filters with the appendix number as its roman numeral, which the points hold as `appendix_key`."""
    numbered = F.map_contains_key(filters, F.lit("appendix_number"))
    key = canonical_appendix(F.element_at(filters, F.lit("appendix_number")))
    rest = F.map_filter(filters, lambda k, _: k != "appendix_number")
    return F.when(numbered, F.map_concat(rest, F.create_map(F.lit("appendix_key"), key))).otherwise(filters)


def relate(ranked: DataFrame, points: DataFrame, related: DataFrame) -> DataFrame:
    """The ranked hits, and after them the chunks related to those of the queries in ``related`` (query_id).

    Adds source_role, relation and position: hits keep their order, related chunks follow in the order of their source.
    """
    stored = points.select("id", "chunk_id", "document_id", "chunk_kind", "appendix_number", "section_path", "previous_chunk_id",
                           (F.col("is_amendment") == "true").alias("is_amendment"), F.col("text").alias("reference_text"))
    hits = ranked.select("query_id", "id", "final_rank").join(related, "query_id", "left_semi").join(stored, "id")
    relations = R.version_relations(hits, stored).unionByName(R.appendix_relations(hits, stored))
    added = R.append_related(hits, relations, with_position=True).join(points.select("id", "chunk_id"), "chunk_id")
    own = ranked.select("query_id", "id", "final_rank", F.lit(0).cast("bigint").alias("related_order"),
                        F.lit("primary").alias("source_role"), F.lit(None).cast("string").alias("relation"))
    more = added.select("query_id", "id", F.col("source_rank").alias("final_rank"), "related_order", "source_role", "relation")
    return own.unionByName(more)


def cite(
    ranked: DataFrame, points: DataFrame, documents: DataFrame, latest: DataFrame, document_key: str = "document_id"
) -> tuple[DataFrame, DataFrame]:
    """(citations, contexts) of the ranked hits. ``points`` has the payload columns of a hit."""
    payload = points.select(
        "id", F.col(document_key).alias("document_id"), "title", "section_path", "text", "file_path", "mime_type", "source"
    )
    have = [c for c in payload.columns if c != "id"]
    hits = ranked.drop(*have).join(payload, "id")
    order = [F.col("final_rank")]
    if "related_order" in ranked.columns:  # related chunks come after all hits
        order = [F.col("related_order") > 0, F.col("final_rank"), F.col("related_order")]
    cited = R.citations(hits, documents, latest, order)
    return cited, R.contexts(cited)


def answer_questions(
    questions: DataFrame,
    points: DataFrame,
    documents: DataFrame,
    latest: DataFrame,
    top_k: int = 3,
    dim: int = 64,
    load_embedder: Callable | None = None,
    load_scorer: Callable | None = None,
    load_generator: Callable | None = None,
    now: str = "2024-01-01 00:00:00",
    model_answer: str | None = None,
    expansion_answer: str | None = None,
    route_on: str = "history",
    answers: bool = True,
) -> DataFrame:
    """query_id, question, strategy, sources, source_ids, context, prompt and answer for a batch of questions.

    ``questions``: query_id, question, history; ``model_answer`` and ``expansion_answer`` name columns with a model's
    answers to the route and the expansion prompt. The question with the tail of its history is routed (the bare question
    with ``route_on="question"``), searched and scored; the prompt holds the bare question. Low-context questions never
    reach the search. ``points`` carry embeddings of the same embedder, and previous_chunk_id where versions are linked.
    """
    if "previous_chunk_id" not in points.columns:
        points = points.withColumn("previous_chunk_id", F.lit(None).cast("string"))
    asked = questions.withColumn("retrieval_text", Q.retrieval_query(F.col("question"), F.col("history")))
    routed = Q.route_questions(asked, "question" if route_on == "question" else "retrieval_text", top_k, model_answer)
    # every branch reads the routes, and a filter on the strategy would hold a copy of all rules for each test
    used = dict.fromkeys(["query_id", "question", "history", "retrieval_text", "route", *([expansion_answer] if expansion_answer else [])])
    routed = session.materialize(routed.select([F.col(c).cast("string").alias(c) if routed.schema[c].dataType.typeName() == "void" else c for c in used]), "routed")
    searched = routed.filter(F.col("route.strategy") != Q.LOW)
    expansions = F.array().cast("array<string>")
    if expansion_answer is not None:
        listed = Q.expansion_list(F.col("retrieval_text"), F.col(expansion_answer))
        expansions = F.when(F.col("route.use_expansion"), listed).otherwise(expansions)
    kept = searched.select("query_id", F.col("retrieval_text").alias("question"), "route", expansions.alias("expansions"))
    exploded = R.explode_queries(kept, F.col("expansions"))
    vectors = embed(exploded, "retrieval_query", load_embedder, "vector", dim).select(
        "query_id", "query_index", F.col("vector").cast("array<double>").alias("vector"),
        F.col("route.candidate_top_k").alias("k"), canonical_filters(F.col("route.filters")).alias("filters"),
    )
    texts = kept.select("query_id", "question", F.col("route.top_k").alias("top_k"))
    # relations read the ranked hits several times, each with a search and its broadcasts if they were not written
    ranked = materialize(retrieve_and_rank(points, vectors, F.col("top_k"), FILTERS, texts, load_scorer), "primary")
    ranked = materialize(relate(ranked, points, kept.filter("route.use_related").select("query_id")), "ranked")
    cited, context = cite(ranked, points, documents, latest)
    ids = cited.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("citation_id", "id", "source_role"))), lambda x: F.concat_ws(":", x["id"], x["source_role"])).alias("source_ids")
    )
    grounded = routed.join(context, "query_id", "left").join(ids, "query_id", "left")
    at = F.lit(now).cast("timestamp")
    low = Q.low_context_prompt(F.col("question"), F.col("history"), at)
    prompt = F.when(F.col("route.strategy") == Q.LOW, low).otherwise(
        Q.answer_prompt(F.col("question"), F.col("context"), F.col("history"), at)
    )
    grounded = grounded.withColumn("prompt", prompt)
    answered = generate(grounded, "prompt", load_generator) if answers else grounded.withColumn("answer", F.lit(None).cast("string"))
    return answered.select(
        "query_id", "question", F.col("route.strategy").alias("strategy"), F.coalesce("sources", F.lit(0)).alias("sources"),
        "source_ids", "context", "prompt", "answer",
    )
