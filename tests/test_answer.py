from functools import lru_cache

from pyspark.sql import functions as F

from lawloom.operators import retrieval as R
from lawloom.plans import answer as A
from lawloom.plans import ingest as N
from lawloom.session import materialize
from tests.test_files_and_layout import counted

ORIGINAL = """Chương I
Điều 1. Phạm vi
Quy định về học phí, theo Phụ lục 2 của văn bản này.
Điều 2. Học bổng
Sinh viên giỏi được xét học bổng hằng năm.
Phụ lục II
Mức học phí của từng ngành
"""


def stored_points(spark, text):
    docs = spark.createDataFrame([(1, text, "Quy chế", "1")], "doc_id long, text string, title string, version_id string")
    points = N.to_points(N.ingest_chunks(docs)).withColumn("document_id", F.col("document_id").cast("string"))
    return materialize(points.withColumns({c: F.lit(None).cast("string") for c in ("file_path", "mime_type", "source")}))


@lru_cache
def pieces(spark):
    points = stored_points(spark, ORIGINAL)
    documents = spark.createDataFrame([("1", "text/plain")], "document_id string, mime_type string")
    latest = spark.createDataFrame([("1", "a/b.txt")], "document_id string, source_file_path string")
    return points, documents, latest


def asked(spark, *questions, **more):
    rows = [(i, q, h) for i, (q, h) in enumerate(questions)]
    return spark.createDataFrame(rows, "query_id long, question string, history string").withColumns({k: F.lit(v) for k, v in more.items()})


def answers(spark, questions, **options):
    points, documents, latest = pieces(spark)
    stored = {r.id: r for r in points.collect()}
    out = A.answer_questions(questions, points, documents, latest, **options).orderBy("query_id").collect()
    return out, stored


def test_appendix_by_digit_finds_the_roman_one(spark):
    out, stored = answers(spark, asked(spark, ("nội dung Phụ lục 2", None)))
    kinds = [stored[x.rsplit(":", 1)[0]].chunk_kind for x in out[0].source_ids]
    assert out[0].strategy == "appendix_lookup" and set(kinds) == {"appendix"}
    assert "Mức học phí" in out[0].context


def test_related_appendix_follows_the_hits(spark):
    out, stored = answers(spark, asked(spark, ("Điều 1 quy định gì về học phí", None)))
    roles = [x.rsplit(":", 1)[1] for x in out[0].source_ids]
    kinds = [stored[x.rsplit(":", 1)[0]].chunk_kind for x in out[0].source_ids]
    assert roles == sorted(roles) and roles[-1] == "supporting" and kinds[-1] == "appendix"
    assert stored[out[0].source_ids[0].rsplit(":", 1)[0]].article_number == "1"


def test_history_decides_the_route_unless_told_otherwise(spark):
    question = asked(spark, ("còn học bổng thì sao", "Nguoi dung: Điều 2 nói gì"))
    assert answers(spark, question)[0][0].strategy == "exact_legal_lookup"
    assert answers(spark, question, route_on="question")[0][0].strategy == "broad_semantic_rag"


def test_model_route_and_expansions(spark):
    question = asked(
        spark, ("học phí của từng ngành", None), route='{"strategy":"exact_legal_lookup","article_number":"2","confidence":0.9}',
        more='["học bổng hằng năm"]',
    )
    out, stored = answers(spark, question, model_answer="route", expansion_answer="more")
    assert out[0].strategy == "exact_legal_lookup"
    assert {stored[x.rsplit(":", 1)[0]].article_number for x in out[0].source_ids} == {"2"}


def test_top_k_beyond_ten(spark):
    text = "\n".join(f"Điều {i}. Học bổng số {i}\nSinh viên nhận học bổng loại {i} hằng năm." for i in range(1, 41))
    _, documents, latest = pieces(spark)
    points = stored_points(spark, text)
    out = A.answer_questions(asked(spark, ("học bổng sinh viên hằng năm", None)), points, documents, latest, top_k=20).first()
    assert len([x for x in out.source_ids if x.endswith(":primary")]) == 20


def test_low_context_reaches_no_search(spark):
    out, _ = answers(spark, asked(spark, ("xin", None)))
    assert out[0].strategy == "low_context_or_invalid" and out[0].sources == 0 and out[0].source_ids is None


def test_hits_are_searched_once(spark, monkeypatch):
    """Relations read the ranked hits several times: no stage but the written hits holds the search."""
    plans = {}

    def noted(df, name="stage"):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
        return materialize(df, name)

    monkeypatch.setattr(A, "materialize", noted)
    answers(spark, asked(spark, ("học phí theo Điều 1", "")))
    assert plans == {"hits": 1, "primary": 0, "ranked": 0}


def test_texts_and_routes_are_worked_out_once(spark):
    points, documents, latest = pieces(spark)
    seen, count = counted(spark, "string")
    asked_once = asked(spark, ("Điều 2 quy định gì về học bổng", None), ("Phụ lục 2 là gì", "x"), ("xin", None))
    out = A.answer_questions(asked_once.withColumn("question", count("question")), points, documents, latest)
    assert len(out.collect()) == 3 and seen.value == 3

    seen, count = counted(spark, "string")
    docs = spark.createDataFrame([(1, ORIGINAL, "Quy chế", "1")], "doc_id long, text string, title string, version_id string")
    assert N.ingest_chunks(docs.withColumn("text", count("text"))).count() > 1 and seen.value == 1

    seen, count = counted(spark, "string")
    chunks = points.withColumn("reference_text", F.col("text"))
    hits = chunks.select(F.lit(1).alias("query_id"), F.lit(1).alias("final_rank"), "chunk_id", "document_id", count("reference_text").alias("reference_text"))
    assert R.appendix_relations(hits, chunks).count() > 0 and seen.value == points.count()
