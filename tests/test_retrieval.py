import numpy as np
from pyspark.sql import functions as F

from lawloom.operators import retrieval as R
from lawloom.operators import routing as Q
from lawloom.operators.nearest import Clusters, unit_rows

SCHEMA_P = "id long, embedding array<float>, kind string, n string"
SCHEMA_Q = "query_id long, query_index int, vector array<double>, k int, filters map<string,string>"


def corpus(spark, n=300, dim=8):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(n, dim)).astype(np.float32)
    vectors[10] = vectors[11] = vectors[250]  # ties
    vectors[12] = 0
    rows = [(i, [float(x) for x in v], "ab"[i % 2], str(i % 5)) for i, v in enumerate(vectors)]
    return vectors, spark.createDataFrame(rows, SCHEMA_P).repartition(5)


def brute(vectors, q, k, keep):
    v = vectors.astype(np.float64)
    norm = np.linalg.norm(v, axis=1)
    q = np.asarray(q)
    scores = np.round((v @ (q / np.linalg.norm(q))) / np.where(norm == 0, 1, norm), 6)
    order = sorted((i for i in range(len(v)) if keep(i)), key=lambda i: (-scores[i], i))[:k]
    return [(i, float(scores[i]) + 0.0) for i in order]


def test_topk_equals_full_sort(spark):
    vectors, points = corpus(spark)
    rng = np.random.default_rng(9)
    wanted, rows = {}, []
    for i in range(12):
        rule = [None, {"kind": "a"}, {"kind": "b", "n": "3"}][i % 3]
        q = [float(x) for x in (vectors[10] if i == 0 else rng.normal(size=8))]
        rows.append((i, 0, q, 4 + i, rule))
        keep = lambda j, r=rule: not r or all({"kind": "ab"[j % 2], "n": str(j % 5)}[c] == v for c, v in r.items())
        wanted[i] = brute(vectors, q, 4 + i, keep)
    queries = spark.createDataFrame(rows, SCHEMA_Q)
    for block_bytes in (1 << 20, 1000):  # one block, many blocks
        out = R.vector_topk(points, queries, ("kind", "n"), block_bytes).orderBy("query_id", "rank").collect()
        got = {}
        for r in out:
            got.setdefault(r.query_id, []).append((r.id, r.score))
        assert got == wanted


def test_shared_filters_reach_the_scan(spark, tmp_path):
    _, points = corpus(spark)
    points.write.parquet(str(tmp_path / "p"))
    queries = spark.createDataFrame([(1, 0, [1.0] * 8, 3, {"kind": "a"})], SCHEMA_Q)
    out = R.vector_topk(spark.read.parquet(str(tmp_path / "p")), queries, ("kind",))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(kind,a)" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


HITS = "query_id long, query_index int, id long, score double, rank long, title string, q string"


def hits(spark):
    rows = [(1, 0, 5, 0.4, 1, "alpha beta", "beta"), (1, 1, 5, 0.9, 2, "alpha beta", "beta"), (1, 0, 6, 0.5, 2, "gamma", "beta"), (1, 1, 7, 0.7, 1, "beta", "beta")]
    return spark.createDataFrame(rows, HITS).withColumn("key", F.col("id"))


def test_deduplicate_keeps_best_or_first(spark):
    best = {r.id: (r.score, r.matched_query_count) for r in R.deduplicate(hits(spark)).collect()}
    first = {r.id: r.score for r in R.deduplicate(hits(spark), keep="first").collect()}
    assert best[5] == (0.9, 2) and first[5] == 0.4


def test_rerank_and_fallback(spark):
    scored = R.rerank(hits(spark), F.col("q"), F.col("title"), 2).orderBy("final_rank").collect()
    assert [r.id for r in scored] == [5, 7] and scored[0].rerank_model == "lexical_overlap"

    def broken():
        raise RuntimeError("no model")

    fallen = R.rerank(hits(spark), F.col("q"), F.col("title"), 3, load=broken).orderBy("final_rank").collect()
    assert [r.id for r in fallen] == [7, 6, 5] and {r.rerank_model for r in fallen} == {R.FALLBACK_MODEL}
    off = R.rerank(hits(spark), F.col("q"), F.col("title"), 3, enabled=False).orderBy("final_rank").collect()
    assert [r.id for r in off] == [7, 6, 5]


def test_appendix_paths_match_like_patterns(spark):
    paths = ["Phụ lục III > x", "a Phu luc 10", "PHỤ LỤC iv", "Phụ lục  II", "phụ lục x phụ lục 2b"]
    refs = ["I", "II", "III", "IV", "X", "1", "2", "10", "2B"]
    df = spark.createDataFrame([(p, r) for p in paths for r in refs], "p string, r string")
    like = F.ilike("p", F.concat(F.lit("%phụ lục "), "r", F.lit("%"))) | F.ilike("p", F.concat(F.lit("%phu luc "), "r", F.lit("%")))
    found = F.array_contains(R.appendix_numbers_in_path(F.col("p"), F.length("r")), F.upper("r"))
    assert df.filter(like != found).count() == 0


def test_appendix_relations(spark):
    chunks = spark.createDataFrame(
        [("c1", "d", "appendix", "II", "Phụ lục II"), ("c2", "d", "appendix", None, "Phụ lục III > 1"), ("c3", "e", "appendix", "II", "x")],
        "chunk_id string, document_id string, chunk_kind string, appendix_number string, section_path string",
    )
    found = spark.createDataFrame(
        [(1, 1, "h", "d", "theo Phụ lục 2 và phụ lục III, Phu luc 1")],
        "query_id long, final_rank long, chunk_id string, document_id string, reference_text string",
    )
    out = R.appendix_relations(found, chunks).orderBy("position").collect()
    # reference I has no number of its own and matches the spelling of II and III
    assert [(r.chunk_id, r.position) for r in out] == [("c1", 1), ("c2", 6), ("c1", 11), ("c2", 12)]
    related = R.append_related(found, R.appendix_relations(found, chunks)).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.relation) for r in related] == [("c1", "referenced_appendix"), ("c2", "referenced_appendix")]


def test_model_json(spark):
    cases = {
        '{"strategy":"x","confidence":0.5}': ("x", 0.5),
        'so: {"strategy":"x","confidence":1.7} ok': ("x", 1.0),
        '{"strategy":"x","confidence":"abc"}': ("x", 0.0),
        "[1]": None,
        '"{}"': None,
        "garbage {": None,
        "a {b} c": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("d", Q.model_decision(F.col("t")))
    for r in df.select("t", "d", Q.confidence_of(F.col("d.confidence")).alias("c")).collect():
        assert (None if r.d is None else (r.d.strategy, r.c)) == cases[r.t], r.t


def test_routes(spark):
    cases = {
        "Điều 5 quy định gì": (Q.EXACT, {"article_number": "5"}, 3, 9),
        "email của thầy Nam": (Q.DIRECTORY, {"chunk_kind": "Lecturer"}, 3, 15),
        "danh sách giảng viên khoa A": (Q.DIRECTORY, {"chunk_kind": "Lecturer"}, 10, 30),
        "xem phụ lục ii": (Q.APPENDIX, {"chunk_kind": "appendix", "appendix_number": "II"}, 3, 12),
        "nội dung sửa đổi là gì": (Q.AMENDMENT, {"is_amendment": "true"}, 3, 15),
        "biểu mẫu tuyển sinh": (Q.BROAD, {}, 3, 12),
        "chào": (Q.LOW, {}, 3, 12),
    }
    df = spark.createDataFrame([(k,) for k in cases], "question string")
    for r in Q.route_questions(df).collect():
        assert (r.route.strategy, r.route.filters, r.route.top_k, r.route.candidate_top_k) == cases[r.question], r.question


def test_history_query(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}", i) for i in range(21)]
    m = spark.createDataFrame(rows, "session_id long, message_id long, role string, content string, created_at long")
    (r,) = Q.last_questions(m).collect()
    assert r.question == "m20" and r.history.split("\n")[0] == "Nguoi dung: m12" and r.history.endswith("Tro ly: m19")
    text = m.sparkSession.createDataFrame([(r.question, "x" * 5000)], "q string, h string")
    out = text.select(Q.retrieval_query(F.col("q"), F.col("h")).alias("o")).first().o
    assert out.count("x") == 1800 and out.endswith("Cau hoi hien tai:\nm20")


def talk(spark, n):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}", i) for i in range(n)]
    return spark.createDataFrame(rows, "session_id long, message_id long, role string, content string, created_at long")


def test_history_bounds_cut(spark):
    recent = Q.recent_messages(talk(spark, 31)).orderBy("back").collect()
    assert [r.message_id for r in recent] == list(range(30, 30 - Q.HISTORY_MESSAGES, -1))
    asked = Q.last_questions(talk(spark, 31)).first()
    lines = asked.history.split("\n")
    assert asked.question == "m30" and len(lines) == Q.RETRIEVAL_MESSAGES and lines[-1].endswith(": m29")


def test_search_by_many_queries_keeps_blocks_small(spark):
    """Far more queries than one block holds; every query finds itself."""
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(400, 64))
    points = spark.createDataFrame([(i, [float(x) for x in v], "a", "1") for i, v in enumerate(vectors)], SCHEMA_P)
    rows = [(i, 0, [float(x) for x in vectors[i]], 1, None if i % 2 else {"kind": "a"}) for i in range(400)]
    out = R.vector_topk(points, spark.createDataFrame(rows, SCHEMA_Q), ("kind",), block_bytes=80 * 768).collect()
    assert sorted((r.query_id, r.id) for r in out) == [(i, i) for i in range(400)]


def test_one_failing_batch_falls_back_for_its_queries_only(spark):
    def picky():
        def score(pairs):
            if any(q == "bad" for q, _ in pairs):
                raise ValueError("no score")
            return [float(len(t)) for _, t in pairs]

        return score

    rows = [(1, 0, 1, 0.9, 1, "aa", "good"), (1, 0, 2, 0.5, 2, "aaaa", "good"), (2, 0, 3, 0.4, 2, "aaaaaa", "bad"), (2, 0, 4, 0.8, 1, "a", "bad")]
    found = spark.createDataFrame(rows, HITS).withColumn("key", F.col("id")).repartition(2, "query_id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        out = R.rerank(found, F.col("q"), F.col("title"), 2, load=picky).orderBy("query_id", "final_rank").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r.query_id, r.id, r.rerank_model) for r in out] == [
        (1, 2, "lexical_overlap"), (1, 1, "lexical_overlap"), (2, 4, R.FALLBACK_MODEL), (2, 3, R.FALLBACK_MODEL)
    ]


def test_clusters_skip_and_stay_exact():
    """Points in tight groups: most clusters are skipped, and the best k are those of the full sort, ties included."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    vectors = np.concatenate([c + rng.normal(scale=0.05, size=(100, 16)) for c in centres])
    vectors[50:60] = vectors[40]
    vectors[7] = 0
    queries = np.concatenate([centres, vectors[40:44], np.zeros((1, 16))])
    for order in (np.arange(len(vectors)), rng.permutation(len(vectors))):
        clusters = Clusters(vectors, order)
        ks = np.array([1 + q % 9 for q in range(len(queries))])
        mask = rng.random(len(vectors)) < 0.7
        for kept in (None, mask):
            query, point, score = clusters.best(queries, ks, kept)
            scores = np.round(unit_rows(queries) @ unit_rows(vectors).T, 6)
            for q in range(len(queries)):
                usable = [i for i in range(len(vectors)) if kept is None or kept[i]]
                want = sorted(usable, key=lambda i: (-scores[q, i], order[i]))[: ks[q]]
                assert point[query == q].tolist() == want and score[query == q].tolist() == (scores[q, want] + 0.0).tolist()
    assert clusters.skipped > 5 * clusters.visited


def test_points_are_read_once(spark):
    """Many blocks of queries, one scan of the points."""
    _, points = corpus(spark)
    rows = [(i, 0, [1.0] * 7 + [float(i)], 2, None) for i in range(200)]
    out = R.vector_topk(points, spark.createDataFrame(rows, SCHEMA_Q), (), block_bytes=1000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and out.count() == 400


def test_evaluation_run_keeps_sizes_inside_their_bounds(spark):
    from lawloom.operators import evaluation as E

    asked = []
    questions = spark.createDataFrame([("t1", "q", "7", "alpha", 9)], "test_id string, question string, expected_chunk_id string, expected_keywords string, candidate_count long")

    def search(rows, final, candidates):
        asked.append((final, candidates))
        names = "test_id string, rank int, key string, title string, section_path string, doc_title string, article_title string, text string, score double, rerank_score double, rerank_model string"
        return spark.createDataFrame([("t1", i, str(i), "t", "s", "d", "a", "alpha" if i == 4 else "beta", 1.0 / i, None, "m") for i in range(1, 9)], names)

    row = E.evaluation_run(questions, search, top_k=2, candidate_top_k=3, context_top_k=9).first()
    assert asked == [(5, 5)] and row.retrieved_count == 5 and row.expected_rank is None and row.context_recall == 1.0
    row = E.evaluation_run(questions, search, top_k=8, context_top_k=0).first()
    assert asked[1] == (8, 30) and row.expected_rank == 7 and row.context_recall == 0.0
