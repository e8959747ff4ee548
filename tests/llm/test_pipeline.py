"""The registered queries of the package against their twins, and the pipeline stage by stage."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.compare import compare, duck
from tests.llm.test_chosen_path import brute
from tests.llm.test_files import whole

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_warc", "op5_decontaminate", "op7_line_rules", "op10_url_rules"])
def test_query_equals_its_twin(spark, name):
    out = compare(spark, duck(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert out.startswith("ok"), out


def test_all_queries_and_the_pipeline_are_registered():
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14))


def test_stages(spark, tmp_path):
    con, docs = duck(SF), spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append(docs)
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [{r.doc_id for r in d.collect()} for d in seen]
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all({r.doc_id: r.text for r in d.collect()}.items() <= rows.items() for d in seen[:4])
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({entry.oracle_sql()['op7_line_rules']}) WHERE kept").fetchall()}
    assert ids[0] == kept
    first = {i for i, _, _, own in brute([(i, rows[i]) for i in kept], 5) if own}
    assert ids[1] == first
    bad = {r[0] for r in con.execute(f"SELECT doc_id FROM ({entry.oracle_sql()['op5_decontaminate']}) WHERE contaminated").fetchall()}
    assert ids[2] == first - bad
    assert ids[3] < ids[2] and ids[3]
    at, want = 0, []
    for i, t in zip(sorted(ids[3]), whole([rows[i] for i in sorted(ids[3])]), strict=True):
        want.append((i, at, len(t), zlib.crc32(np.array(t, "<u4").tobytes())))
        at += len(t)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in seen[4].collect()) == want

    run = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in run) == want


def test_stages_keep_rows_without_ids_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(None, text, None, None, None), (1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, None, None, None, 0)], schema)
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert {(r.doc_id, r.text) for r in stage(spark, docs, SF).collect()} >= {(None, text), (1, text)}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
    (_, mixing), (_, tokens) = corpus_pipeline.STAGES[3:]
    left = Counter(tuple(r) for r in docs.collect())
    left.subtract(tuple(r) for r in mixing(spark, docs, SF).collect())
    assert min(left.values()) >= 0
    rows = sorted(tokens(spark, docs, SF).collect(), key=lambda r: r.start)
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "2", "None"]
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(4)]
    assert len({r.n_tokens for r in rows if r.doc_id != 2}) == 1 and {r.n_tokens for r in rows if r.doc_id == 2} == {1}


def test_quality_stage_removes_frequent_lines(spark):
    """A footer in all texts of a host stays in the first only; a document of little else is rejected."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    own = {i: " ".join(f"{chr(97 + i % 26)}{i // 26}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(40)) for i in range(30)}
    footer = "All rights\treserved 2024"
    texts = {i: f"{own[i]}\n{footer.replace('2024', str(2000 + i))}\n\nend {chr(97 + i % 26)}{i // 26}z" for i in own} | {99: "\n".join([footer] * 10)}
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in texts.items()], schema)
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.STAGES[0][1](spark, docs, SF).collect()}
    want = {i: texts[i] if i == 0 else "\n".join(x for x in texts[i].split("\n") if "rights" not in x) for i in own}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_clashing_names_do_no_harm(spark):
    """Extra columns with names that the operators use inside."""
    from lawloom.llm import chosen_path, decontaminate, html_mincut, language_zstd, line_rules, passage_mil, raking, url_rules

    names = ("id", "body", "line", "host", "gone", "rows", "n", "row", "rules", "row_id", "keeper", "items", "ranges", "rep", "comp", "path",
             "all", "by_host", "by_pattern", "_url", "factor", "topic", "x", "y", "h", "score", "lang_pred", "n_words", "digest")
    text = "\n".join(f"line {i} of a text with some words" for i in range(12))
    base = spark.createDataFrame([(1, text, "en", "a"), (1, text, "en", "a"), (None, None, None, None)], "doc_id long, text string, lang string, source string")
    docs = base.withColumns({c: F.lit(7) for c in names})
    bench = spark.createDataFrame([(1, "no such words")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int").withColumns({c: F.lit(7) for c in names})
    model = passage_mil.fit_quality(docs, labels, F.lit(True))
    outs = [
        line_rules.judge_documents(docs), line_rules.strip_frequent_lines(docs), chosen_path.near_duplicates(docs), chosen_path.keep_first(docs),
        decontaminate.find_hits(docs, bench, docs.columns), decontaminate.drop_contaminated(docs, bench), raking.sample_to_targets(docs),
        language_zstd.identify(docs, language_zstd.fit_languages(docs)), passage_mil.score_documents(docs, model),
        html_mincut.extract(docs.withColumnRenamed("lang", "html"), html_mincut.fit_classifier(docs.withColumnRenamed("lang", "html"))),
        url_rules.judge_urls(docs, "text"),
    ]
    assert [out.count() for out in outs] == [3, 2, 3, 3, 3, 3, 3, 3, 3, 3, 3]
