import json
import random

from pyspark.sql import functions as F

from lawloom.operators import layout as Y
from lawloom.sources import files, sinks

TEXT = "text"


def span(content, bbox=None, kind=TEXT):
    return {"type": kind, "content": content, **({"bbox": bbox} if bbox else {})}


LAYOUT = {
    "pdf_info": [
        {
            "page_idx": 0,
            "page_size": [595, 842],
            "para_blocks": [
                {
                    "bbox": [0, 0, 9, 9],
                    "lines": [
                        {"bbox": [1, 1, 2, 2], "spans": [span("Một"), span("hai", [3, 3, 4, 4]), span("pic", kind="image")]},
                    ],
                    "blocks": [{"bbox": [5, 5, 6, 6], "lines": [{"spans": [span("con")]}]}],
                }
            ],
            "preproc_blocks": [{"bbox": [0, 0, 1, 1], "lines": [{"spans": [span("unused")]}]}],
        },
        {"page_idx": 1, "page_size": {"w": 10, "h": 20}, "preproc_blocks": [{"bbox": [7, 7, 8, 8], "lines": [{"spans": [span("ba")]}]}]},
        {"page_idx": 2, "width": 30, "height": 40, "para_blocks": []},
    ]
}


def layouts(spark, value=LAYOUT):
    return spark.createDataFrame([("d", json.dumps(value, ensure_ascii=False))], "doc_id string, layout string")


def test_layout_entries(spark):
    rows = Y.layout_entries(layouts(spark)).orderBy("entry_no").collect()
    assert [(r.text, r.bbox, r.page_idx) for r in rows] == [
        ("Một", [1, 1, 2, 2], 0),
        ("hai", [3, 3, 4, 4], 0),
        ("Một hai", [1, 1, 2, 2], 0),
        ("Một hai", [0, 0, 9, 9], 0),
        ("con", [5, 5, 6, 6], 0),
        ("con", [5, 5, 6, 6], 0),
        ("ba", [7, 7, 8, 8], 1),
        ("ba", [7, 7, 8, 8], 1),
    ]
    assert tuple(rows[0].page_size) == (595.0, 842.0) and tuple(rows[6].page_size) == (10.0, 20.0)
    assert rows[0].folded == "mot"


def test_layout_pages(spark):
    pages = Y.layout_pages(layouts(spark))
    assert [r.text for r in pages.orderBy("page_no").collect()] == ["Một\nhai\npic\ncon", "ba", ""]
    (doc,) = Y.pages_to_documents(pages).collect()
    assert doc.raw_text == "Một\nhai\npic\ncon\n\nba" and doc.ocr_pages == [1, 2] and doc.page_count == 3


def test_deep_blocks_are_read(spark):
    block = None
    for i in range(6, 0, -1):
        line = {"bbox": [0, 0, 1, 1], "spans": [{"type": "text", "content": f"level {i}"}]}
        block = {"bbox": [0, 0, 1, 1], "lines": [line], **({"blocks": [block]} if block else {})}
    made = layouts(spark, {"pdf_info": [{"page_idx": 0, "para_blocks": [block]}]})
    assert Y.nesting(made) >= 5
    texts = [r.text for r in Y.layout_entries(made).orderBy("entry_no").collect()]
    assert list(dict.fromkeys(texts)) == [f"level {i}" for i in range(1, 7)]
    assert Y.layout_pages(made).first().text == "\n".join(f"level {i}" for i in range(1, 7))


def test_line_matching_against_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    entries, lines = [], []
    for d in range(6):
        for i in range(25):
            e = text(rng.randint(1, 16))
            entries.append((d, i, e, [float(i)], i % 3))
            cut = rng.randint(0, max(len(e) - 1, 0))
            lines.append((d, i, rng.choice([e, e[cut:], e[:cut], text(3) + " " + e + " " + text(2), text(5)])))
    e_df = spark.createDataFrame(entries, "doc_id long, n long, text string, bbox array<double>, page_idx int")
    e_df = e_df.withColumn("folded", Y.layout_match_text(F.col("text"))).withColumn(
        "page_size", F.lit(None).cast("struct<width:double,height:double>")
    )
    l_df = spark.createDataFrame(lines, "doc_id long, line_no long, line string")
    got = {(r.doc_id, r.line_no, r.bbox[0], r.page_idx) for r in Y.lines_to_layout(l_df, e_df, ["line_no"]).collect()}
    fold = lambda x: " ".join(x.split()).replace("é", "e")
    want = set()
    for d, n, line in lines:
        lf = fold(line)
        for d2, _, e, bbox, page in entries:
            ef = fold(e)
            hit = ef == lf or (len(lf) >= 20 and lf in ef) or (len(ef) >= 20 and ef in lf)
            if d == d2 and len(lf) >= 10 and len(ef) >= 8 and hit:
                want.add((d, n, bbox[0], page))
    assert got == want and len(want) > 50


def test_ocr_results(spark, tmp_path):
    page = lambda *texts: json.dumps({"result": {"layoutParsingResults": [{"markdown": {"text": t}} for t in texts]}})
    (tmp_path / "My File.jsonl").write_text(page("a", "") + "\n\n" + page("c") + "\n" + json.dumps({"result": None}), "utf-8")
    pages = files.read_ocr_documents(spark, str(tmp_path))
    (doc,) = Y.pages_to_documents(pages).collect()
    assert (doc.doc_id, doc.raw_text, doc.ocr_pages) == ("my_file", "a\n\n\n\nc", [1, 3])


def test_text_files(spark, tmp_path):
    (tmp_path / "Quy Chế.txt").write_bytes("  xin chào\r\nbạn \n".encode())
    (tmp_path / "latin.txt").write_bytes("café".encode("latin-1"))
    (tmp_path / "empty.txt").write_bytes(b"")
    rows = {r.file_name: r for r in files.read_text_documents(spark, str(tmp_path)).collect()}
    assert rows["Quy Chế.txt"].raw_text == "xin chào\nbạn" and rows["Quy Chế.txt"].doc_id == "quy_chế"
    assert rows["Quy Chế.txt"].title == "Quy Chế" and rows["Quy Chế.txt"].char_count == 12
    assert rows["latin.txt"].raw_text == "café" and "empty.txt" not in rows


def test_corpus_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.PDF").write_bytes(b"%PDF")
    (tmp_path / "b.md").write_bytes(b"hi\xff")
    (tmp_path / "c.exe").write_bytes(b"no")
    rows = {r.file_name: r.supported for r in files.scan_corpus(spark, str(tmp_path)).collect()}
    assert rows == {"a.PDF": True, "b.md": True, "c.exe": False}
    assert [r.raw_text for r in files.read_corpus_texts(spark, str(tmp_path)).collect()] == ["hi"]


def test_evaluation_csv(spark, tmp_path):
    csv = '﻿test_id,question,expected_chunk_id,expected_document_id,expected_chunk_title,expected_keywords\n'
    csv += 'a,"line one\nline ""two""",c1,,,x;y\n,q2,c2,d2,t2,\n'
    (tmp_path / "e.csv").write_text(csv, "utf-8")
    rows = files.read_evaluation_set(spark, str(tmp_path / "e.csv")).collect()
    assert [(r.test_id, r.question, r.expected_keywords) for r in rows] == [
        ("a", 'line one\nline "two"', "x;y"), ("row_2", "q2", ""),
    ]
    assert files.read_evaluation_set(spark, str(tmp_path / "e.csv"), limit=1).count() == 1


def test_snapshots(spark, tmp_path):
    old, new = str(tmp_path / "v1"), str(tmp_path / "v2")
    assert sinks.create_table(spark, old, "id long, v string").count() == 0
    first = sinks.upsert_snapshot(spark, old, spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), new)
    third = sinks.upsert_snapshot(spark, first, spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string"), str(tmp_path / "v3"))
    assert sorted(map(tuple, spark.read.parquet(third).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert spark.read.parquet(new).count() == 2


def test_vector_size_is_checked(spark):
    import pytest

    good = spark.createDataFrame([([1.0, 2.0],)], "embedding array<float>")
    assert sinks.with_vector_size(good, 2).count() == 1
    with pytest.raises(Exception, match="vector size must be 3"):
        sinks.with_vector_size(good, 3).collect()


def test_attach_layout(spark):
    parsed = spark.createDataFrame([(1, 1, 0), (1, 2, 0)], "doc_id long, block_id long, item long")
    lines = spark.createDataFrame([(1, 1, None, "một dòng văn bản"), (1, 2, None, "dòng không có khung")], "doc_id long, block_id long, item long, line string")
    size = "page_size struct<width:double,height:double>"
    entries = spark.createDataFrame([(1, "mot dong van ban", [1.0], 4, (5.0, 6.0))], f"doc_id long, folded string, bbox array<double>, page_idx int, {size}")
    a, b = Y.attach_layout(parsed, lines, entries).orderBy("block_id").collect()
    assert a.page_indices == [4] and a.bboxes[0].page_idx == 4 and a.page_sizes[4].width == 5.0 and b.bboxes is None


def test_merged_chunks_take_the_boxes_of_all_their_items(spark):
    parsed = spark.createDataFrame([(1, 0, 1, [1, 2]), (1, 0, 3, None)], "doc_id long, block_id long, item long, items array<long>")
    lines = spark.createDataFrame([(1, 0, i, f"dòng thứ {w} của văn bản") for i, w in ((1, "nhất"), (2, "hai"), (3, "ba"))], "doc_id long, block_id long, item long, line string")
    entries = spark.createDataFrame(
        [(1, f"dong thu {w} cua van ban", [float(p)], p, None) for p, w in ((0, "nhat"), (4, "hai"), (7, "ba"))],
        "doc_id long, folded string, bbox array<double>, page_idx int, page_size struct<width:double,height:double>",
    )
    a, b = Y.attach_layout(parsed, lines, entries).orderBy("item").collect()
    assert (a.page_indices, [x.bbox for x in a.bboxes], a.page_sizes) == ([0, 4], [[0.0], [4.0]], {}) and b.page_indices == [7]


def test_texts_match_in_both_directions_like_brute_force(spark):
    rng = random.Random(5)
    words = ["an", "bình", "cộng", "dân", "em", "giáo", "hành", "ích"]
    make = lambda n: [" ".join(rng.choice(words) for _ in range(rng.randint(2, 12))) for _ in range(n)]
    lines = {(d, t) for d in (1, 2) for t in make(60)}
    entries = {(d, t) for d in (1, 2) for t in make(60)}
    for d, t in sorted(lines)[:60]:
        entries |= {(d, t[: rng.randint(8, 40)].strip()), (d, f"x {t} y"), (d, t)}
    frames = [spark.createDataFrame(list(rows), f"doc_id long, {c} string") for rows, c in ((lines, "line"), (entries, "entry"))]
    got = {tuple(r) for r in Y.match_texts(*frames).collect()}
    fits = lambda a, b: len(a) >= 10 and len(b) >= 8 and (a == b or (len(a) >= 20 and a in b) or (len(b) >= 20 and b in a))
    assert got == {(d, a, b) for d, a in lines for e, b in entries if d == e and fits(a, b)} and len(got) > 50


def test_ingested_chunks_have_the_pages_of_their_lines(spark):
    """Articles share the boxes of their block; sections have their own, also when merged; directories those of a unit."""
    from lawloom.plans.ingest import laid_out_chunks

    texts = {
        1: "Điều 1. Phạm vi điều chỉnh\nQuy chế này quy định về đào tạo đại học\nĐiều 2. Đối tượng áp dụng\nSinh viên chính quy của trường đại học",
        2: "Lời mở đầu của bản hướng dẫn\nI. Mục tiêu của chương trình\nĐào tạo nguồn nhân lực chất lượng cao\nII. Nội dung của chương trình\nCác học phần bắt buộc và tự chọn",
        3: "Thông báo không có đề mục nào\nNghỉ lễ từ ngày mai cho đến hết tuần",
        4: "Thông tin giảng viên\n=====\nĐơn vị: Khoa Công nghệ\nTên: Nguyễn Văn An\nĐiện thoại: 0123456789\n=====\nĐơn vị: Khoa Kinh tế học\nTên: Trần Thị Bình\nĐiện thoại: 0987654321",
        5: "Một văn bản không có bố cục trang",
    }
    pages = {}
    for d, text in texts.items():
        lines = [x for x in text.split("\n")]
        pages[d] = {x: i for i, x in enumerate(lines)}
    block = lambda x, i: {"bbox": [0, i, 9, i + 1], "lines": [{"spans": [{"type": "text", "content": x.upper()}]}]}
    layouts = [
        (d, json.dumps({"pdf_info": [{"page_idx": i, "page_size": [5, 6], "para_blocks": [block(x, i)]} for x, i in pages[d].items()]}))
        for d in texts if d != 5
    ]
    docs = spark.createDataFrame([(d, t, f"T{d}", str(d)) for d, t in texts.items()], "doc_id long, text string, title string, version_id string")
    rows = laid_out_chunks(docs, layouts=spark.createDataFrame(layouts, "doc_id long, layout string")).orderBy("document_id", "chunk_index").collect()
    got = [(r.document_id, r.chunk_type, list(r.metadata.page_indices), r.page_number, r.page_end) for r in rows]
    assert got[:2] == [(1, "regulation", [0, 1], 1, 2), (1, "regulation", [2, 3], 3, 4)]
    sections = [g for g in got if g[0] == 2]
    assert sorted(p for g in sections for p in g[2]) == [0, 1, 2, 3, 4] and sections[0][3] == 1
    assert [g for g in got if g[0] == 3] == [(3, "document_chunk", [0, 1], 1, 2)]
    units = [g for g in got if g[0] == 4]
    assert len(units) == 2 and set(units[0][2]) <= {2, 3, 4} and set(units[1][2]) <= {6, 7, 8} and all(g[2] for g in units)
    assert [g[1:] for g in got if g[0] == 5] == [("document_chunk", [], None, None)]
    assert all(b.bbox[1] == b.page_idx for r in rows for b in r.metadata.bboxes or [])


def test_evaluation_rows_are_numbered_over_files(spark, tmp_path):
    from lawloom.sources import files

    head = "test_id,question,expected_chunk_id,expected_document_id,expected_chunk_title,expected_keywords\n"
    for name, rows in (("a", 2), ("b", 1), ("c", 3)):
        body = "".join(f'{"x" if i == 1 else ""},"q {name}\n{i}",,,,\n' for i in range(rows))
        (tmp_path / f"{name}.csv").write_text(head + body, encoding="utf-8-sig")
    got = {r.question: r.test_id for r in files.read_evaluation_set(spark, str(tmp_path)).collect()}
    assert got == {"q a\n0": "row_1", "q a\n1": "x", "q b\n0": "row_3", "q c\n0": "row_4", "q c\n1": "x", "q c\n2": "row_6"}
    assert files.read_evaluation_set(spark, str(tmp_path), 3).count() == 3


def test_matching_deals_documents_once(spark):
    """Lines and entries are shuffled once by document; repeated and null parts match as the join of all pairs would."""
    lines = [(1, 0, "an bình cộng dân em giáo hành"), (1, None, "an bình cộng dân em giáo hành"), (1, 2, "dòng khác của văn bản"), (None, 3, "an bình cộng dân em giáo hành"), (1, 4, None)]
    entries = [(1, "an binh cong dan em giao hanh ich", [1.0]), (1, "an binh cong dan em giao hanh", None), (None, "an binh cong dan em giao hanh", [3.0]), (1, None, [4.0])]
    l_df = spark.createDataFrame(lines, "doc_id long, line_no long, line string")
    e_df = spark.createDataFrame(entries, "doc_id long, folded string, bbox array<double>").withColumn("page_idx", F.lit(0))
    e_df = e_df.withColumn("page_size", F.lit(None).cast("struct<width:double,height:double>"))
    found = Y.lines_to_layout(l_df, e_df, ["line_no"])
    got = {(r.line_no, tuple(r.bbox) if r.bbox else None) for r in found.collect()}
    assert got == {(n, b) for n in (0, None) for b in ((1.0,), None)}
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_corpus_files_are_listed_by_tasks(spark, tmp_path):
    """Folders at any depth, names with escapes and spaces, hidden and empty files; Spark plans no list of files."""
    deep = tmp_path / "a b" / "c%20d"
    deep.mkdir(parents=True)
    (deep / "Mục 1.TXT").write_bytes("điều".encode())
    (tmp_path / "a b" / "e+f.bin").write_bytes(b"123")
    (tmp_path / "_hidden").mkdir()
    for name in ("_hidden/x.txt", ".y.txt", "_z.txt", "empty.txt"):
        (tmp_path / name).write_bytes(b"" if name == "empty.txt" else b"no")
    found = files.scan_corpus(spark, str(tmp_path))
    want = {(f"file:{deep}/Mục 1.TXT", "txt", 7, True), (f"file:{tmp_path}/a b/e+f.bin", "bin", 3, False)}
    assert {(r.source_path, r.suffix, r.bytes, r.supported) for r in found.collect()} == want
    texts = files.read_corpus_texts(spark, f"file://{tmp_path}")
    assert [(r.source_path, r.raw_text) for r in texts.collect()] == [(f"file:{deep}/Mục 1.TXT", "điều")]
    assert "FileScan" not in found._jdf.queryExecution().executedPlan().toString()


def test_escaped_keys_of_child_blocks_count(spark):
    """Layouts that cannot have child blocks are not parsed to measure their depth; an escaped key is one that can."""
    block = {"bbox": [0, 0, 1, 1], "lines": [{"spans": [span("deepest", [0, 0, 1, 1])]}]}
    for _ in range(5):
        block = {"bbox": [0, 0, 1, 1], "blocks": [block]}
    text = json.dumps({"pdf_info": [{"page_idx": 0, "para_blocks": [block]}]}).replace('"blocks"', '"bl\\u006fcks"')
    plain = json.dumps({"pdf_info": [{"page_idx": 0, "para_blocks": [{"bbox": [0, 0, 1, 1], "lines": [{"spans": [span("flat")]}]}]}]})
    made = spark.createDataFrame([("d", text), ("e", plain)], "doc_id string, layout string")
    assert Y.nesting(made) >= 5 and Y.nesting(made.filter("doc_id = 'e'")) == Y.FIRST_LEVELS
    found = Y.layout_entries(made)
    assert {r.text for r in found.collect()} == {"deepest", "flat"}
    assert "layouts-" in found.inputFiles()[0]  # the layouts were written once


def counted(spark, kind="long"):
    """A counter, and a column function that adds each row that it is worked out for."""
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    return seen, F.udf(count, kind).asNondeterministic()


def test_chunk_rows_and_embedding_ids_read_the_chunks_once(spark, monkeypatch):
    from lawloom.plans import table_queries as Q

    rows = spark.createDataFrame(
        [("a", "1", 0), ("b", "1", 1), ("c", "2", 0), ("d", "2", 0)], "chunk_id string, version_id string, chunk_index long"
    )
    for query, expected in (
        (Q.snk_5_chunk_rows, [("1", 2, 1, False), ("2", 2, 0, True)]),
        (Q.snk_6_embedding_ids, [("a", 0, "p-a"), ("b", 1, None), ("c", 0, "p-c"), ("d", 0, "p-d")]),
    ):
        seen, count = counted(spark)
        chunks = rows.withColumns({"chunk_index": count("chunk_index"), "embedding_id": F.lit(None).cast("string"), "metadata": F.lit("m")})
        monkeypatch.setattr(Q, "chunk_table", lambda *_: chunks)  # noqa: B023
        assert sorted(tuple(r) for r in query(spark, "").collect()) == expected
        assert seen.value == 4


def test_chunk_artifacts_are_made_from_chunks_read_once(spark, tmp_path):
    seen, count = counted(spark)
    box = 'array<struct<bbox:array<double>,page_idx:int>>'
    meta = f"struct<source:string,page_sizes:map<int,struct<width:double,height:double>>,page_indices:array<int>,bboxes:{box},part:string>"
    sizes = {0: (595.0, 842.5), 12: (1e21, 1e-7)}
    rows = [
        (f"id{d}-{i}", d, i, 3, "document_chunk", None if i else 'Điều "1"\n\\', "", f"a\tb\n{d} đ {i} ", ("s", sizes if i else None, [0, 1], [([0.0, 1.5], 2)], None))
        for d in range(9) for i in (2, 0, 1)
    ]
    schema = f"chunk_id string, document_id long, chunk_index long, total_chunks long, chunk_type string, title string, section_path string, chunk_text string, metadata {meta}"
    plain = spark.createDataFrame(rows, schema)
    sinks.write_chunk_artifacts(plain.withColumn("total_chunks", count("total_chunks")), str(tmp_path), buckets=4)
    assert seen.value == len(rows)
    stored = spark.read.json(f"{tmp_path}/json").select("chunk_id", "chunk_text").collect()
    assert sorted(tuple(r) for r in stored) == sorted((r[0], r[7]) for r in rows)
    files_read = spark.read.text(f"{tmp_path}/text", wholetext=True).select("value").collect()
    blocks = {r.document_id: r.b for r in plain.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", sinks.chunk_block().alias("b")))).alias("b")).collect()}
    assert len(blocks) == 9
    for parts in blocks.values():
        whole = "".join(p.b + "\n\n" for p in parts)
        assert sum(whole in f.value for f in files_read) == 1


def test_entries_of_one_text_share_their_match_text(spark):
    block = lambda *texts: {"bbox": [0, 0, 9, 9], "lines": [{"bbox": [1, 1, 2, 2], "spans": [span(t)]} for t in texts]}
    pages = {"pdf_info": [{"para_blocks": [block("Ă  b"), block("Ă  b"), block("C", "c"), block("\u00a0"), block("C")]}]}
    rows = Y.layout_entries(layouts(spark, pages)).orderBy("entry_no").collect()
    assert [(r.text, r.folded) for r in rows] == [
        ("Ă  b", "a b")] * 4 + [("C", "c"), ("c", "c"), ("C c", "c c"), ("C", "c"), ("C", "c")]
