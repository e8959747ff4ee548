import random

from lawloom.operators import chunks as C
from lawloom.operators import segmentation as S


def parse(spark, *texts, **sizes):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = S.parse_documents(docs, **sizes).orderBy("doc_id", "chunk_index").collect()
    return [r for r in rows]


LINES = {"A": "Phụ lục II", "P": "Chương I", "M": "1. Sửa đổi khoản 2 Điều 3", "R": "Điều 4. Tên", "X": "nội dung"}


def brute_blocks(events):
    """A line-by-line reading of the block rules, with the amendment flag reset at every boundary."""
    blocks, open_kind, amending = [], None, False
    for e in events:
        if e == "A":
            open_kind, amending = "appendix", False
            blocks.append([open_kind, []])
        elif e == "P" and open_kind != "appendix":
            open_kind, amending = None, False
        elif e == "R" and not (open_kind == "article" and amending):
            if open_kind == "appendix":
                amending = False
            open_kind = "article"
            blocks.append([open_kind, []])
        else:
            if e == "M":
                amending = True
            if open_kind:
                blocks[-1][1].append(LINES[e])
    return [(k, "\n".join(t)) for k, t in blocks if t]


def test_blocks_against_sequential_reading(spark):
    rng = random.Random(11)
    cases = ["".join(rng.choice("APMRXXR") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    docs = spark.createDataFrame(
        [(i, "\n".join(LINES[e] for e in c)) for i, c in enumerate(cases)], "doc_id long, text string"
    )
    got = {}
    for r in S.major_blocks(S.document_lines(docs)).orderBy("doc_id", "block_id").collect():
        got.setdefault(r.doc_id, []).append((r.kind, r.content))
    for i, c in enumerate(cases):
        assert got.get(i, []) == brute_blocks(c), c


def test_quoted_article_is_absorbed(spark):
    text = "Điều 1. Sửa\n1. Sửa đổi Điều 5\nĐiều 5. Tên mới\nbody\n2. Bổ sung khoản 3 Điều 6\nthêm"
    rows = parse(spark, text)
    assert [(r.chunk_kind, r.target_article_number, r.content) for r in rows] == [
        ("amendment", "5", "Điều 5. Tên mới\nbody"),
        ("amendment", "6", "thêm"),
    ]
    assert rows[0].action == "modify" and rows[1].action == "supplement" and rows[1].target_clause_text == "3"


def test_free_form_items_close(spark):
    lines = ["Bãi bỏ Điều 2", "a", "1. Sửa đổi khoản 2 Điều 3", "b", "Bổ sung Điều 4", "c"]
    df = spark.createDataFrame([(0, 0, i, x) for i, x in enumerate(lines)], "doc_id long, block_id long, line_no int, line string")
    items = S.free_form_items(df, ["doc_id", "block_id"]).orderBy("item").collect()
    assert [(r.title, r.content) for r in items] == [("Bãi bỏ Điều 2", "a"), ("Bổ sung Điều 4", "c")]


def test_long_articles_and_appendices(spark):
    body = "x" * 40
    article = f"Điều 1. Dài\nmở đầu\n1. một\n{body}\n2. hai\n{body}"
    rows = parse(spark, article, max_chars=60)
    assert [(r.title, r.content) for r in rows] == [
        ("Điều 1. Dài > 1. một", f"mở đầu\n{body}"),
        ("Điều 1. Dài > 2. hai", body),
    ]
    plain = parse(spark, f"Điều 1. Dài\n{body}\n{body}", max_chars=60)
    assert [r.content for r in plain] == [f"{body}\n{body}"]
    appendix = f"Phụ lục I\nI. Phần\nđầu\na) điểm a\n{body}\n- gạch\n{body}\nII. Khác\nngắn"
    rows = parse(spark, appendix, max_chars=60)
    assert [(r.title, r.content, r.heading_level) for r in rows] == [
        ("Phụ lục I > I. Phần > a) điểm a", f"đầu\n{body}", 3),
        ("Phụ lục I > I. Phần > - gạch", body, 4),
        ("Phụ lục I > II. Khác", "ngắn", 1),
    ]


def brute_merge(sections, max_chars, min_chars):
    out = []
    for level, title, content in sections:
        if out:
            left = out[-1]
            fits = len(left[2]) + len(content) + len(title) + 2 <= max_chars
            if level != 1 and not level < left[0] and fits and len(left[2]) < min_chars:
                left[2] = f"{left[2]}\n\n{title}\n{content}"
                continue
        out.append([level, title, content])
    return [c for _, _, c in out]


def test_section_merge_against_brute_force(spark):
    rng = random.Random(3)
    docs, expected = [], []
    for i in range(60):
        sections = []
        for n in range(rng.randint(1, 9)):
            level = rng.choice([1, 2, 2, 3])
            title = {1: "IV. phần", 2: f"{n + 1}. mục", 3: f"{n + 1}.1 tiểu mục"}[level]
            sections.append((level, title, "y" * rng.randint(1, 30)))
        docs.append("\n".join(f"{t}\n{c}" for _, t, c in sections))
        expected.append(brute_merge(sections, 60, 25))
    rows = parse(spark, *docs, max_chars=60, min_section_chars=25)
    got = {}
    for r in rows:
        assert r.chunk_kind == "section"
        got.setdefault(r.doc_id, []).append(r.content)
    assert [got[i] for i in range(60)] == expected


def test_fallback_keeps_the_whole_text(spark):
    rows = parse(spark, "# tựa đề\n\n12\nhai dòng", "   ", None)
    assert [(r.chunk_kind, r.title, r.content) for r in rows] == [("unknown", "tựa đề", "# tựa đề\n\n12\nhai dòng")]


def test_directory_documents(spark):
    text = (
        "Thông tin giảng viên\n=====\nĐơn vị: Khoa A\nTên: Nguyễn B\nThông tin: TS\nĐiện thoại: 0123\nEmail: b@x.vn\n"
        "=====\nTên: Họ và tên\nThông tin: x\nĐiện thoại: 1\nEmail: c@y.vn\n=====\nĐơn vị: Khoa A\nTên: C\nThông tin:\nĐiện thoại: 9\nEmail: no"
    )
    (r,) = parse(spark, text)
    assert (r.chunk_kind, r.lecturer_unit, r.total_chunks) == ("Lecturer", "Khoa A", 1)
    assert [p.name for p in r.lecturers] == ["Nguyễn B", "C"]
    assert r.content.endswith("2. Tên: C\n Điện thoại: 9")
    (bare,) = parse(spark, "Thông tin giảng viên\nchỉ có chữ")
    assert bare.chunk_kind == "unknown"


def test_html_table_in_document(spark):
    (r,) = parse(spark, "Điều 1. Bảng\n<table><tr><td>a</td></tr><tr><td>b</td></tr><tr><td>c</td></tr></table>")
    assert r.content == "| a - b |\n| --- |\n| c |"


def test_chunk_rows_are_deterministic(spark):
    docs = spark.createDataFrame([(1, "Điều 1. A\nx\nĐiều 2. B\ny", "T", "v1")], "doc_id long, text string, title string, version_id string")
    build = lambda: C.build_chunks(S.parse_documents(docs, carry=("title", "version_id"))).orderBy("chunk_index").collect()
    a, b = build(), build()
    assert [r.chunk_id for r in a] == [r.chunk_id for r in b] and len({r.chunk_id for r in a}) == 2
    assert a[0].chunk_text == "Tài liệu: T\nLoại chunk: Điều trong văn bản\nĐiều: Điều 1. A\nNội dung:\nx"
    assert a[0].metadata.document_version_id == "v1" and a[1].metadata.article_number == "2"


def test_every_line_lands_in_at_most_one_item(spark):
    rng = random.Random(8)
    pool = [*LINES.values(), "1. mục", "a) điểm", "Bãi bỏ Điều 9", "12", "# Điều 7. X"]
    docs = spark.createDataFrame(
        [(i, "\n".join(f"{rng.choice(pool)} " for _ in range(15))) for i in range(200)], "doc_id long, text string"
    )
    lines = S.document_lines(docs)
    items = S.item_lines(S.block_lines(S.line_events(lines)))
    assert items.groupBy("doc_id", "line_no").count().filter("count > 1").count() == 0


def test_segmentation_shuffles_documents_once(spark):
    docs = spark.createDataFrame([(1, "Điều 1. A\nx")], "doc_id long, text string")
    parsed = S.number_chunks(S.merge_small_sections(S.parse_items(S.item_lines(S.block_lines(S.line_events(S.document_lines(docs)))))))
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1, plan[:3000]


def test_section_headings(spark):
    docs = spark.createDataFrame([(1, "Chương II: A\n\nmục 3 B\nĐiều 4. C\nkhác")], "doc_id long, text string")
    rows = S.section_headings(docs).orderBy("line_index").collect()
    assert [(r.level, r.number, r.line_index) for r in rows] == [("chapter", "II", 0), ("section", "3", 2), ("article", "4", 3)]


def test_partitions_grow_with_the_text(spark, monkeypatch):
    """A task has a bounded share of the characters, so its sorts do not grow with the input."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, f"Điều {i}. A\nx") for i in range(64)], "doc_id long, text string")
    count = lambda: S.document_lines(docs).select(F.spark_partition_id().alias("p")).distinct().count()
    assert count() <= spark.sparkContext.defaultParallelism
    monkeypatch.setattr(S, "PARTITION_CHARS", 10)
    assert count() > 2 * spark.sparkContext.defaultParallelism


def test_texts_are_worked_out_once(spark):
    """The optimizer copies what a filter tests, and a repair that names its text twice runs all steps before it twice."""
    docs = spark.createDataFrame([(1, "Điều 1. Tên\nnội dung")], "doc_id long, text string")
    repaired = docs.select(S.prepare_text(docs["text"]).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert repaired.count("(?:điểu|diểu|diều|dieu)") == 1
    items = S.parse_items(S.item_lines(S.block_lines(S.line_events(S.document_lines(docs)))))
    assert items._jdf.queryExecution().optimizedPlan().toString().count(r"ten\s+(.+?)\s+thanh") == 1


def test_grouping_of_sections_has_no_copy_in_a_filter(spark):
    docs = spark.createDataFrame([(1, "1. Một\nhai\n2. Ba\nbốn")], "doc_id long, text string")
    plan = S.parse_documents(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("lambda y") and plan.count("= section)") <= 6  # one copy tests the kind so often, two more did before
