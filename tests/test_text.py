import random
import re
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from lawloom.functions import legal as L
from lawloom.functions import text as T
from lawloom.functions.tables import html_tables_to_markdown, table_markdown


def test_ocr_repair(one):
    assert one("theo diều 5 và Điểu 7a", T.repair_ocr) == "theo Điều 5 và Điều 7a"
    assert one("§ . Sửa đổi khoản 2", T.repair_ocr) == "8. Sửa đổi khoản 2"
    assert one("abc § bổ sung điều 3", T.repair_ocr) == "abc\n8. bổ sung điều 3"
    assert one("§ mục khác", T.repair_ocr) == "§ mục khác"


def test_footnotes(one):
    assert one("2.8 Đối với A\n2.8 Other", T.drop_footnote_markers) == "2. Đối với A\n2.8 Other"


def test_appendix_titles(one):
    assert one("Phụ lục II Bảng điểm 1. Thang", T.split_appendix_titles) == "Phụ lục II\nBảng điểm\n1. Thang"
    assert one("Phụ lục 3 Mẫu đơn", T.split_appendix_titles) == "Phụ lục 3\nMẫu đơn"
    assert one("theo Phụ lục II nhé", T.split_appendix_titles) == "theo Phụ lục II nhé"


def test_trailing_headings(one):
    line = "Bảng quy đổi chứng chỉ ngoại ngữ 1. Tiếng Anh"
    assert one(line, T.split_trailing_headings) == "Bảng quy đổi chứng chỉ ngoại ngữ\n1. Tiếng Anh"
    assert one("Một dòng văn bản thường dài 1. Tiếng Anh", T.split_trailing_headings) == (
        "Một dòng văn bản thường dài 1. Tiếng Anh"
    )


def test_inline_headings(one):
    assert one("hết. Điều 6. Phạm vi", T.split_inline_headings) == "hết.\nĐiều 6. Phạm vi"
    for word in ("theo", "tại", "xem", "căn cứ", "quy định tại"):
        assert one(f"abc {word} Điều 6. Phạm vi", T.split_inline_headings) == f"abc {word} Điều 6. Phạm vi"
    assert one("mtai Điều 6: x", T.split_inline_headings) == "mtai\nĐiều 6: x"


def test_tables(one):
    html = (
        "<table><tr><td rowspan=2>A</td><td colspan='2'>B|C</td></tr><tr><td>D</td><td>E</td></tr>"
        "<tr><td>1</td></tr></table>"
    )
    expected = "\n| A | B\\|C - D | E |\n| --- | --- | --- |\n| 1 |  |  |\n"
    assert one(html, table_markdown) == expected
    assert one(f"x {html} y", html_tables_to_markdown) == f"x {expected} y"
    assert one("<table><tr><th>a &amp; b</th></tr></table>", table_markdown) == "\n| a & b |\n| --- |\n"
    assert one("<table></table>", table_markdown) == "<table></table>"


def test_html_blocks(one):
    html = "a<div>Phụ <b>lục</b> &amp; &#233;&nope;<!-- x --></div>b <span>c</span><p> </p>"
    assert one(html, T.html_blocks_to_text) == "a\nPhụ lục & é&nope;\nb c\n"


def _settled(c):
    """Assigned long ago, and in the same category ever since."""
    old = unicodedata.ucd_3_2_0.category(c)
    return old not in ("Cn", "Cs", "Co") and old == unicodedata.category(c)


def test_fold_equals_unicode_rule(spark):
    """Every character that Unicode has long had, so that all engines know it."""
    from pyspark.sql import functions as F

    chars = [c for c in map(chr, range(0x21, 0x110000)) if _settled(c)]
    rows = spark.createDataFrame([(c,) for c in chars], "c string").select("c", T.fold(F.col("c")).alias("f")).collect()
    wrong = []
    for r in rows:
        plain = unicodedata.normalize("NFD", r.c.lower())
        expected = "".join(x for x in plain if unicodedata.category(x) != "Mn").replace("đ", "d")
        if r.f != expected:
            wrong.append((r.c, hex(ord(r.c)), r.f, expected))
    assert not wrong, wrong[:20]


def test_long_character_references(one):
    assert one("<p>&#0000000000065;&#x00000000042; &#99999999999; &#xD800; &#0;</p>", T.html_blocks_to_text) == "\nAB \ufffd \ufffd \ufffd\n"


def test_reference_word_far_before_a_mention(one):
    far = "xem" + " " * 40 + "Điều 5. x"
    assert one(f"a {far}", T.split_inline_headings) == f"a {far}"
    assert "\nĐiều 5" in one("xong Điều 5. x", T.split_inline_headings)


def test_clean_small(one):
    text = "Chương I\nmột dòng\nbị ngắt\n\n\n\n1. mục\ntiếp.\nMới\n"
    assert one(text, T.clean) == "Chương I\nmột dòng bị ngắt\n\n1. mục tiếp.\nMới"
    assert one("", T.clean) == ""


_line = st.sampled_from(["", "a", "b.", "- c", "Điều 5", "mục 2 x", "d:", "1. e", "chương iv", "f\tg", "  h "])


def _brute_clean(lines):
    import re

    head = re.compile(r"(chương|chuong)\s+[ivxlcdm0-9]+\b|(mục|muc|mic)\s+\d+\b|(điều|dieu)\s+\d+\b", re.I)
    bullet = re.compile(r"\s*(\d+\.|[a-z]\)|-|\+)\s+")
    out, open_text = [], False
    for line in (re.sub(r"[ \t\xa0]+", " ", x).strip() for x in lines):
        joins = open_text and line and not head.match(line) and not bullet.match(line) and out[-1][-1] not in ".:;?!"
        if joins:
            out[-1] += " " + line
        else:
            out.append(line)
        open_text = bool(line) and not head.match(line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


def test_clean_against_sequential_rule(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(5)
    pool = ["", "a", "b.", "- c", "Điều 5", "mục 2 x", "d:", "1. e", "chương iv", "f\tg", "  h "]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    once = T.clean(F.col("t"))
    for r in df.select("t", once.alias("c"), T.clean(once).alias("cc")).collect():
        assert r.c == _brute_clean(r.t.split("\n")), r.t
        assert T.clean is not None and r.cc is not None


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(_line, max_size=8))
def test_parser_lines_carry_text(one, lines):
    from pyspark.sql import functions as F

    kept = one("\n".join(lines), lambda c: F.transform(T.text_lines(c), T.parser_line))
    assert all(k is None or k.strip() == k and k for k in kept)


def test_amendment_titles(spark):
    from pyspark.sql import functions as F

    cases = {
        "1. Sửa đổi điểm a khoản 2 Điều 7": ("modify", "a", "2", "7"),
        "Bổ sung khoản 3, Điều 9a": ("supplement", None, "3", "9a"),
        "Thay thế Điều 12": ("replace", None, None, "12"),
        "Sửa đổi tên Trường thành Đại học": ("rename", None, None, None),
        "Bãi bỏ khoản 4": ("repeal", None, None, None),
        "bai bo dieu 5": ("repeal", None, None, "5"),
    }
    df = spark.createDataFrame([(k,) for k in [*cases, "Không liên quan"]], "t string")
    t = F.col("t")
    got = {r.t: r.a for r in df.select("t", L.parse_amendment(t, T.fold(t)).alias("a")).collect()}
    for title, expected in cases.items():
        assert tuple(got[title]) == expected, title
    assert got["Không liên quan"] is None


def test_inner_headings(spark):
    from pyspark.sql import functions as F

    cases = {
        "IV. Tên": ("roman", "IV", 1),
        "iv. ten": None,
        "a) điểm": ("point", "a", 3),
        "- gạch": ("bullet", None, 4),
        "1.2. Tên": ("numbered", "1.2", 3),
        "2. Tên": ("clause", "2", 2),
        "123 Nguyễn Lương Bằng": ("clause", "123", 2),
        "1.000 sinh viên": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    t = F.col("t")
    rows = df.select("t", L.inner_heading(t).alias("h"), L.accepted_heading(t, "clause").alias("a")).collect()
    for r in rows:
        assert (tuple(r.h) if r.h else None) == cases[r.t], r.t
        assert (r.a is not None) == (r.t == "2. Tên"), r.t


def test_spans_of_tables_are_bounded(one):
    wide = one("<table><tr><td colspan=3000000 rowspan=99999999>a</td><td>b</td></tr><tr><td>c</td></tr></table>", table_markdown)
    header = wide.split("\n")[1].split(" | ")
    assert len(header) == 1001 and header[0] == "| a" and header[-1] == "b - c |"
    odd = "<table><tr><td colspan='0' rowspan=x>a<td colspan=2x>b<!-- <tr><td>no --></tr><tr></tr><tr><td>c</td>lost</table>"
    assert one(odd, table_markdown) == "\n| a | b |\n| --- | --- |\n| c |  |\n"


def test_a_cell_reaches_down_over_several_rows(one):
    html = "<table><tr><td>h<td>i<td>j</tr><tr><td>k<td>l<td>m</tr><tr><td rowspan=3>A<td>1<td rowspan=2>B</tr><tr><td>2</tr><tr><td>3</tr></table>"
    assert one(html, table_markdown) == "\n| h - k | i - l | j - m |\n| --- | --- | --- |\n| A | 1 | B |\n| A | 2 | B |\n| A | 3 |  |\n"


def test_quick_tests_change_nothing(spark):
    """Texts with marks, blanks and capitals of all kinds: what the quick tests let through is what the full rules find."""
    rng = random.Random(5)
    parts = ["1", ".", " ", "\t", "\u0301", "\u00a0", "\u3000", "\x1c", "#", "Sửa", "đổi", "SỬA ĐỔI", "sua doi", "bổ sung", "Bo\u0302\u0309",
             "Điều 5", "DIEU 7", "khoản 2", "Phụ lục", "PHỤ LỤC II", "phu\u0323 lu\u0323c", "İ", "x", "12", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    texts += ["", "1. Sửa đổi Điều 5", "\u03011. SU\u031b\u0309A ĐÔ\u0309I điều 5", "bãi bỏ khoản 2", "###### 7", "#######", "a\n  b"]
    t, line = F.col("t"), F.translate("t", "\n", " ")
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select(
        "t", T.strip(t).alias("strip"), T.parser_line(line).alias("parsed"), line.alias("line"),
        L.opens_amendment_title(line).alias("title"), L.is_amendment_title(T.fold(line)).alias("title_all"),
        L.opens_free_form_amendment(line).alias("free"), L.is_free_form_amendment(T.fold(line)).alias("free_all"),
        t.rlike(T.may_fold_to(T.TRAILING_PHRASES)).alias("may"), T.fold(t).rlike(T.TRAILING_PHRASES).alias("has"),
    )
    found = rows.collect()
    for r in found:
        assert r.strip == r.t.strip(), repr(r.t)
        x = re.sub(r"^\s*#{1,6}\s*", "", r.line.strip()).strip()
        assert r.parsed == (None if not x or re.fullmatch(r"\d{1,3}", x) else x), repr(r.t)
        assert (r.title, r.free) == (r.title_all, r.free_all) and r.may >= r.has, repr(r.t)
    assert all(any(getattr(r, c) for r in found) for c in ("title", "free", "has"))
