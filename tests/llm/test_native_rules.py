"""Quality line rules and URL rules: edge cases and brute force."""

import re

import pytest
from pyspark.sql import functions as F

from lawloom.llm import line_rules, url_rules
from lawloom.llm.line_rules import LineLimits

DOCS = "doc_id long, text string, source string, kept string, extra int"


def base_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    again = {p for places in at.values() if len(places) > 1 for i in places for p in range(i, i + 8)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again),
    )


TEXTS = [
    None, "", " \t\n\x0b\f\r ", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 40, "é ü 漢字 #*$ |<>&% a\u00a0b",
    "same line\nsame line\n\nsame line \nother", "\n".join(f"w{i % 9} v{i % 7}" for i in range(300)), "p q r s t u v w x " * 3,
    " ".join(f"t{i}" for i in range(5000)), "😀 😀😀 z",
]


def test_text_rules_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = df.select("i", line_rules.text_rules(F.col("t")).alias("r")).orderBy("i").collect()
    assert [tuple(r["r"]) for r in got] == [base_rules(t) for t in TEXTS]


def body(i, n=30):
    return " ".join(f"w{i}x{k}" for k in range(n))


def test_frequent_lines_and_depletion(spark):
    common = " ".join(f"License text {k}" for k in range(20))
    rows = [(i, f"{body(i)}\n{common.upper() if i % 2 else common}", "h", None, 1) for i in range(30)]
    rows += [(100 + i, f"{common}\nshort end number {i} " + body(i, 18), "h", None, 1) for i in range(3)]
    rows += [(200, f"{common}", "other", None, 1), (300, None, "h", None, 1), (301, "", None, None, 1)]
    limits = LineLimits(min_texts=10, host_percent=10, left_percent=30)
    got = {r.doc_id: r for r in line_rules.judge_documents(spark.createDataFrame(rows, DOCS), limits=limits).collect()}
    assert len(got) == len(rows)
    assert got[0].n_removed_words == 0 and got[0].kept  # the first holder keeps the line
    assert got[1].n_removed_words == 60 and got[1].kept
    assert got[100].n_removed_words == 60 and not got[100].kept and not got[100].base_failed
    assert got[200].kept and got[200].n_removed_words == 0  # another host
    assert got[300].n_words == 0 and got[300].base_failed and not got[301].kept
    assert "extra" in got[0].asDict()


def test_copies_do_not_make_their_lines_frequent(spark):
    rows = [(i, body(7, 40), "h", None, 1) for i in range(50)]
    got = line_rules.judge_documents(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 50 and all(r.kept and r.n_removed_words == 0 for r in got)


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, body(1), None, None, 1)] * 2 + [(5, body(2), "h", None, 1)] * 3
    got = line_rules.judge_documents(spark.createDataFrame(rows, DOCS))
    assert got.count() == 5 and got.filter("kept").count() == 5


def test_strip_removes_only_frequent_lines(spark):
    common = "cookie notice of this host shown everywhere"
    own = lambda i: " ".join(chr(97 + i) * (k + 1) for k in range(25))
    rows = [(i, f"{own(i)}\n{common}\nend {own(i)[::-1]}", "h", None, 1) for i in range(20)]
    got = {r.doc_id: r.text for r in line_rules.strip_frequent_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[0] == rows[0][1] and got[3] == f"{own(3)}\nend {own(3)[::-1]}"


def test_line_rules_on_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert line_rules.judge_documents(empty).count() == 0 and line_rules.strip_frequent_lines(empty).count() == 0


@pytest.mark.parametrize("make", [line_rules.judge_documents, lambda d: url_rules.judge_urls(d, "text")])
def test_plans_are_native(spark, make):
    plan = make(spark.createDataFrame([(1, "a", "h", None, 1)], DOCS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


URLS = [
    (1, "https://a.example.net/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"),
    (2, "https://a.example.net/fr/1", "a.example.net", "/fr/1", "net/", "block"),
    (3, "https://example.net", "example.net", "", None, "allow"),
    (4, "https://badexample.com/de/x?y=/de/", "badexample.com", "/de/x", None, "allow"),
    (5, "HTTP://WWW.Example.COM/de/?q", "www.example.com", "/de/", "example.com/de/", "block"),
    (6, "https://x.org/fr/#top", "x.org", "/fr/", "org/fr/", "allow"),
    (7, "https://spam-farm.example.org/en/728", "spam-farm.example.org", "/en/728", None, "block"),
    (8, "https://spam-farm.example.org/fr/728", "spam-farm.example.org", "/fr/728", "org/fr/", "allow"),
    (9, None, "", "", None, "allow"),
    (10, "no scheme/login", "", "", None, "block"),
    (11, "", "", "", None, "allow"),
    (12, "https://help.example.org/account/login", "help.example.org", "/account/login", None, "allow"),
    (13, "https://ads.example.org/banner", "ads.example.org", "/banner", None, "block"),
    (14, "a://b://c/d", "b:", "//c/d", None, "allow"),
    (1, "https://a.example.net/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"),
    (None, "x://y.net?/", "y.net", "", None, "allow"),
]


def test_url_verdicts(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u, *_ in URLS], "page_id long, url string, verdict string")
    got = url_rules.judge_urls(df).select("page_id", "url", "host", "path", "rule", "verdict").collect()
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(map(tuple, got), key=key) == sorted(URLS, key=key)


def test_rarest_token_is_the_key(spark):
    urls = spark.createDataFrame([("https://spam.org/cheap",), ("https://cheap.org/pills",), ("https://cheap.org/",)], "url string")
    rules = spark.createDataFrame(url_rules.PATTERN_RULES, url_rules.PATTERN_SCHEMA)
    keys = {r.id: r.key for r in url_rules.rule_index(urls, rules).collect()}
    assert keys["cheap-pills"] == "t:pills" and keys["spam-farm"] == "t:farm" and keys["adserver"] == "t:"


def test_many_rules_in_blocks_equal_brute_force(spark):
    """10,000 rules, some without tokens, in one block and in many; ties go to the first id."""
    patterns = [(f"r{i:05d}", rf"/word{i}(/|$)", [f"word{i}"], "allow" if i % 7 == 0 else "block") for i in range(9_990)]
    patterns += [(f"z{i}", rf"[?&]q={i}\b", [], "block") for i in range(10)]
    hosts = [(f"h{i}.org", "/a", "block" if i % 2 else "allow") for i in range(300)]
    urls = [f"http://s.h{i % 400}.org/{'a' if i % 3 else 'b'}/word{i * 37 % 12_000}/word{i % 50}?q={i % 20}" for i in range(400)] + [None, "", "q=1?q=1"]

    def judge(u):
        rest = (u or "").split("://", 1)
        host, path = (rest[1].split("?")[0].split("/", 1) + [""])[:2] if len(rest) == 2 else ("", "")
        fit = [(len(h + p), h + p, v) for h, p, v in hosts if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        hit = [(v != "allow", i, v) for i, p, v in compiled if u is not None and p.search(u)]
        return (max(fit)[2] if fit else min(hit)[2] if hit else "allow"), min(hit)[1] if hit else None

    compiled = [(i, re.compile(p), v) for i, p, _, v in patterns]
    want = sorted((i, *judge(u)) for i, u in enumerate(urls))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    given = spark.createDataFrame(hosts, url_rules.HOST_SCHEMA), spark.createDataFrame(patterns, url_rules.PATTERN_SCHEMA)
    for block in (url_rules.RULE_BLOCK, 3_000):
        got = url_rules.judge_urls(pages, "url", *given, block=block).select("page_id", "verdict", "pattern_rule").collect()
        assert sorted(map(tuple, got)) == want
    assert len({v for _, v, _ in want}) == 2 and sum(r is not None for *_, r in want) > 100


def test_urls_of_an_empty_table(spark):
    assert url_rules.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
