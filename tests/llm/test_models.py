"""Classifier, extraction, language ID and raking: held-out accuracy, gradients, brute force and edge cases."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lawloom.llm import html_mincut as H
from lawloom.llm import language_zstd as L
from lawloom.llm import passage_mil as M
from lawloom.llm import raking as R

SF = "/root/testdata/sf0.01"


# --- passages -----------------------------------------------------------


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    x, starts, y = rng.normal(size=(11, M.N_FEATURES)), np.array([0, 3, 4, 9]), np.array([1.0, 0, 1, 0])
    shapes = {"encode": (M.N_FEATURES, M.HIDDEN), "encode_b": (M.HIDDEN,), "tanh": (M.HIDDEN, M.GATES), "gate": (M.HIDDEN, M.GATES),
              "attend": (M.GATES,), "out": (M.HIDDEN,), "out_b": (1,)}
    w = {k: rng.normal(size=s) * 0.3 for k, s in shapes.items()}

    def loss():
        p = M._forward(x, starts, w)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for k, d in M._gradients(x, starts, y, w).items():
        for at in list(np.ndindex(w[k].shape))[:: max(1, w[k].size // 7)]:
            w[k][at] += 1e-6
            up = loss()
            w[k][at] -= 2e-6
            down = loss()
            w[k][at] += 1e-6
            assert abs((up - down) / 2e-6 - d[at]) < 1e-5


def test_attention_sums_to_one():
    rng = np.random.default_rng(2)
    model = M.fit([rng.normal(size=(n, M.N_FEATURES)) for n in (1, 2, 5, 3) * 5], np.array([0, 1, 1, 0] * 5, float))
    f = M._forward(rng.normal(size=(6, M.N_FEATURES)), np.array([0, 2]), model.weights)
    assert np.allclose(np.add.reduceat(f["a"], [0, 2]), 1)


def test_quality_on_held_out_rows(spark):
    import __spark_entry__ as entry

    got = entry.queries()["op3_passage_mil"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    right = got.join(labels, "doc_id").filter("held_out").select(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert right[0] > 0.95 and right[1] > 80
    assert got.filter("score IS NULL OR score < 0 OR score > 1").count() == 0


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate([None, "", "a b", "x " * 9000] * 2)] + [(None, "z", 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)] + [(2, None), (3, 1), (None, 1)], "doc_id long, quality int")
    model = M.fit_quality(docs, labels, F.lit(True))
    got = M.score_documents(docs, model).collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert M.fit_quality(docs, labels.filter("quality = 1"), F.lit(True)).constant > 0.5
    assert M.score_documents(docs.limit(0), model).count() == 0
    assert M.fit_quality(docs, labels.limit(0), F.lit(True)).constant == 0.5


# --- extraction ---------------------------------------------------------


def brute_cut(gain, edges):
    cost = lambda x: sum(max(0, g) if not k else max(0, -g) for g, k in zip(gain, x, strict=True)) + sum(w for i, j, w in edges if x[i] != x[j])
    return min(cost(x) for x in itertools.product((False, True), repeat=len(gain))), cost


def test_cut_is_minimal():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 9)
        gain = np.array([rng.choice([rng.uniform(-2, 2), 0.0]) for _ in range(n)])
        edges = [(i, j, rng.uniform(0.1, 1.5)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4]
        best, cost = brute_cut(gain, edges)
        assert abs(cost(H.minimum_cut(gain, edges).tolist()) - best) < 1e-9


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href="/a>b">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<main><article><header><h1>Head&amp;line</h1></header><p>First <b>par</b>agraph&nbsp;with
 a <a href=x>link</a>.<p>Second &lt;one&gt; &#233;<br>line<script>var x = "</p>";</script> end<!-- <p>no</p> -->.
<table><tr><td>a<td>b</table><aside>Related things</aside><form><label>Mail</label><input></form><p>text <span class="ad">BUY</span>more</p>
<section id="comments"><article class="comment"><p>Nice post</p></article></section></article></main>
<div id="sidebar"><p>Some long sidebar text, with a sentence or two in it. And more.</p></div><footer>&copy; me</footer></body></html>"""


def test_page_with_everything():
    text = H.main_text(PAGE, np.array(H.PRIOR))
    assert text == "Head&line First paragraph with a link. Second <one> é line end. a b text more"


def test_broken_pages():
    zero = np.array(H.PRIOR)
    assert H.main_text(None, zero) == H.main_text("", zero) == H.main_text("<script>x", zero) == H.main_text("<!-- a", zero) == ""
    assert H.main_text("<article>a < b &bogus; <p title='x", zero) == "a < b &bogus; <p title='x"
    assert H.main_text("<article>" + "<div>" * 500 + "deep", zero) == "deep"
    assert H.main_text("<article></p></div>x</article>" * 2, zero) == "x x"


LINES = [
    "The council met on Monday evening to decide on the budget for the coming year, and the debate went on for hours.",
    "Several members asked for more money for schools, while others pointed to the state of the roads and bridges.",
    "In the end a narrow majority voted for the plan, which will now go to the regional office for a last review.",
    "Residents who want to comment can write to the office until the end of the month, said the mayor on Tuesday.",
]
MENU = "".join(f'<li><a href="/{i}">Page {i}</a></li>' for i in range(8))


def page(article, before="", after="", outer="div", attributes=""):
    return f"<html><body><div><ul>{MENU}</ul></div>{before}<{outer} {attributes}>{article}</{outer}>{after}<div><a href=/>Legal</a> <a href=/x>Terms</a></div></body></html>"


def paragraphs(lines=LINES, inner=""):
    return "".join(f"<p>{x}</p>{inner}" for x in lines)


def test_pages_without_helpful_landmarks():
    """No article or main element, a class name that says the opposite, and the whole body in one form."""
    weights, text = np.array(H.PRIOR), " ".join(LINES)
    assert H.main_text(page(paragraphs()), weights) == text
    assert H.main_text(page(paragraphs(), attributes='class="page-header sidebar-right"'), weights) == text
    whole = "<html><body><form action=/x>" + page(paragraphs())[12:-14] + "</form></body></html>"
    assert H.main_text(whole, weights) == text


def test_the_cut_changes_labels(monkeypatch):
    """Short blocks inside the text follow it, and what looks like text among links follows the links."""
    ran, flow = [], H._max_flow
    monkeypatch.setattr(H, "_max_flow", lambda nodes, *rest: (ran.extend(nodes), flow(nodes, *rest))[1])
    weights = np.array(H.PRIOR)
    found = H.blocks_of(page("<h2>Vote</h2>" + paragraphs(inner="<div>Yes.</div>")))
    alone, cut = H.gains(found, weights) > 0, H.minimum_cut(H.gains(found, weights), H.smoothness(found))
    kept = [b.text for b, k in zip(found, cut) if k]
    assert (alone != cut).sum() >= 3 and kept[0] == "Vote" and kept.count("Yes.") >= 3 and "Page 1" not in kept
    rng = random.Random(2)
    for _ in range(40):  # made-up pages on which neither evidence nor edges settle all at once
        parts = [rng.choice(["<p>Short words here now.</p>", f"<p>{rng.choice(LINES)}</p>", "<li><a href=x>Go on</a> or stay</li>"]) for _ in range(30)]
        blocks = H.blocks_of("<body>" + "".join(parts))
        gain, edges = H.gains(blocks, weights), H.smoothness(blocks)
        cost = lambda x: np.where(x, np.maximum(0, -gain), np.maximum(0, gain)).sum() + sum(w for i, j, w in edges if x[i] != x[j])  # noqa: E731, B023
        assert cost(H.minimum_cut(gain, edges)) <= cost(gain > 0) + 1e-9
    assert len(ran) > 0


def test_any_page_takes_time_in_proportion():
    import time

    weights = np.array(H.PRIOR)
    bad = ["<a", "<script ", "<a href='", '<a ">" ', "<a \"'>", "<!", "<!--", "</p", "<p title=\">\" '", "<div>x", "<b><p>y</b>", "</div>", "<a 'x\"> "]
    for piece in bad:
        text = piece * (1_000_000 // len(piece))
        for t in (text, text + ">", text + "'\">"):
            start = time.process_time()
            found = list(H._Tags(t))
            assert time.process_time() - start < 8, piece
            assert all(a < b for a, b, *_ in found)
    start = time.process_time()
    H.main_text("<div>x" * 20_000 + "</div>" * 20_000, weights)
    assert time.process_time() - start < 60


def test_text_of_foreign_elements_stays():
    inner = "<noscript>Seen without scripts.</noscript><math><mi>x</mi><mo>=</mo><mn>2</mn></math><svg><text>A label.</text></svg>"
    text = H.main_text(f"<article>{paragraphs()}<p>Formula: {inner}</p></article>", np.array(H.PRIOR))
    assert text == " ".join([*LINES, "Formula: Seen without scripts.x=2A label."])


def test_extract_edges(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 5), (None, None, None, 5), (1, "u", PAGE, 5)], "page_id long, url string, html string, n_chars long")
    got = H.extract(df, H.fit_classifier(df)).collect()
    assert sorted(r.n_chars for r in got) == [0, 77, 77] or all(r.n_chars == len(r.text) for r in got)
    assert H.extract(df.limit(0), H.fit_classifier(df.limit(0))).count() == 0


def test_articles_of_the_given_pages(spark):
    """The given pages have one article element each; its text by a plain regular expression."""
    import html
    import re

    import __spark_entry__ as entry

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = entry.queries()["op4_html_mincut"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        inside = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        plain = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)[^>]*>", " ", inside))
        assert r.text == " ".join(html.unescape(plain).split()) and r.n_chars == len(r.text)


# --- languages ----------------------------------------------------------


def test_languages_on_held_out_rows(spark):
    import __spark_entry__ as entry

    got = entry.queries()["op8_language_zstd"](spark, SF)
    langs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    right = got.join(langs, "doc_id").filter("held_out").select(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert right[0] > 0.97 and right[1] > 200
    assert got.filter(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)).count() == 0


def test_language_edges(spark):
    rows = [(1, "the cat sat on the mat " * 9, "en"), (2, "der Hund und die Katze " * 9, "de"), (3, None, "en"), (4, "", None), (5, "12 .. !", "en")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows * 2], "doc_id long, text string, lang string, score double")
    model = L.fit_languages(df)
    got = {r.doc_id: r for r in L.identify(df, model).collect()}
    assert (got[1].lang_pred, got[2].lang_pred) == ("en", "de") and got[1].accepted and 0.5 < got[1].score <= 1
    assert all((got[i].lang_pred, got[i].score, got[i].accepted) == ("und", 0.0, False) for i in (3, 4, 5))
    assert L.identify(df.limit(0), model).count() == 0
    assert {r.lang_pred for r in L.identify(df, L.fit_languages(df.limit(0))).collect()} == {"und"}


def test_copies_do_not_empty_the_dictionary(spark):
    """A language of 40 texts and 200,000 copies of one more; another of 600 texts, each 300 times."""
    few = [("en", f"{chr(97 + i % 26) * 3} the cat number {chr(97 + i // 26)} sat on mats") for i in range(40)]
    many = [("de", f"{chr(97 + i % 26)}{chr(97 + i // 26)} der hund und die katze") for i in range(600)]
    once = spark.createDataFrame([*few, *many, ("en", "hot text of all")], "lang string, text string")
    copies = spark.range(200_000).selectExpr("'en' AS lang", "'hot text of all' AS text")
    repeated = once.filter("lang = 'de'").crossJoin(spark.range(299)).select("lang", "text")
    model, want = L.fit_languages(once.union(copies).union(repeated)), L.fit_languages(once)
    assert model.dictionaries == want.dictionaries and all(L.letters(t) in model.dictionaries["en"] for _, t in few)
    assert sum(L.letters(t) in model.dictionaries["de"] for _, t in many) == L.SAMPLE_TEXTS
    docs = spark.createDataFrame([("hot text of all",), ("the cat sat on mats",)], "text string")
    assert {r.lang_pred for r in L.identify(docs, model).collect()} == {"en"}


# --- raking -------------------------------------------------------------


def brute_rake(cells, targets, rounds=500):
    w = {k: float(v) for k, v in cells.items()}
    for _ in range(rounds):
        for d, goal in enumerate(targets):
            sums = {}
            for k, v in w.items():
                sums[k[d]] = sums.get(k[d], 0) + v
            w = {k: v * goal[k[d]] / sums[k[d]] for k, v in w.items()}
    return w


def test_raking_equals_brute_force(spark):
    rng = random.Random(8)
    cells = {(f"s{i}", f"l{j}", f"t{k}"): rng.randint(1, 900) for i in range(12) for j in range(3) for k in range(4) if rng.random() < 0.9}
    sums = lambda d: {v: sum(n for c, n in cells.items() if c[d] == v) for v in {c[d] for c in cells}}
    goals = [R.tempered(sums(d), 0.5) for d in range(3)]
    fit = R.rake(spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, w long"), power=0.5)
    source = {r.source: r.factor for r in fit.sources.collect()}
    want = brute_rake(cells, goals)
    for (s, la, t), n in cells.items():
        assert source[s] * fit.langs[la] * fit.topics[t] * n == pytest.approx(want[s, la, t], rel=1e-4)


def test_given_targets_and_expected_tokens(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    targets = {"langs": {"en": 0.4, "fr": 0.3, "de": 0.2, "es": 0.1, "xx": 0.5}, "trim": 0.0}
    got = R.sample_to_targets(df, carry=["doc_id", "lang"], **targets).select("row.*", "n_tokens", "probability", "sampled").collect()
    assert len(got) == 1000 and all(0 < r.probability <= 1 for r in got)
    mass = {k: sum(r.n_tokens * r.probability for r in got if r.lang == k) for k in ("en", "fr", "de", "es")}
    for k, share in zip(mass, (0.4, 0.3, 0.2, 0.1), strict=True):
        assert mass[k] / sum(mass.values()) == pytest.approx(share, abs=1e-4)
    expected, drawn = sum(r.probability for r in got), sum(r.sampled for r in got)
    assert abs(expected - drawn) < 4 * sum(r.probability * (1 - r.probability) for r in got) ** 0.5
    again = R.sample_to_targets(df.repartition(5), carry=["doc_id"], **targets).filter("sampled").select("row.doc_id").collect()
    assert {r.doc_id for r in again} == {r.doc_id for r in got if r.sampled}


def test_rare_cells_do_not_thin_out_the_others(spark):
    """A topic with hardly any token has a large weight; only its own documents are kept whole for it."""
    text = " ".join(f"common{i % 7}" for i in range(400))
    rows = [(i, text, "a" if i % 3 else "b", "en") for i in range(300)] + [(1000, "ab", "a", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r.probability for r in R.sample_to_targets(df, carry=["doc_id"]).select("row.doc_id", "probability").collect()}
    exact = {r.doc_id: r.probability for r in R.sample_to_targets(df, carry=["doc_id"], trim=0.0).select("row.doc_id", "probability").collect()}
    assert got[1000] == 1.0 and exact[1000] == pytest.approx(1.0) and min(got.values()) > 0.85 and min(exact.values()) < 0.5


def test_raking_edges(spark):
    rows = [(None, None, None, None, 1), (1, "", "a", "en", 1), (2, "word " * 50, "a", None, 1), (2, "word " * 50, "a", None, 1), (3, "longer words here", None, "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic int")
    got = R.sample_to_targets(df).collect()
    assert len(got) == 5 and all(0 < r.probability <= 1 for r in got)
    assert R.sample_to_targets(df.limit(0)).count() == 0


def test_topics():
    assert R.subject(["bbbbbb", "aaaaaa", "cc"]) == "aaaaaa" and R.subject(["a"]) is None
    assert R.topic_of(["wordword"]) == f"t{zlib.crc32(b'wordword') % R.TOPICS}" and R.topic_of([]) == "t-none"


def test_null_ids_draw_by_their_text(spark):
    rows = [(None, f"common words of text {i}", "a" if i % 4 else "b", "en") for i in range(800)] + [(1, "common words", "a", "en"), (None, None, "a", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = [r for r in R.sample_to_targets(df, power=0.3, trim=0.0).collect() if r.row.text and r.row.doc_id is None]
    assert sum(r.row.source == "a" and r.probability < 1 for r in got) == 600
    drawn, p = sum(r.sampled for r in got), [r.probability for r in got]
    assert abs(drawn - sum(p)) < 4 * sum(x * (1 - x) for x in p) ** 0.5
    other = [r for r in R.sample_to_targets(df.repartition(3), power=0.3, trim=0.0).collect() if r.row.text and r.row.doc_id is None]
    assert {r.row.text for r in got if r.sampled} == {r.row.text for r in other if r.sampled}


def test_topic_column(spark):
    kinds = ["law", "law", "law", None, "news"]
    df = spark.createDataFrame([(i, "same words here " * 5, "a", "en", kinds[i % 5]) for i in range(100)], "doc_id long, text string, source string, lang string, kind string")
    got = R.sample_to_targets(df, carry=["doc_id"], topic="kind", topics={"law": 0.5, "": 0.25, "news": 0.25}, trim=0.0)
    mass = {r[0]: r[1] for r in got.groupBy("topic").agg(F.sum(F.col("n_tokens") * F.col("probability"))).collect()}
    assert sorted(mass) == ["", "law", "news"] and got.columns == ["row", "topic", "n_tokens", "probability", "sampled"]
    assert mass["law"] == pytest.approx(2 * mass[""], rel=1e-4) and mass["news"] == pytest.approx(mass[""], rel=1e-4)


def test_sampling_keeps_a_column_named_draw(spark):
    df = spark.createDataFrame([(i, f"some words of text {i}", "en", "a", f"mine {i}") for i in range(20)], "doc_id long, text string, lang string, source string, _draw string")
    got = R.sample_to_targets(df).select("row.*", "sampled").collect()
    assert {(r.doc_id, r["_draw"]) for r in got} == {(i, f"mine {i}") for i in range(20)}
    plain = R.sample_to_targets(df.drop("_draw")).select("row.doc_id", "sampled").collect()
    assert {(r.doc_id, r.sampled) for r in got} == {tuple(r) for r in plain}
