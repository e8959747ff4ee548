import re

from lawloom.llm import decontaminate as D

BENCH = "item_id long, text string"
DOCS = "doc_id long, text string, items string"


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, bench):
    out = []
    for i, t, *_ in docs:
        w, hit, items = words(t), set(), set()
        for item, b in bench:
            b = words(b)
            n = min(13, len(b))
            for k in range(len(b) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == b[k : k + n]:
                        hit |= set(range(p, p + n))
                        items.add(str(item))
        out.append((i, len(w), len(hit), sorted(items), 0 < len(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


ITEM = " ".join(f"Word{i}" for i in range(20))
ITEMS = [(1, ITEM), (2, "short item"), (3, None), (4, "... !!"), (10, "Éa ß漢 7"), (10, "second text of ten"), (11, ITEM)]
TEXTS = [
    (1, "before " + ITEM.lower().replace(" ", ", ") + " after", "x"), (2, " ".join(ITEM.split()[3:15]), "x"),
    (3, " ".join(ITEM.split()[3:16]), "x"), (4, "a SHORT--item here", "x"), (5, None, "x"), (6, "", "x"), (7, "?!", "x"),
    (8, "éa ß漢 7", "x"), (9, "Éa ß漢 7 and short item short item", "x"), (9, "Éa ß漢 7 and short item short item", "x"),
    (None, " ".join(f"z{i}" for i in range(400)) + " short item", "x"), (12, (ITEM + " ") * 30, "x"),
]


def test_equals_brute_force_in_one_block_and_in_many(spark):
    docs, bench = spark.createDataFrame(TEXTS, DOCS), spark.createDataFrame(ITEMS, BENCH)
    for block in (D.BLOCK_WORDS, 5):
        got = D.find_hits(docs, bench, ["doc_id"], block_words=block).select("row.doc_id", "n_words", "n_hit", "items", "contaminated")
        assert sorted(map(tuple, got.collect()), key=repr) == brute(TEXTS, ITEMS)


def test_outputs(spark):
    docs, bench = spark.createDataFrame(TEXTS, DOCS), spark.createDataFrame(ITEMS, BENCH)
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 2, 5, 6, 7, 8]  # É is no A-Z
    cut = [r.text for r in D.cut_hits(docs, bench).collect()]
    assert "before  after" in cut and "a  here" in cut and " and " in cut and None in cut


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame(TEXTS, DOCS), spark.createDataFrame([], BENCH)
    assert D.find_hits(docs, bench, ["doc_id"]).filter("n_hit > 0 OR contaminated").count() == 0
    assert D.find_hits(spark.createDataFrame([], DOCS), spark.createDataFrame(ITEMS, BENCH), ["doc_id"]).count() == 0


def test_items_of_null_id_hit_words_and_name_no_item(spark):
    nameless = " ".join(f"null{i}" for i in range(15))
    bench = spark.createDataFrame([(None, nameless), (None, "two words"), (5, "two words"), (6, ITEM)], BENCH)
    docs = spark.createDataFrame([(1, nameless, "x"), (2, "two words", "x"), (3, "free of all", "x"), (4, f"{nameless} {ITEM}", "x")], DOCS)
    want = {1: (15, [], 0, True), 2: (2, ["5"], 1, True), 3: (0, [], 0, False), 4: (35, ["6"], 1, True)}
    for block in (D.BLOCK_WORDS, 5):
        got = D.find_hits(docs, bench, ["doc_id"], block_words=block).collect()
        assert {r.row.doc_id: (r.n_hit, r["items"], r.n_items, r.contaminated) for r in got} == want
    assert [r.doc_id for r in D.drop_contaminated(docs, bench).collect()] == [3]
