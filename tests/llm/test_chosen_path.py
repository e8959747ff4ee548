"""Near duplicates against brute force, with groups of copies, chains, and every branch of the search."""

import random

import pytest

from lawloom.llm import chosen_path as C
from lawloom.llm.components import components


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(rows, size):
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3)))
    rows, base = [], [word() for _ in range(120)]
    for k in range(150):  # a large group of near copies
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = word()
        rows.append(" ".join(w))
    chain = [word() for _ in range(100)]
    for k in range(30):  # each like the next, the ends unlike
        chain = chain[3:] + [word() for _ in range(3)]
        rows.append(" ".join(chain))
    rows += [rows[3]] * 20 + ["two words", "Two\twords", "one", "ONE", "", " \n", None, "word " * 500]
    rows += [" ".join(word() for _ in range(rng.randint(1, 200))) for _ in range(250)]
    rows += [" ".join(base[:60] + [word() for _ in range(n)]) for n in range(0, 40, 2)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("size", "options"), [(2, {}), (5, {}), (2, {"small": 8, "star_depth": 1, "medium": 40, "depth": 2})])
def test_equals_brute_force(spark, size, options):
    rows = corpus(size)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, C.near_duplicates(df, size=size, **options).collect()))
    assert got == brute(rows, size)


def test_threshold_is_exact():
    import numpy as np

    at = lambda *n: np.array(n, np.uint64)
    assert C.linked(at(1, 2, 3, 4), at(1, 2, 3, 4, 5), 80) and not C.linked(at(1, 2, 3, 4), at(1, 2, 3, 5), 80)
    assert not C.linked(at(), at(), 80)


def test_null_and_shared_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text, "a"), (7, text, "b"), (7, text, "b"), (9, text, "c"), (9, "something else", "d"), (3, None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted(map(tuple, C.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 46, None, True), (7, 46, 7, True), (7, 46, 7, True), (9, 46, 7, False), (9, 1, 9, True), (3, 0, 3, True)], key=repr)
    assert sorted((r.doc_id or -1 for r in C.keep_first(df).collect())) == [-1, 3, 7, 7]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert C.near_duplicates(empty).count() == 0 and C.keep_first(empty).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    parent = {v: v for e in edges for v in e if e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.v: r.comp for r in got} == {v: find(v) for v in parent}
