"""PartEnum join against brute force: copies, chains, unlinked groups, and buckets that are split."""

import random

import numpy as np
import pytest

from lawloom.llm import partenum_join as P

SCHEMA = "doc_id long, text string, n string, comp string, bucket string"


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(rows, size=3, threshold=90):
    sets = [(r[0], shingles(r[1], size)) for r in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, t in sets[k + 1 :]:
            both = len(s & t)
            if i is not None and j is not None and both and 100 * both >= threshold * len(s | t):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3)))
    texts, base = [], [word() for _ in range(200)]
    for _ in range(120):  # a large group of near copies, many linked, many not
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    chain = [word() for _ in range(150)]
    for k in range(30):  # each like the next, the ends unlike
        chain[(k * 5) % 150] = word()
        texts.append(" ".join(chain))
    for n in (1, 2, 3, 8, 12, 40, 700):  # small and large sets with copies that gain a word
        w = [word() for _ in range(n)]
        texts += [" ".join(w), " ".join([*w, word()]), " ".join(w).upper()]
    texts += [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += [texts[3]] * 8 + [None, "", "  \n", "one", "one", "one two", "x " * 300]
    rows = [(i * 3 + 1, t, "n", "c", "b") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [(None, texts[0], "n", "c", "b"), (1, texts[150], "n", "c", "b"), (4, texts[1], "n", "c", "b")]


@pytest.mark.parametrize("block,threshold", [(P.BLOCK, 90), (8, 90), (8, 70)])
def test_equals_brute_force(spark, block, threshold):
    rows = corpus(block)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = P.similar_documents(df, threshold=threshold, block=block).collect()
    want = brute(rows, 3, threshold)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    assert len({w[2] for w in want}) < len(want)


@pytest.mark.parametrize("threshold", [50, 80, 90, 97])
def test_linked_sets_share_a_signature(threshold):
    rng, bands = np.random.default_rng(threshold), P.Bands(threshold)
    for _ in range(400):
        n = int(rng.integers(10, 900))
        common = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        most = max(0, n * 100 // threshold - n)  # extra shingles that keep the link
        x = int(rng.integers(0, most + 1))
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, k, dtype=np.uint64)])) for k in (x, most - x))
        assert 100 * len(np.intersect1d(a, b)) >= threshold * len(np.union1d(a, b))
        if not np.array_equal(a, b):
            assert len(np.intersect1d(bands.signatures(a), bands.signatures(b)))


def test_sketches_bound_the_differences():
    rng = np.random.default_rng(1)
    for _ in range(100):
        a, b = (np.unique(rng.integers(0, 3000, int(rng.integers(1, 2000)), dtype=np.uint64)) for _ in "ab")
        x, y = (np.frombuffer(P.parity_sketch(s), np.uint64) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_blocks_of_one_component_do_not_meet(spark):
    rows = [(1, i, 0, 110) for i in range(100)] + [(1, 100 + i, 100 + i, 110) for i in range(10)]
    split = P.split_buckets(spark.createDataFrame(rows, "bucket long, rep long, comp long, n_docs long"), 16).collect()
    together = {}
    for r in split:
        together.setdefault(r.bucket, []).append(r.rep)
    pairs = {(a, b) for reps in together.values() for a in reps for b in reps if a < b}
    assert {(a, b) for a in range(110) for b in range(a + 1, 110) if b >= 100} <= pairs
    assert len(split) <= 7 * 26 + 10  # each of the seven large blocks once beside the block of the others


def test_empty_table(spark):
    assert P.similar_documents(spark.createDataFrame([], SCHEMA)).collect() == []
