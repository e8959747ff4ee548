"""Hard negatives against brute force on exact integers."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lawloom.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, id string, _is_anchor int"


def scaled(v):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(256 * float(np.float32(x))) for x in v]


def brute(rows, k=5, percent=80):
    usable = [(i, lab, s) for i, v, lab, *_ in rows if i is not None and lab is not None and (s := scaled(v)) is not None]
    anchors = {}
    for i, lab, s in sorted(usable):
        if i % 100 == 0:
            anchors.setdefault(i, (lab, s))
    out = []
    for anchor, (lab, v) in anchors.items():
        scores = [(-sum(a * b for a, b in zip(v, s)), i, l) for i, l, s in usable if i != anchor and len(s) == len(v)]
        scores.sort()
        for p, pid, _ in [x for x in scores if x[2] == lab][:k]:
            hits = [(n, i) for n, i, l in scores if l != lab and percent * -p <= 100 * -n <= 100 * -p][:k]
            out += [(anchor, pid, rank, i, -p, -n) for rank, (n, i) in enumerate(hits, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = H.mine_hard_negatives(df, F.col("vec_id") % 100 == 0, **options)
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in found.collect())


def corpus(seed):
    rng = random.Random(seed)
    near = lambda c: [x + rng.uniform(-0.2, 0.2) for x in c]
    centres = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(4)]
    rows = []
    for i in range(-40, 700):
        label = 0 if rng.random() < 0.5 else rng.randrange(1, 5)  # one label holds half of the rows
        rows.append((i, near(centres[label % 4]), label, "x", 7))
    rows += [(2000 + i, centres[0], i % 2, "x", 7) for i in range(40)]  # ties, of both kinds
    rows += rows[3:9]  # repeated rows
    rows += [(900, None, 1, "x", 7), (901, [1.0, None], 1, "x", 7), (902, [1.0] * 7 + [float("nan")], 1, "x", 7),
             (903, [float("inf")] * 8, 1, "x", 7), (None, centres[1], 1, "x", 7), (904, centres[1], None, "x", 7),
             (905, centres[1][:3], 1, "x", 7), (1000, centres[2][:3], 1, "x", 7), (1100, [], 2, "x", 7), (1200, [], 2, "x", 7)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(H, "ROWS_PER_STEP", 50)
    monkeypatch.setattr(H, "ANCHORS_PER_BLOCK", 3)
    rows = corpus(seed)
    want = brute(rows)
    assert len(want) > 20 and mined(spark, rows) == want
    assert mined(spark, rows, k=2, percent=95) == brute(rows, 2, 95)


def test_large_values_are_exact(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([1e6, 2e6 + i, -3e6, 4e6]) for _ in range(4)], i % 3, "x", 7) for i in range(0, 160, 5)]
    assert mined(spark, rows) == brute(rows)


def test_empty_tables_and_no_anchors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(i, [1.0], 1, "x", 7) for i in range(1, 30)]) == []


def test_keys_sort_as_they_should():
    rng = np.random.default_rng(5)
    values = [np.array([-(1 << 63), -5, 0, 3, (1 << 63) - 1])[rng.integers(0, 5, 300)] for _ in range(3)]
    keys = pa.concat_arrays([H.pack(values[0][:150], values[1][:150], 0, values[2][:150]).column(0),
                             H.pack(values[0][150:], values[1][150:], 1, values[2][150:]).column(0)])
    anchor, score, kind, ids = H.unpack(keys)
    assert (anchor == values[0]).all() and (score == values[1]).all() and (ids == values[2]).all()
    by_bytes = sorted(range(300), key=lambda i: keys[i].as_py())
    assert [(anchor[i], -int(score[i]), kind[i], ids[i]) for i in by_bytes] == sorted(zip(anchor, (-int(s) for s in score), kind, ids))


def test_tasks_send_few_keys(spark):
    """The bounds of the first pass keep what tasks send far below all pairs."""
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], i % 5, "x", 7) for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA).select(F.col("vec_id").alias("id"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
    none = F.expr("cast(array() as array<bigint>)")
    anchors = H.scaled_anchors(df.filter("id % 100 = 0"), 256)
    blocks = H.write_blocks(anchors.withColumn("lows", none).withColumn("highs", none), "t")
    sent = H.scan(df.repartition(8), blocks, H.best_positives, 0, 5, 256).count()
    assert sent <= 40 * 8 * 5
