"""WARC archives and token files: exact round trips."""

import gzip
import hashlib
import os
import zlib

import numpy as np
import public_tokenizers
import pytest

from lawloom.llm import token_files as T
from lawloom.llm import warc as W
from lawloom.llm.shards import shard_of, shard_starts

PAGES = "page_id long, url string, html string, digest string"
LONG = "<p>é</p>" * 200


def pages(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i * 7), "x") for i in range(60)]
    rows += [(100, "http://h/a b\n", LONG, "x"), (101, None, LONG, "x"), (102, "http://h/c", LONG, "x"), (102, "http://h/b", LONG, "x")]
    rows += [(None, "http://h/n", LONG, "x"), (103, "u", None, "x"), (104, "u", "", "x"), (105, "u", "short", "x"), (106, "u", "short", "x")]
    return rows, spark.createDataFrame(rows, PAGES)


def test_warc_round_trip(spark, tmp_path):
    rows, df = pages(spark)
    W.write_warc(df.repartition(5), f"file://{tmp_path}/a", shard_bytes=4000, file_bytes=700)
    got = W.read_warc(spark, f"file://{tmp_path}/a", with_payload=True).collect()
    assert len(got) == len(rows)
    body = lambda h: (h or "").encode()
    want = sorted((str(i), len(body(h)), hashlib.sha1(body(h)).hexdigest()) for i, _, h, _ in rows)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in got) == want
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in got if r.payload_bytes == len(body(LONG)) and r.payload_bytes > 999 and r.payload_digest == hashlib.sha1(body(LONG)).hexdigest())
    assert kinds == sorted([("100", "revisit", 102), ("101", "revisit", 102), ("102", "response", None), ("102", "revisit", 102), ("None", "response", None)])
    assert all(r.record_type == "response" for r in got if r.payload_bytes < 1000)
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    assert {r.url for r in got if r.page_id == 100} == {"http://h/a%20b%0A"}


def test_warc_files_are_deterministic_and_published(spark, tmp_path):
    _, df = pages(spark)
    seen = []
    for k, parts in (("a", 1), ("b", 7)):
        manifest = W.write_warc(df.repartition(parts), f"{tmp_path}/{k}", shard_bytes=4000, file_bytes=700)
        seen.append(sorted((r.name, r.records, r.bytes, r.sha1) for r in manifest.collect()))
        names = sorted(x for x in os.listdir(tmp_path / k) if x != "_manifest")
        assert names == [x[0] for x in seen[-1]] and len(names) > 3
        first = gzip.open(tmp_path / k / names[0]).read()
        assert first.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and first.count(b"WARC-Type: ") == seen[-1][0][1] + 1
    assert seen[0] == seen[1]


def test_equal_rows_have_record_ids_of_their_own(spark, tmp_path):
    rows = [(1, "http://a", LONG, "x")] * 3 + [(2, "u", "short", "x")] * 2 + [(None, "u", LONG, "x")] * 2
    manifest = W.write_warc(spark.createDataFrame(rows, PAGES), f"{tmp_path}/a").collect()
    records = [W.parse_record(raw) for f in manifest for raw in W._members(f.path)]
    ids = [r["warc-record-id"] for r in records]
    assert len(ids) == len(set(ids)) == 8
    responses = {r["warc-record-id"] for r in records if r["warc-type"] == "response"}
    revisits = [r for r in records if r["warc-type"] == "revisit"]
    assert len(revisits) == 2 and all(r["warc-refers-to"] in responses for r in revisits)


def test_warc_reader_sees_damage(spark, tmp_path):
    _, df = pages(spark)
    r = W.write_warc(df, f"{tmp_path}/a").first()
    path = r.path
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-30])
    with pytest.raises(Exception, match="ends inside|incorrect|invalid"):
        W.read_warc(spark, f"{tmp_path}/a").collect()


def test_empty_tables(spark, tmp_path):
    W.write_warc(spark.createDataFrame([], PAGES), f"{tmp_path}/a")
    assert W.read_warc(spark, f"{tmp_path}/a").count() == 0
    T.write_token_files(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/b", TOKENIZER)
    assert T.read_token_files(spark, f"{tmp_path}/b").count() == 0


TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello world, it's 2024!", None, "", "   ", "J\u030c A\u030a İ ΑΣ ΑΣ. ﬁne e\u0301", "<|endoftext|> x", "a\u00a0b\u2003c\x1cd\x85e", "日本語 テキスト 😀👍🏽",
    "don't WE'LL he'd 'tis rock'n'roll 3.14 1,000", "x" * 5000, "word " * 7000, "\n\tTabs\r\nand lines\x0bhere\x0c", "\u0301start \u0300",
    "<|startoftext|>y", "A.B.C. ... --- '' 's 't",
]


def whole(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def test_words_are_encoded_as_the_whole_text_is():
    encoder = T.Encoder(TOKENIZER)
    for text, ids in zip(TEXTS, whole(TEXTS), strict=True):
        assert np.frombuffer(encoder.encode(text), encoder.kind).tolist() == ids, text


def test_token_files_round_trip(spark, tmp_path):
    rows = [(i * 3, t, "x") for i, t in enumerate(TEXTS)] + [(3, "again", "x"), (3, "again", "x"), (None, "none", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    T.write_token_files(df.repartition(4), f"file://{tmp_path}/t", TOKENIZER, length=16, shard_bytes=9000)
    got = T.read_token_files(spark, f"file://{tmp_path}/t").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for (i, _, _), ids in zip(order, whole([t for _, t, _ in order]), strict=True):
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want
    assert len({r.shard for r in got}) > 2


def test_sequences_are_equal_length_and_masked(spark, tmp_path):
    df = spark.createDataFrame([(i, "some words here " * i) for i in range(50)], "doc_id long, text string")
    manifest = T.write_token_files(df, f"{tmp_path}/t", TOKENIZER, length=8).filter("name NOT LIKE '%index%'").collect()
    ids = [x for t in whole([t for _, t in [(i, "some words here " * i) for i in range(50)]]) for x in t]
    reader = T.open_file(manifest[0].path)
    assert reader.schema.field("input_ids").type.list_size == 8
    n = -(-len(ids) // 8)
    for i in (0, 1, T.BATCH, n - 1):
        values, mask = T.sequence(reader, i)
        want = ids[i * 8 : i * 8 + 8]
        assert values.to_pylist()[: len(want)] == want and mask.to_pylist() == [True] * len(want) + [False] * (8 - len(want))


def test_shards_depend_on_rows_only(spark):
    from pyspark.sql import functions as F

    rows = [(i,) for i in range(1000)] + [(2**61,), (-(2**61),), (None,)] + [(500,)] * 300
    df = spark.createDataFrame(rows, "k long")
    starts = shard_starts(df.repartition(3), "k", F.lit(1), 50)
    assert starts == shard_starts(df.repartition(8), "k", F.lit(1), 50)
    counts = {r[0]: r[1] for r in df.groupBy(shard_of("k", starts).alias("s")).count().collect()}
    assert sum(counts.values()) == len(rows) and len(counts) > 15
    assert sorted(counts.values())[-2] <= 51  # but for the key that is one shard of its own
