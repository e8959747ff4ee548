"""Alignment of two tokenizations against whole-text encoding by the libraries."""

import collections
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lawloom.llm import token_alignment as T

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, row string, key string"
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def groups_of(text, a, b):
    if not text:
        return None
    full = (" " + text).encode()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in printable} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in printable)}
    sides = [[bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a],
             [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]]
    if any(b"".join(s) != full for s in sides):
        return None
    ends = []
    for s in sides:
        at, found = 0, []
        for t in s:
            found.append(at := at + len(t))
        ends.append(found)
    out, i, j = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        x, y = ends[0].index(cut) + 1, ends[1].index(cut) + 1
        out.append((ids_a[i:x], ids_b[j:y]))
        i, j = x, y
    return out


def brute(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    found = [groups_of(r[1], a, b) for r in rows]
    counts, best = collections.Counter(), collections.Counter()
    for groups in found:
        counts.update({(x, y) for g in groups or () for x in g[0] for y in g[1]})
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for r, groups in zip(rows, found):
        if groups is None:
            out.append((r[0], 0, 0, 0, 0, 0, 0, "", ""))
            continue
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in groups)
        out.append((r[0], sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
                    sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links),
                    hashlib.sha256(text.encode()).hexdigest(), text))
    return out


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéñ,.đế字") for _ in range(rng.randint(1, 9)))
    gap = lambda: rng.choice([" "] * 9 + ["  ", "\n", "\n\n", " \n ", "\t", "\t ", "  ", "᠎  ", "　"])
    texts = ["".join(word() + gap() for _ in range(rng.randint(1, 120))) for _ in range(60)]
    texts += [None, "", " ", "  ", "\n", " \n", "a", "a ", " a", "\n a", "a  ", "▁a", "a ▁", "<s> </s> <unk> <0x41> <|endoftext|>",
              "x" * 700, "字" * 300, "it's don't 'll", "\x00a\x1c b​ c ﻿ d", "🙂 🙂🙂  🙂", "ﬁ ﬀ é Å", "a\r\nb  c"]
    texts += [texts[0]] * 5 + [texts[1] * 20] * 3
    rows = [(i, t, "r", "k") for i, t in enumerate(texts)]
    return rows + [(None, "null id", "r", "k"), (3, "an id again", "r", "k"), (3, "an id again", "r", "k")]


@pytest.mark.parametrize("chunk,fan", [(T.CHUNK, T.FAN), (40, 2), (97, 3)])
def test_equals_whole_text_encoding(spark, chunk, fan):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = T.align_documents(df, A, B, carry=["doc_id", "row", "key"], chunk=chunk, fan=fan).collect()
    want = brute(rows)
    assert sorted(((r.row.doc_id, *(r[c] for c in COLUMNS)) for r in got), key=str) == sorted((w[:-1] for w in want), key=str)


def test_groups_in_parts_are_the_groups(spark):
    rows = [(i, t, "r", "k") for i, (_, t, *_) in enumerate(corpus())]
    got = T.aligned_groups(spark.createDataFrame(rows, SCHEMA), A, B, carry=["doc_id"], chunk=60, fan=2).collect()
    parts = collections.defaultdict(list)
    for r in got:
        parts[r.row.doc_id].append((r.k, r.sub, r.groups))
    text = {i: ";".join(g for _, _, g in sorted(p)) for i, p in parts.items()}
    assert text == {w[0]: w[-1] for w in brute(rows) if w[-1]}
    assert max(len(p) for p in parts.values()) > 20


def test_fragments_compose_in_any_order():
    rng = random.Random(8)
    for _ in range(300):
        leaves, token = [], iter(range(1000))
        take = lambda: [next(token) for _ in range(rng.randint(0, 2))]
        for k in range(rng.randint(1, 7)):
            cut = rng.random() < 0.6
            leaves.append(T.Fragment(True, k if cut else None, (take(), take()), (take(), take()) if cut else ([], [])))

        def reduced(parts, closed):
            if len(parts) == 1:
                return parts[0]
            at = rng.randrange(1, len(parts))
            out, group = reduced(parts[:at], closed).compose(reduced(parts[at:], closed))
            if group:
                closed.append(group)
            return out

        results = []
        for _ in range(4):
            closed = []
            whole = reduced(leaves, closed)
            results.append((whole, sorted(closed)))
        assert all(r == results[0] for r in results)


def test_a_group_may_span_byte_ranges():
    """A run without white space is one unit, so ranges of it stay together; borders inside words leave open ends."""
    t = T._tokenizers(A, B)
    text = " " + "ouieraition thithereringen " * 20
    ranges = list(T.byte_ranges(text, t.cut, 33))
    assert len(ranges) > 8 and any(start for _, start, _ in ranges)
    units = T.Units(t)
    made = [T._fragment(units, k, n, s, e) for k, (n, (_, s, e)) in enumerate(zip(units.numbers([r[0] for r in ranges]), ranges))]
    assert any(f.suffix != ([], []) or f.first is None for f, _ in made[:-1])
    assert len(list(T.byte_ranges(" " + "x" * 1000, t.cut, 33))) == 1


def test_empty_table(spark):
    assert T.align_documents(spark.createDataFrame([], SCHEMA), A, B, carry=["doc_id"]).collect() == []


class Counted:
    """Sentencepiece that counts the strings it is given."""

    def __init__(self, inner):
        self.inner, self.strings = inner, 0

    def encode(self, strings, **kw):
        self.strings += len(strings)
        return self.inner.encode(strings, **kw)

    def __getattr__(self, name):
        return getattr(self.inner, name)


def test_units_share_strings_and_frequent_units_stay_known(monkeypatch):
    t = T.Tokenizers(A, B)
    t.b = Counted(t.b)
    units = T.Units(t)
    often = [f" word{i}," for i in range(400)]
    units.numbers(["".join(often)] * 4)
    assert t.b.strings <= 400 // 8
    monkeypatch.setattr(T, "KNOWN_UNITS", 1000)
    units.numbers(["".join(f" rare{i}" for i in range(2000))])
    t.b.strings = 0
    numbers = units.numbers(["".join(often)])
    assert t.b.strings == 0 and len(units.number) == len(units.known) == len(units.text) == 400
    again = T.Units(t)
    assert units.part(numbers[0]).text == again.part(again.numbers(["".join(often)])[0]).text


def test_units_in_strings_are_as_alone(monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abehilnorst',.é字🙂ﬁ　Å") for _ in range(rng.randint(1, 8)))
    texts = [" " + "".join(word() + rng.choice([" ", " ", "\n", "  ", " \n"]) for _ in range(40)) for _ in range(50)]
    texts += [t.replace("b", "▁", 1) for t in texts[:20]]  # B takes this letter for a space, so the bytes differ
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    for sizes in ((64, 8, 1), (3, 1), (1,)):
        monkeypatch.setattr(T, "JOINED_UNITS", sizes)
        units = T.Units(T.Tokenizers(A, B))
        for text, n in zip(texts, units.numbers(texts)):
            want = groups_of(text[1:], a, b)
            assert units.ok[n].all() == (want is not None)
            if want is not None:
                assert units.part(n).text == ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in want)
        assert 0 < len(units.known) - sum(units.known) <= 20
