"""Alignment of two tokenizations by an associative monoid of fragments.

Tokenizer A is a byte-level BPE of the tokenizers library, applied to a space and the text, B a sentencepiece BPE with
byte fallback, applied to the text, to which it adds that space. Byte offsets at which tokens of both end cut them into
groups; all A-B pairs of a group are links.

Fragments. A fragment of a byte range owns the tokens that end in it: the open prefix up to its first common end, the
closed groups between, and the open suffix after its last common end. A range without a common end is prefix only. Two
neighbours compose: suffix and prefix where they meet form one group, which is then closed. Composition is associative,
so the fragments of a text can be reduced in any tree. Texts longer than `CHUNK` characters are cut into byte ranges
that Spark deals to tasks; their fragments are reduced `FAN` at a time over the cluster. Closed groups stay where they
were written: only the open ends, a few tokens each, travel up the tree.

Units. Neither tokenizer joins a space or a line feed to a character before it that is no white space, so a text falls
into units there that are tokenized alone, or after any other unit, with the same result. New units are tokenized many to
a string and told apart by their bytes; a string whose bytes differ, or in which an end of a unit is no common end, is cut
into smaller ones, down to single units. Between batches a task keeps what it knows of the units that it meets most, a
bounded number; others are tokenized again where they come back. A byte range reads the units that its ends lie in from
both sides. Where no unit begins within `CHUNK` characters of the wanted end, the two ranges stay together.

Counts. An id pair's count is the number of rows whose text holds it linked. Texts are tokenized once: the distinct pairs
of each, and how often it links them, are written. Tasks count their pairs before the shuffle; pairs of long texts are
made distinct per text first. The table of counts, which has one row per pair that occurs and so grows with the
vocabularies, is written and read by tasks in blocks.

Defined results: texts that are null or empty, or whose joined A or B bytes differ from the space and the text, have no
tokens, zeros and the empty string for a hash; strings of special tokens are plain text; rows with a null or repeated id
are rows of their own, repeated rows get the same result and count as often as they occur; only `carry` is carried, in
one struct, so no name can clash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lawloom.session import materialize
from lawloom.sources.blocks import BlockTable, slices, write_blocks

CHUNK = 1 << 15  # characters of a byte range
FAN = 16  # fragments that are composed at once
KNOWN_UNITS = 80_000  # above this, a task keeps half as many at most before the next batch
JOINED_UNITS = (64, 8, 1)  # units that are tokenized as one string, fewer where that fails
LEARNED_UNITS = 20_000  # units that are aligned at once
TEXT_BYTES = 3 << 20  # text that is worked on at once
COUNT_ROWS = 1 << 20
SLICE_BYTES = 48 << 20
PAIRS_HELD = 4_000_000

_SPACE = r"[\s\u180e\u200b\ufeff]"  # more than either tokenizer takes for white space
_OTHER = r"[^\s\u180e\u200b\ufeff]"
_NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_RESULT = ", ".join(f"{c} long" for c in _NUMBERS) + ", groups_sha256 string"


class Tokenizers:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.size_b = self.b.get_piece_size()
        plain = {c: i for i, c in enumerate(_byte_letters())}
        with open(path_a, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.bytes_a = [b"\xff"] * (max(vocabulary.values()) + 1)  # a byte that no text has
        for token, i in vocabulary.items():
            if all(c in plain for c in token):
                self.bytes_a[i] = bytes(plain[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        # Places where a unit may begin: no piece of B goes on over them.
        whole = [p for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        starts = [c for c, safe in ((" ", not any("▁" in p.lstrip("▁") for p in whole)), ("\n", not any("\n" in p for p in whole))) if safe]
        self.starts = "[" + "".join(starts) + "]" if starts else "(?!)"
        self.unit = re.compile(rf"[ \n]{_SPACE}*{_OTHER}*(?:(?!{self.starts}){_SPACE}+{_OTHER}*)*")
        self.cut = re.compile(rf"(?<={_OTHER}){self.starts}")

        self.joins = re.compile(rf"{self.starts}.*{_OTHER}", re.DOTALL)

    def strings(self, units: list[str], size: int) -> list[list[str]]:
        """The units dealt to strings, `size` to each; those that others may not begin or end beside have their own."""
        if size == 1:
            return [[u] for u in units]
        joined, alone = [], []
        for u in units:
            (joined if self.joins.fullmatch(u) else alone).append(u)
        return [joined[i : i + size] for i in range(0, len(joined), size)] + [[u] for u in alone]

    def encode(self, strings: list[list[str]]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Which strings of units have the bytes of their tokens and a common end where a unit ends; of the units of these,
        one after the other, their bytes, and for A and B the ids of all and how many each has."""
        space, texts = self.b.piece_to_id("▁"), ["".join(s) for s in strings]
        ids_a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        # B adds the space that a string begins with; where it begins with a line feed, that space is taken off again.
        ids_b = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        for i, text in enumerate(texts):
            if text == " ":
                ids_b[i] = [space]
            elif text[0] != " ":
                ids_b[i] = ids_b[i][1:] if ids_b[i][:1] == [space] else []
        data = "".join(texts).encode("utf-8", "surrogatepass")
        begins = np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)  # of each character
        held = np.fromiter(map(len, strings), np.int64, len(strings))
        length = np.fromiter(map(len, chain.from_iterable(strings)), np.int64, held.sum())
        size = np.diff(np.append(begins, len(data))[np.cumsum(length)], prepend=0)
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(held)])].tolist()
        ok, sides = np.ones(len(strings), bool), []
        for ids, tokens, lengths in ((ids_a, self.bytes_a, self.length_a), (ids_b, self.bytes_b, self.length_b)):
            n, flat = np.fromiter(map(len, ids), np.int64, len(ids)), list(chain.from_iterable(ids))
            made, flat = b"".join(map(tokens.__getitem__, flat)), np.array(flat, np.int64)
            if made != data:
                at = np.concatenate([[0], np.cumsum(lengths[flat])])[np.concatenate([[0], np.cumsum(n)])].tolist()
                ok &= [made[i:j] == data[x:y] for i, j, x, y in zip(at, at[1:], ends, ends[1:], strict=False)]
            sides.append((flat, n, lengths))
        size, out, met = size[np.repeat(ok, held)], [], True
        for flat, n, lengths in sides:
            flat = flat[np.repeat(ok, n)]
            after = np.searchsorted(np.cumsum(lengths[flat]), np.cumsum(size)) + 1  # tokens up to the end of each unit
            met &= np.concatenate([[0], np.cumsum(lengths[flat])])[after] == np.cumsum(size)
            out.append((flat, np.diff(after, prepend=0)))
        if not np.all(met):
            ok[np.repeat(np.flatnonzero(ok), held[ok])[~met]] = False
            return ok, *self.encode([s for s, fine in zip(strings, ok, strict=True) if fine])[1:]
        return ok, size, *out


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself where it is printable, else the next free one
    from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


@lru_cache(maxsize=2)
def _tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


_MARKS = ",|;"
_MARKED: list[str] = []
_TENS = 10 ** np.arange(1, 18)


def _marked(numbers: np.ndarray) -> list[str]:
    """Ids with the mark that follows them, from id * 3 + mark. Those of the vocabularies are made once."""
    if len(numbers) and (top := int(numbers.max()) // len(_MARKS) + 1) * len(_MARKS) > len(_MARKED):
        _MARKED.extend(f"{i}{m}" for i in range(len(_MARKED) // len(_MARKS), top) for m in _MARKS)
    return list(map(_MARKED.__getitem__, numbers.tolist()))


@dataclass
class Groups:
    """Groups in a row: tokens of both sides and how many each group holds."""

    a: np.ndarray
    b: np.ndarray
    size_a: np.ndarray
    size_b: np.ndarray

    def codes(self, size_b: int) -> np.ndarray:
        """All pairs of all groups, group by group: A id * size_b + B id."""
        count = self.size_a * self.size_b
        group = np.repeat(np.arange(len(count)), count)
        place = np.arange(len(group)) - np.repeat(np.cumsum(count) - count, count)
        first_a, first_b = np.cumsum(self.size_a) - self.size_a, np.cumsum(self.size_b) - self.size_b
        return self.a[first_a[group] + place // self.size_b[group]] * size_b + self.b[first_b[group] + place % self.size_b[group]]

    def texts(self, ends: np.ndarray) -> list[str]:
        """Runs of groups that end before group `ends`, as `a1,a2|b1;a3|b2`."""
        after_a, after_b = np.cumsum(self.size_a), np.cumsum(self.size_b)
        order = np.empty(len(self.a) + len(self.b), np.int64)
        of_a, of_b = np.repeat(np.arange(len(self.size_a)), self.size_a), np.repeat(np.arange(len(self.size_b)), self.size_b)
        at_a = np.arange(len(self.a)) + (after_b - self.size_b)[of_a]
        at_b = np.arange(len(self.b)) + after_a[of_b]
        order[at_a], order[at_b] = self.a * len(_MARKS), self.b * len(_MARKS)
        order[(after_a + after_b - self.size_b) - 1] += 1
        order[after_a + after_b - 1] += 2
        size = np.concatenate([[0], np.cumsum(2 + np.searchsorted(_TENS, order // len(_MARKS), side="right"))])
        stops = size[np.concatenate([[0], after_a + after_b])[np.asarray(ends, np.int64)]].tolist()
        text = "".join(_marked(order))
        return [text[i : j - 1] if j > i else "" for i, j in zip([0, *stops], stops, strict=False)]

    def after(self, k: int) -> Groups:
        """All but the first k groups."""
        return Groups(self.a[self.size_a[:k].sum() :], self.b[self.size_b[:k].sum() :], self.size_a[k:], self.size_b[k:])


def cut_groups(a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, Groups]:
    """Common ends, and the groups between them; tokens after the last common end are left out."""
    at = np.searchsorted(ends_b, ends_a)
    cuts = ends_a[(at < len(ends_b)) & (np.append(ends_b, -1)[at] == ends_a)]
    size_a, size_b = (np.diff(np.searchsorted(ends, cuts, side="right"), prepend=0) for ends in (ends_a, ends_b))
    return cuts, Groups(a[: size_a.sum()], b[: size_b.sum()], size_a, size_b)


@dataclass
class Part:
    """Groups in a row, as sums: numbers of A tokens, B tokens and groups, the code of every link, and the text."""

    n_a: int
    n_b: int
    n_groups: int
    codes: np.ndarray
    text: str

    @staticmethod
    def of(groups: Groups, size_b: int) -> Part:
        return Part(len(groups.a), len(groups.b), len(groups.size_a), groups.codes(size_b), "".join(groups.texts([len(groups.size_a)])))

    @staticmethod
    def joined(parts: list[Part]) -> Part:
        text = ";".join(p.text for p in parts if p.n_groups)
        sums = (sum(getattr(p, c) for p in parts) for c in ("n_a", "n_b", "n_groups"))
        return Part(*sums, np.concatenate([p.codes for p in parts]), text)

    def row(self, code_type: str) -> list:
        """n_a, n_b, n_groups, n_links, distinct codes and how often each is linked."""
        codes, times = np.unique(self.codes, return_counts=True)
        return [self.n_a, self.n_b, self.n_groups, len(self.codes), codes.astype(code_type).tobytes(), times.astype("<u4").tobytes()]


class Rows:
    """Rows of different lengths in one array."""

    def __init__(self):
        self.values, self.ends, self.waiting = np.empty(0, np.int64), np.zeros(1, np.int64), []

    def extend(self, values: np.ndarray, ends: np.ndarray) -> None:
        self.waiting.append((values, ends))

    def settle(self) -> Rows:
        if self.waiting:
            ends, at = [self.ends], self.ends[-1]
            for values, more in self.waiting:
                ends.append(more + at)
                at += len(values)
            self.values, self.ends = np.concatenate([self.values, *(v for v, _ in self.waiting)]), np.concatenate(ends)
            self.waiting = []
        return self

    def take(self, rows: np.ndarray) -> np.ndarray:
        """The values of these rows, one after the other."""
        length = self.ends[rows + 1] - self.ends[rows]
        return self.values[np.repeat(self.ends[rows] - (np.cumsum(length) - length), length) + np.arange(length.sum())]

    def keep(self, rows: np.ndarray) -> None:
        """Only these rows, in this order."""
        self.values, self.ends = self.take(rows), np.concatenate([[0], np.cumsum(self.lengths()[rows])])

    def lengths(self) -> np.ndarray:
        return np.diff(self.ends)


class Units:
    """What a task knows of the distinct units that it has met."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.number, self.text, self.known, self.uses = {}, [], [], np.empty(0, np.int64)
        self.a, self.b, self.size_a, self.codes, self.bytes = (Rows() for _ in range(5))

    def forget(self) -> None:
        """Keep the units met most, half of KNOWN_UNITS at most. What was met before counts half from now on."""
        often = np.flatnonzero(self.uses > 1)
        kept = np.sort(often[np.argsort(-self.uses[often], kind="stable")[: KNOWN_UNITS // 2]])
        names, self.uses = list(self.number), self.uses[kept] // 2
        for rows in (self.a, self.b, self.size_a, self.codes, self.bytes):
            rows.keep(kept)
        self.number = {names[i]: n for n, i in enumerate(kept.tolist())}
        self.text, self.known = [self.text[i] for i in kept.tolist()], [self.known[i] for i in kept.tolist()]

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The units of each text (given with its leading space) by number."""
        if len(self.number) > KNOWN_UNITS:
            self.forget()
        split = [self.tokenizers.unit.findall(t) for t in texts]
        fresh = list(set(chain.from_iterable(split)).difference(self.number))
        for size in JOINED_UNITS:
            strings, fresh = self.tokenizers.strings(fresh, size), []
            for i in range(0, len(strings), LEARNED_UNITS // size):
                fresh += self._learn(strings[i : i + LEARNED_UNITS // size])
        for rows in (self.a, self.b, self.size_a, self.codes, self.bytes):
            rows.settle()
        self.ok = np.array(self.known, bool)
        self.sums = np.column_stack([rows.lengths() for rows in (self.a, self.b, self.size_a)])
        out = [np.fromiter(map(self.number.__getitem__, units), np.int64, len(units)) for units in split]
        self.uses = np.append(self.uses, np.zeros(len(self.known) - len(self.uses), np.int64))
        if out:
            self.uses += np.bincount(np.concatenate(out), minlength=len(self.known))
        return out

    def _learn(self, strings: list[list[str]]) -> list[str]:
        """Tokens and groups of all these units at once: they are one text, in which every unit ends at a common end.
        Returns the units of strings that failed; those that failed alone are known to have no tokens."""
        t = self.tokenizers
        ok, size, (a, n_a), (b, n_b) = t.encode(strings)
        found = list(chain.from_iterable(s for s, fine in zip(strings, ok, strict=True) if fine))
        failed = [s for s, fine in zip(strings, ok, strict=True) if not fine]
        lost = [s[0] for s in failed if len(s) == 1]
        self.number.update(zip(found + lost, range(len(self.known), len(self.known) + len(found) + len(lost)), strict=True))
        self.known += [True] * len(found) + [False] * len(lost)
        n_a, n_b, size = (np.append(x, np.zeros(len(lost), np.int64)) for x in (n_a, n_b, size))
        last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
        ends_a, ends_b = np.cumsum(t.length_a[a]), np.cumsum(t.length_b[b])
        cuts, groups = cut_groups(a, ends_a, b, ends_b)
        last_group = np.searchsorted(cuts, np.concatenate([[0], ends_a])[last_a], side="right")
        last_link = np.concatenate([[0], np.cumsum(groups.size_a * groups.size_b)])[last_group]
        for rows, values, ends in ((self.a, a, last_a), (self.b, b, last_b), (self.size_a, groups.size_a, last_group),
                                   (self.codes, groups.codes(t.size_b), last_link)):
            rows.extend(values, ends)
        self.bytes.extend(size, np.arange(1, len(size) + 1))
        self.text += groups.texts(last_group)
        return list(chain.from_iterable(s for s in failed if len(s) > 1))

    def part(self, numbers: np.ndarray) -> Part:
        """The groups of units in a row."""
        return Part(*self.sums[numbers].sum(axis=0).tolist(), self.codes.take(numbers), ";".join([self.text[n] for n in numbers.tolist()]))

    def owned(self, number: int, low: int, high: int) -> tuple[Groups, tuple[list[int], list[int]]]:
        """Groups of the tokens of a unit that end in its bytes (low, high], and the tokens after the last of them."""
        sides, t = [], self.tokenizers
        for rows, lengths in ((self.a, t.length_a), (self.b, t.length_b)):
            ids = rows.take(np.array([number]))
            ends = np.cumsum(lengths[ids])
            own = (ends > low) & (ends <= high)
            sides += [ids[own], ends[own]]
        groups = cut_groups(*sides)[1]
        return groups, (sides[0][len(groups.a) :].tolist(), sides[2][len(groups.b) :].tolist())


def look_up(codes: np.ndarray, counts: BlockTable) -> tuple[np.ndarray, np.ndarray]:
    """The count of each code, and whether it is the highest of its A id."""
    wanted, back = np.unique(codes, return_inverse=True)
    n, best = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
    for block in counts.blocks(COUNT_ROWS) if len(wanted) else ():
        code, found, top = (block.column(c).to_numpy(zero_copy_only=False) for c in ("code", "n", "best"))
        at = np.searchsorted(wanted, code)
        hit = (at < len(wanted)) & (wanted[np.minimum(at, len(wanted) - 1)] == code)
        n[at[hit]], best[at[hit]] = found[hit], top[hit]
    return n[back], best[back]


def _limited(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about TEXT_BYTES of their text column, one row at least."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // TEXT_BYTES, prepend=0))
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if end > start:
                yield batch.slice(start, end - start)


def _texts(column: pa.Array | pa.ChunkedArray) -> list[str | None]:
    return [None if not t else " " + t for t in column.to_pylist()]


class PairCounts:
    """Number of texts per code, added up in the task."""

    def __init__(self):
        self.codes, self.counts, self.held = [], [], 0

    def add(self, codes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.codes.append(codes)
        self.counts.append(counts)
        self.held += len(codes)
        if self.held > PAIRS_HELD:
            codes, back = np.unique(np.concatenate(self.codes), return_inverse=True)
            counts = np.bincount(back, np.concatenate(self.counts)).astype(np.int64)
            self.codes, self.counts, self.held = [codes], [counts], len(codes)
            if self.held > PAIRS_HELD // 2:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            codes, back = np.unique(np.concatenate(self.codes), return_inverse=True)
            counts = np.bincount(back, np.concatenate(self.counts)).astype(np.int64)
            yield pa.record_batch([pa.array(codes), pa.array(counts)], names=["code", "n"])
        self.codes, self.counts, self.held = [], [], 0


_SUMS = "n_a long, n_b long, n_groups long, n_links long, codes binary, times binary"


def _parts_of_texts(docs: DataFrame, paths: tuple[str, str], code_type: str, full: bool) -> DataFrame:
    """Sums of whole texts (row, text), with their groups (full) or the hash of these; none for texts without tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(_tokenizers(*paths))
        for batch in _limited(batches, 1):
            texts = _texts(batch.column(1))
            numbers, out = iter(units.numbers([t for t in texts if t])), []
            for t in texts:
                if t and units.ok[n := next(numbers)].all():
                    part = units.part(n)
                    out.append([*part.row(code_type), part.text if full else hashlib.sha256(part.text.encode()).hexdigest()])
                else:
                    out.append([0, 0, 0, 0, b"", b"", ""])
            types = [*[pa.int64()] * 4, pa.binary(), pa.binary(), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            yield pa.record_batch([batch.column(0), *columns], names=["row", "n_a", "n_b", "n_groups", "n_links", "codes", "times", "groups"])

    return docs.select("row", "text").mapInArrow(run, _with_row(docs, f"{_SUMS}, groups string"))


def _flat(column: pa.Array | pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in binary cells, one cell after the other, and how many each holds."""
    cells = column.to_pylist()
    values = np.frombuffer(b"".join(cells), kind)
    return values.astype(np.int64), np.array([len(c) // values.itemsize for c in cells], np.int64)


def _pair_counts(sums: DataFrame, code_type: str) -> DataFrame:
    """(code, n): how many of the texts hold the pair linked; tasks add up their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PairCounts()
        for batch in batches:
            codes, _ = _flat(batch.column(0), code_type)
            yield from counts.add(codes, np.ones(len(codes), np.int64))
        yield from counts.flush()

    return sums.select("codes").mapInArrow(run, "code long, n long")


def _counted(part: pa.Table, counts: BlockTable, code_type: str) -> np.ndarray:
    """Per row: number of best links and sum of the counts of the links."""
    codes, length = _flat(part.column("codes"), code_type)
    times, _ = _flat(part.column("times"), "<u4")
    ends = np.concatenate([[0], np.cumsum(length)])
    return np.column_stack([np.diff(np.concatenate([[0], np.cumsum(x * times)])[ends]) for x in look_up(codes, counts)[::-1]])


def _summaries(sums: DataFrame, counts: BlockTable, code_type: str) -> DataFrame:
    """Results of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE_BYTES):
            found = _counted(part, counts, code_type)
            columns = [_joined(part.column(c)) for c in ("row", "n_a", "n_b", "n_groups", "n_links")]
            columns += [pa.array(found[:, 0]), pa.array(found[:, 1]), _joined(part.column("groups"))]
            yield pa.record_batch(columns, names=["row", *_NUMBERS, "groups_sha256"])

    return sums.mapInArrow(run, _with_row(sums, _RESULT))


def _joined(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else column.combine_chunks()


def _with_row(docs: DataFrame, rest: str) -> str:
    return f"row {docs.schema['row'].dataType.simpleString()}, {rest}"


# Long texts


def byte_ranges(text: str, cut: re.Pattern, chunk: int) -> Iterator[tuple[str, int, int]]:
    """Byte ranges of a text of about `chunk` characters, each as the units that it touches, its start and end in them."""
    borders = [(0, 0, 0)]
    for t in range(chunk, len(text), chunk):
        left = next((m for w in (256, 4096, chunk) if (m := _last(cut, text, t - w, t + 1)) is not None), None)
        after = cut.search(text, t, min(len(text), t + chunk))
        right = after.start() if after else len(text) if t + chunk >= len(text) else None
        if left is not None and right is not None and left > borders[-1][1]:
            borders.append((t, left, right))
    borders.append((len(text),) * 3)
    for (start, left, _), (end, _, right) in zip(borders, borders[1:], strict=False):
        size = lambda x, y: len(text[x:y].encode("utf-8", "surrogatepass"))
        yield text[left:right], size(left, start), size(left, end)


def _last(cut: re.Pattern, text: str, low: int, high: int) -> int | None:
    out = None
    for m in cut.finditer(text, max(1, low), high):
        out = m.start()
    return out


@dataclass
class Fragment:
    """The open ends of a byte range. `first` is the range in which its first common end lies, None if it has none;
    the tokens of a range without a common end are its prefix."""

    ok: bool
    first: int | None
    prefix: tuple[list[int], list[int]]
    suffix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))

    def compose(self, other: Fragment) -> tuple[Fragment, tuple[int, list[int], list[int]] | None]:
        """This fragment and the next as one, and the group that closes between them with the range it ends in."""
        ok, join = self.ok and other.ok, lambda x, y: (x[0] + y[0], x[1] + y[1])
        if self.first is None:
            return Fragment(ok, other.first, join(self.prefix, other.prefix), other.suffix), None
        if other.first is None:
            return Fragment(ok, self.first, self.prefix, join(self.suffix, other.prefix)), None
        return Fragment(ok, self.first, self.prefix, other.suffix), (other.first, *join(self.suffix, other.prefix))


_ENDS = "ok boolean, first long, pa array<long>, pb array<long>, sa array<long>, sb array<long>"


def _fragment(units: Units, k: int, numbers: np.ndarray, start: int, end: int) -> tuple[Fragment, Part]:
    """Fragment and closed groups of byte range k, which is (start, end] of the bytes of these units."""
    size_b = units.tokenizers.size_b
    if not units.ok[numbers].all():
        return Fragment(False, None, ([], [])), Part(0, 0, 0, np.empty(0, np.int64), "")
    ends = np.cumsum(units.bytes.take(numbers))
    starts = ends - units.bytes.take(numbers)
    first, last = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(starts, end)) - 1
    head, rest = units.owned(numbers[first], start - starts[first], end - starts[first])
    if not len(head.size_a):
        return Fragment(True, None, rest), Part.of(head, size_b)
    n, m = head.size_a[0], head.size_b[0]
    parts = [Part.of(head.after(1), size_b)]
    if last > first:
        tail, rest = units.owned(numbers[last], 0, end - starts[last])
        parts += [units.part(numbers[first + 1 : last]), Part.of(tail, size_b)]
    return Fragment(True, k, (head.a[:n].tolist(), head.b[:m].tolist()), rest), Part.joined(parts)


def _fragments(ranges: DataFrame, paths: tuple[str, str], code_type: str) -> DataFrame:
    """Fragment and closed groups of each byte range (key, k, text, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(_tokenizers(*paths))
        for batch in _limited(batches, 2):
            key, k, texts, start, end = (c.to_pylist() for c in batch.columns)
            out = []
            for i, n in enumerate(units.numbers(texts)):
                f, part = _fragment(units, k[i], n, start[i], end[i])
                out.append([key[i], k[i], f.ok, f.first, *f.prefix, *f.suffix, *part.row(code_type), part.text])
            if out:
                yield _batch(out, _FRAGMENT)

    return ranges.mapInArrow(run, f"key binary, k long, {_ENDS}, {_SUMS}, groups string")


_LONGS = pa.list_(pa.int64())
_END_FIELDS = [("ok", pa.bool_()), ("first", pa.int64()), *((c, _LONGS) for c in ("pa", "pb", "sa", "sb"))]
_SUM_FIELDS = [*((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("codes", pa.binary()), ("times", pa.binary())]
_FRAGMENT = pa.schema([("key", pa.binary()), ("k", pa.int64()), *_END_FIELDS, *_SUM_FIELDS, ("groups", pa.string())])
_COMPOSED = pa.schema([("key", pa.binary()), ("k", pa.int64()), ("closed", pa.bool_()), *_END_FIELDS])
_MET = pa.schema([("key", pa.binary()), ("k", pa.int64()), ("sub", pa.int32()), *_SUM_FIELDS, ("groups", pa.string())])


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _row(values: list, schema: pa.Schema) -> pa.RecordBatch:
    return _batch([values], schema)


def _compose(fragments: DataFrame, fan: int) -> DataFrame:
    """One level of the tree: runs of `fan` fragments become one; groups that close on the way are rows of their own,
    with the range they end in as k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            for key, k, *ends in zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True):
                ok, first, pa_, pb, sa, sb = ends
                now = Fragment(ok, first, (pa_, pb), (sa, sb))
                if at == (key, k // fan):
                    held, group = held.compose(now)
                    if group is not None:
                        yield _row([key, group[0], True, True, None, group[1], group[2], [], []], _COMPOSED)
                    continue
                if held is not None:
                    yield _row([*at, False, held.ok, held.first, *held.prefix, *held.suffix], _COMPOSED)
                at, held = (key, k // fan), now
        if held is not None:
            yield _row([*at, False, held.ok, held.first, *held.prefix, *held.suffix], _COMPOSED)

    rows = fragments.select("key", "k", "ok", "first", "pa", "pb", "sa", "sb")
    rows = rows.repartition("key", F.expr(f"k div {fan}")).sortWithinPartitions("key", "k")
    return rows.mapInArrow(run, f"key binary, k long, closed boolean, {_ENDS}")


def long_parts(texts: DataFrame, paths: tuple[str, str], code_type: str, chunk: int, fan: int) -> DataFrame:
    """Groups of long texts (key, text) in parts: key, k, sub, sums and groups. Parts in the order of (k, sub) are the
    groups of the text in order. Texts whose bytes differ have no parts."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _tokenizers(*paths).cut
        names = ["key", "k", "text", "start", "end"]
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                for k, (part, start, end) in enumerate(byte_ranges(" " + text.as_py(), cut, chunk)):
                    columns = [pa.array([key.as_py()], pa.binary()), pa.array([k]), pa.array([part]), pa.array([start]), pa.array([end])]
                    yield pa.record_batch(columns, names=names)

    ranges = texts.mapInArrow(split, "key binary, k long, text string, start long, end long").dropDuplicates(["key", "k"])
    fragments = materialize(_fragments(ranges, paths, code_type), "fragments")
    level, between = fragments, []
    while True:
        level = materialize(_compose(level, fan), "composed")
        between.append(level.filter("closed").select("key", "k", "pa", "pb"))
        level = level.filter("NOT closed")
        if not (level.agg(F.max("k")).first()[0] or 0):
            break
    # The start of a text is a common end, so the first prefix of the whole is a group as well.
    whole = level.filter("ok")
    between.append(whole.select("key", F.coalesce("first", F.lit(0)).cast("long").alias("k"), "pa", "pb"))
    groups = between[0]
    for more in between[1:]:
        groups = groups.unionByName(more)
    size_b = _tokenizers(*paths).size_b

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, k, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = Part.of(Groups(np.array(a), np.array(b), np.array([len(a)]), np.array([len(b)])), size_b)
                rows.append([key, k, 0, *part.row(code_type), part.text])
            if rows:
                yield _batch(rows, _MET)

    columns = f"key binary, k long, sub int, {_SUMS}, groups string"
    met = groups.filter(F.size("pa") + F.size("pb") > 0).select("key", "k", "pa", "pb").mapInArrow(describe, columns)
    closed = fragments.filter("n_groups > 0").withColumn("sub", F.lit(1)).select(*met.columns)
    return closed.unionByName(met).join(whole.select("key"), "key", "left_semi")


def _long_pairs(parts: DataFrame, code_type: str) -> DataFrame:
    """Distinct (key, code) of the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, length = _flat(batch.column(1), code_type)
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(length)), length)))
            yield pa.record_batch([keys, pa.array(codes)], names=["key", "code"])

    return parts.select("key", "codes").mapInArrow(run, "key binary, code long").distinct()


def _long_summaries(parts: DataFrame, counts: BlockTable, code_type: str) -> DataFrame:
    """Results per key: the parts of a text stream by in order, nothing of it is held but sums and the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.binary()), *((c, pa.int64()) for c in _NUMBERS), ("groups_sha256", pa.string())])
        at, sums, digest = None, None, None
        for part in slices(batches, SLICE_BYTES):
            plain = np.column_stack([_joined(part.column(c)).to_numpy() for c in _NUMBERS[:4]])
            rows = np.concatenate([plain, _counted(part, counts, code_type)], axis=1)
            for key, row, groups in zip(part.column("key").to_pylist(), rows, part.column("groups").to_pylist(), strict=True):
                if key != at:
                    if at is not None:
                        yield _row([at, *sums.tolist(), digest.hexdigest()], schema)
                    at, sums, digest = key, np.zeros(len(_NUMBERS), np.int64), hashlib.sha256()
                elif sums[2]:
                    digest.update(b";")
                digest.update(groups.encode())
                sums += row
        if at is not None:
            yield _row([at, *sums.tolist(), digest.hexdigest()], schema)

    rows = parts.repartition("key").sortWithinPartitions("key", "k", "sub").drop("k", "sub")
    return rows.mapInArrow(run, f"key binary, {_RESULT}")


def _code_type(tokenizers: Tokenizers) -> str:
    return "<u4" if len(tokenizers.length_a) * tokenizers.size_b < 1 << 32 else "<u8"


def _split_rows(docs: DataFrame, text: str, carry: list[str], chunk: int) -> tuple[DataFrame, DataFrame]:
    """Rows (row, text) of whole texts, and rows (row, key, text) of those to be cut."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{text}`").alias("text"))
    long = F.coalesce(F.length("text") > chunk, F.lit(False))
    return rows.filter(~long), rows.filter(long).select("row", F.unhex(F.md5("text")).alias("key"), "text")


def align_documents(docs: DataFrame, path_a: str, path_b: str, carry: list[str], text: str = "text", chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Per row: `row` (struct of `carry`), n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their
    A id), count_sum (over links) and groups_sha256 of `a1,a2|b1;a3|b2`."""
    paths, tokenizers = (path_a, path_b), _tokenizers(path_a, path_b)
    kind = _code_type(tokenizers)
    short, long = _split_rows(docs, text, carry, chunk)
    parts = materialize(long_parts(long.select("key", "text"), paths, kind, chunk, fan), "parts")
    copies = long.groupBy("key").agg(F.count("*").alias("n"))
    sums = materialize(_parts_of_texts(short, paths, kind, full=False), "sums")
    pairs = _pair_counts(sums, kind).unionByName(_long_pairs(parts, kind).join(copies, "key").select("code", "n"))
    pairs = pairs.groupBy("code").agg(F.sum("n").alias("n"))
    highest = F.max("n").over(Window.partitionBy(F.expr(f"code div {tokenizers.size_b}")))
    counts = write_blocks(pairs.select("code", "n", (F.col("n") == highest).cast("int").alias("best")), "pair_counts")
    of_long = long.select("row", "key").join(_long_summaries(parts, counts, kind), "key", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _NUMBERS]
    of_long = of_long.select("row", *zero, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    return _summaries(sums, counts, kind).unionByName(of_long)


def aligned_groups(docs: DataFrame, path_a: str, path_b: str, carry: list[str], text: str = "text", chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """The groups themselves: `row`, part numbers (k, sub) and `groups` as `a1,a2|b1;a3|b2`. The parts of a row in the
    order of (k, sub) are its groups in order; rows without tokens have no part."""
    paths = (path_a, path_b)
    kind = _code_type(_tokenizers(*paths))
    short, long = _split_rows(docs, text, carry, chunk)
    whole = _parts_of_texts(short, paths, kind, full=True).filter("n_groups > 0")
    parts = materialize(long_parts(long.select("key", "text"), paths, kind, chunk, fan), "parts")
    found = long.select("row", "key").join(parts, "key").select("row", "k", "sub", "groups")
    return whole.select("row", F.lit(0).cast("long").alias("k"), F.lit(1).alias("sub"), "groups").unionByName(found)
