"""Token ids in Arrow IPC files: record batches of fixed-size lists, one row per equal-length sequence, and its mask.

Documents are tokenized in ascending id order, each closed by the end id, and packed without gaps into sequences of
`length` ids. Every shard (a range of ids) is a file whose batches all hold `BATCH` sequences but the last, so sequence
i is row i % BATCH of batch i // BATCH, mapped without a copy; the mask is false where the last sequence is padding.
Beside it lies an index with the place of each document in the shard. Ids are stored as 16 bits where the vocabulary
allows it, else as 32 bits.

A word between ASCII white space is tokenized once per part of a batch, and runs of letters are remembered: the
tokenizer's own normaliser and splitter (split at white space, runs of letters apart from runs of punctuation) treat
them one by one. Texts that hold the mark of a special token go through the tokenizer whole.

Defined results: a null or empty text is the end id alone; null ids come first; equal ids are ordered by text; repeated
rows are written as often as they occur; an empty table gives no file and an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc as ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.llm.shards import file_system, shard_of, shard_starts, write_files
from lawloom.session import scratch_path

LENGTH, BATCH, END_ID = 2048, 64, 2
SHARD_BYTES = 24 << 20  # text of a shard
CACHED_RUNS, RUNS_PER_CALL = 400_000, 20_000
PART_BYTES = 4 << 20  # text that is worked on at once
# Letters, then ASCII punctuation but the apostrophe, with which the tokenizer's splitter joins endings to words.
_LETTERS_AND_MARKS = r"^(?P<letters>\p{L}*)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"


class Encoder:
    """Ids of whole texts as little-endian bytes of the smallest type that holds the vocabulary."""

    def __init__(self, tokenizer_path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task has one core
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.kind = np.dtype("<u2") if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else np.dtype("<u4")
        self.end = self._bytes([end_id])
        self.marks = [t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.runs: dict[str, bytes] = {}
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closes[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.kind).tobytes()

    def whole(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_texts(pa.array([text], pa.string())))

    def encode_texts(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text and the end id, in the order of the texts."""
        start, held, sizes = 0, 0, pc.binary_length(texts).fill_null(0).to_pylist()
        for i, n in enumerate([*sizes, None]):
            if n is None or held + n > PART_BYTES and i > start:
                yield from self._encode_part(texts.slice(start, i - start).fill_null(""))
                start, held = i, 0
            held += n or 0

    def _encode_part(self, texts: pa.Array) -> Iterator[bytes]:
        special = [False] * len(texts)
        for m in self.marks:
            special = [a or b for a, b in zip(special, pc.match_substring(texts, m).to_pylist(), strict=True)]
        split = pc.ascii_split_whitespace(pc.if_else(pa.array(special, pa.bool_()), "", texts))
        words = split.flatten().dictionary_encode()
        runs, of_word = self._runs_of(words.dictionary)
        lengths = np.array([len(r) for r in runs], np.int64) // self.kind.itemsize
        starts = np.cumsum(lengths) - lengths
        values = np.frombuffer(b"".join(runs), self.kind)
        # Every word is two runs, and every document is closed by the run of the end id, which is the last one.
        ends = split.offsets.to_numpy()[1:] - split.offsets.to_numpy()[0]
        sequence = np.insert(of_word[words.indices.to_numpy()], ends, (len(runs) - 1, len(runs) - 2), axis=0).ravel()
        n = lengths[sequence]
        closed = np.cumsum(n)
        at = np.arange(closed[-1] if len(closed) else 0) + np.repeat(starts[sequence] - (closed - n), n)
        ids = values[at]
        bounds = closed[2 * (ends + np.arange(1, len(ends) + 1)) - 1].tolist()
        for k, (x, y) in enumerate(zip([0, *bounds[:-1]], bounds, strict=True)):
            yield self.whole(texts[k].as_py()) + self.end if special[k] else ids[x:y].tobytes()

    def _runs_of(self, words: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """Runs of ids, and the two runs of each word. A run of letters, and a run of punctuation after it, are pieces that
        the tokenizer's splitter keeps apart, so each is encoded once; any other word is one run by itself."""
        found = pc.extract_regex(words, _LETTERS_AND_MARKS)
        fits = found.is_valid().to_numpy(zero_copy_only=False)
        letters = pc.ascii_lower(found.field("letters").filter(found.is_valid())).dictionary_encode()
        marks = found.field("marks").filter(found.is_valid()).dictionary_encode()
        odd = words.filter(pc.invert(found.is_valid())).to_pylist()
        names = [*letters.dictionary.to_pylist(), *marks.dictionary.to_pylist()]
        if len(self.runs) > CACHED_RUNS:
            self.runs.clear()
        new = list({x for x in names if x and x not in self.runs})
        for i in range(0, len(new), RUNS_PER_CALL):
            self._encode_runs(new[i : i + RUNS_PER_CALL])
        runs = [self.runs[x] if x else b"" for x in names]
        of_word = np.empty((len(words), 2), np.int64)
        of_word[fits, 0] = letters.indices.to_numpy()
        of_word[fits, 1] = marks.indices.to_numpy() + len(letters.dictionary)
        of_word[~fits, 0] = np.arange(len(odd)) + len(runs)
        of_word[~fits, 1] = len(runs) + len(odd)
        return [*runs, *self._encode_odd(odd), b"", self.end], of_word

    def _encode_runs(self, runs: list[str]) -> None:
        """Many runs in one call: each ends with a token that closes a word."""
        found = self.tokenizer.encode_batch_fast([" ".join(runs)], add_special_tokens=False)[0]
        ids = np.array(found.ids, np.int64)
        cuts = np.concatenate(([0], np.flatnonzero(self.closes[ids]) + 1))
        if len(cuts) != len(runs) + 1 or cuts[-1] != len(ids):  # not a vocabulary with word ends
            self.runs.update((r, self.whole(r)) for r in runs)
            return
        raw, size = ids.astype(self.kind).tobytes(), self.kind.itemsize
        for r, x, y in zip(runs, (cuts[:-1] * size).tolist(), (cuts[1:] * size).tolist(), strict=True):
            self.runs[r] = raw[x:y]

    def _encode_odd(self, words: list[str]) -> list[bytes]:
        """Other words, many in one call: a token belongs to the word that its offset lies in."""
        out = []
        for i in range(0, len(words), RUNS_PER_CALL):
            part = words[i : i + RUNS_PER_CALL]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([0, *(len(w) + 1 for w in part)])[:-1]
            owner = np.searchsorted(starts, np.array([o[0] for o in found.offsets], np.int64), side="right") - 1
            cuts = (np.searchsorted(owner, np.arange(len(part) + 1)) * self.kind.itemsize).tolist()
            raw = self._bytes(found.ids)
            out.extend(raw[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True))
        return out


@lru_cache(maxsize=2)
def encoder_of(tokenizer_path: str, end_id: int) -> Encoder:
    """The worker's encoder, which keeps its words for the next task."""
    return Encoder(tokenizer_path, end_id)


def sequence_schema(kind: np.dtype, length: int) -> pa.Schema:
    ids = pa.uint16() if kind.itemsize == 2 else pa.uint32()
    return pa.schema([("input_ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))])


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class _Shard:
    """The open files of a shard: sequences and index."""

    def __init__(self, number: int, temporary, kind: np.dtype, length: int):
        self.number, self.kind, self.length = number, kind, length
        self.schema = sequence_schema(kind, length)
        self.names = (f"tokens-{number:06d}.arrow", f"tokens-{number:06d}.index.arrow")
        self.sinks = []
        for name in self.names:
            fs, path = file_system(temporary(name))
            self.sinks.append(fs.open_output_stream(path, compression=None))
        self.files = [ipc.new_file(s, sc) for s, sc in zip(self.sinks, (self.schema, INDEX), strict=True)]
        self.held, self.held_bytes, self.n, self.docs, self.index = [], 0, 0, 0, []

    def add(self, doc_id, ids: bytes) -> None:
        n = len(ids) // self.kind.itemsize
        self.index.append((doc_id, self.n, n))
        self.held.append(ids)
        self.held_bytes += len(ids)
        self.n += n
        self.docs += 1
        if self.held_bytes >= BATCH * self.length * self.kind.itemsize:
            self._flush(False)

    def _batch(self, ids: np.ndarray, valid: np.ndarray) -> None:
        size = BATCH * self.length
        for i in range(0, len(ids), size):
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x[i : i + size]), self.length) for x in (ids, valid)]
            self.files[0].write_batch(pa.record_batch(lists, schema=self.schema))

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), dtype=self.kind)
        full = len(ids) if last else len(ids) // (BATCH * self.length) * BATCH * self.length
        rest = ids[full:].tobytes()
        pad = -full % self.length
        if full:
            self._batch(np.concatenate([ids[:full], np.zeros(pad, self.kind)]), np.arange(full + pad) < full)
        self.held, self.held_bytes = [rest], len(rest)
        if self.index:
            columns = [pa.array(x, pa.int64()) for x in zip(*self.index, strict=True)]
            self.files[1].write_batch(pa.record_batch(columns, schema=INDEX))
            self.index = []

    def close(self) -> dict:
        self._flush(True)
        for f in (*self.files, *self.sinks):
            f.close()
        return {"shard": self.number, "n_docs": self.docs, "n_tokens": self.n}


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text",
                      length: int = LENGTH, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the files below `folder`; returns the manifest, one row per file."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    starts = shard_starts(rows, "doc_id", F.octet_length(F.coalesce("text", F.lit(""))) + 64, shard_bytes)

    def write(batches: Iterator[pa.RecordBatch], temporary) -> Iterator[dict]:
        encoder, open_shard = None, None
        for batch in batches:
            encoder = encoder or encoder_of(tokenizer_path, end_id)
            texts = encoder.encode_texts(batch.column(2))
            for number, i, ids in zip(batch.column(0), batch.column(1), texts, strict=True):
                if open_shard is None or open_shard.number != number.as_py():
                    if open_shard:
                        yield from _rows(open_shard)
                    open_shard = _Shard(number.as_py(), temporary, encoder.kind, length)
                open_shard.add(i.as_py(), ids)
        if open_shard:
            yield from _rows(open_shard)

    placed = rows.select(shard_of("doc_id", starts).alias("_shard"), "doc_id", "text")
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    return write_files(placed, len(starts) + 1, order, folder, write, "name string, shard int, n_docs long, n_tokens long")


def _rows(shard: _Shard) -> Iterator[dict]:
    counts = shard.close()
    yield from ({"name": name} | counts for name in shard.names)


def open_file(path: str) -> ipc.RecordBatchFileReader:
    """Mapped into memory where the file system is local, read in pieces elsewhere."""
    fs, inner = file_system(path)
    return ipc.open_file(pa.memory_map(inner) if fs.type_name == "local" else fs.open_input_file(inner))


def sequence(reader: ipc.RecordBatchFileReader, i: int) -> tuple[pa.Array, pa.Array]:
    """Ids and mask of sequence i of a file, without a copy."""
    batch = reader.get_batch(i // BATCH)
    return batch.column(0)[i % BATCH].values, batch.column(1)[i % BATCH].values


def _documents(path: str) -> Iterator[tuple[list, list, list, list]]:
    """Per batch of the index: ids, starts, numbers of tokens, and checksums of the tokens read from the sequences."""
    data = open_file(path)
    kept: dict[int, np.ndarray] = {}
    if data.num_record_batches:
        size = BATCH * data.schema.field(0).type.list_size

    def part(b: int) -> np.ndarray:
        if b not in kept:
            kept.clear()
            kept[b] = data.get_batch(b).column(0).flatten().to_numpy(zero_copy_only=True)
        return kept[b]

    index = open_file(path.removesuffix(".arrow") + ".index.arrow")
    for k in range(index.num_record_batches):
        ids, starts, counts = (c.to_pylist() for c in index.get_batch(k).columns)
        sums = []
        for start, n in zip(starts, counts, strict=True):
            crc, at = 0, start
            while at < start + n:
                b = at // size
                piece = part(b)[at - b * size : start + n - b * size]
                crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                at += len(piece)
            sums.append(crc)
        yield ids, starts, counts, sums


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, read from the files: doc_id, shard, start (over all shards), n_tokens, ids_crc32. The driver adds up
    one number per file."""
    manifest = spark.read.parquet(f"{folder}/_manifest").filter("name NOT LIKE '%.index.arrow'").select("shard", "path", "n_tokens")
    base, rows = 0, []
    for shard, path, n in sorted(map(tuple, manifest.collect())):
        rows.append((shard, path, base))
        base += n
    files = spark.createDataFrame(rows, "shard int, path string, base long").repartitionById(max(1, len(rows)), F.col("shard") % max(1, len(rows)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for ids, starts, counts, sums in _documents(row["path"]):
                    columns = (ids, [row["base"] + s for s in starts], counts, sums, [row["shard"]] * len(ids))
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", "shard"]
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def token_table(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write the files into a fresh folder below the shared one and read them back."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    write_token_files(docs, folder, tokenizer_path, **options)
    return read_token_files(spark, folder)
