"""WARC 1.1 archives: a deterministic sharded writer, and a reader.

Records are sorted by page id and cut into shards by exact sums of payload bytes; the task of a shard writes gzip
members, one per record, and begins a new file when the compressed size passes the limit. The same pages give the same
files byte for byte, however they were partitioned. Files are published through temporary names and a manifest.

Of records with equal payloads of at least `REVISIT_BYTES` bytes, the one with the largest page id is a response and the
others are revisits that refer to it. Headers, record ids and digests are made anew from the page.

Defined results: a null html is an empty payload; a null url has no target; a null id is always a response and comes
first; of rows equal in id and payload the first by url is the
response, and each has a record id of its own; an empty table gives no file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.llm.shards import file_system, shard_of, shard_starts, write_files
from lawloom.session import scratch_path

REVISIT_BYTES = 1000
SHARD_BYTES = 32 << 20  # payload of a shard
FILE_BYTES = 8 << 20  # compressed size that closes a file
DATE = "2024-01-01T00:00:00Z"
LEVEL = 6
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _record_id(page_id: int | None, digest: str, copy: int = 0) -> str:
    """`copy` counts the rows before it that are equal in id and payload; a revisit refers to copy 0."""
    name = f"{page_id}/{digest}/{copy}" if copy else f"{page_id}/{digest}"
    return f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"


def _clean(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str,
           copy: int = 0) -> bytes:
    """One record with its headers; a revisit holds the HTTP headers of the full payload, not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest, copy)}",
        f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{_base32(digest)}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(4, f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class _Archive:
    """The file of a shard that is open now."""

    def __init__(self, shard: int, temporary, date: str):
        self.shard, self.temporary, self.date, self.number, self.sink = shard, temporary, date, 0, None

    def add(self, raw: bytes) -> None:
        if self.sink is None:
            self.name = f"pages-{self.shard:06d}-{self.number:05d}.warc.gz"
            fs, path = file_system(self.temporary(self.name))
            self.sink, self.records, self.bytes, self.sha = fs.open_output_stream(path, compression=None), 0, 0, hashlib.sha1()
            info = f"software: lawloom\r\nformat: WARC File Format 1.1\r\nshard: {self.shard}\r\n".encode()
            head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {_record_id(None, self.name)[:-1]}>\r\nWARC-Date: {self.date}\r\n"
            head += f"WARC-Filename: {self.name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
            self._put(_member(head.encode() + info + b"\r\n\r\n"))
        self._put(_member(raw))
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.sha.update(data)
        self.bytes += len(data)

    def close(self) -> Iterator[dict]:
        if self.sink is not None:
            self.sink.close()
            self.sink, self.number = None, self.number + 1
            yield {"name": self.name, "shard": self.shard, "records": self.records, "bytes": self.bytes, "sha1": self.sha.hexdigest()}


def write_warc(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = DATE,
               shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives below `folder`; returns the manifest: name, path, shard, records, bytes and sha1 of each file."""
    payload = F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long = rows.filter((F.octet_length("payload") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).select("page_id", "digest")
    kept = long.groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).filter("n > 1").select("digest", "kept")
    starts = shard_starts(rows, "page_id", F.octet_length("payload") + 512, shard_bytes)
    number = shard_of("page_id", starts).alias("_shard")
    nothing = F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload")
    # The small rows that say which page is kept come just before the page that they are about.
    notes = long.join(kept, "digest").select(number, "page_id", "digest", F.lit(0).alias("kind"), "kept", *nothing)
    records = rows.select(number, "page_id", "digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("kept"), "url", "payload")

    def write(batches: Iterator[pa.RecordBatch], temporary) -> Iterator[dict]:
        archive, note, last, copy = None, None, None, 0
        for batch in batches:
            for values in zip(*batch.columns, strict=True):
                shard, i, digest, kind, kept_id, link, data = (v.as_py() for v in values)
                if archive is None or archive.shard != shard:
                    yield from archive.close() if archive else ()
                    archive = _Archive(shard, temporary, date)
                if kind == 0:
                    note = (i, digest, kept_id)
                    continue
                copy = copy + 1 if last == (i, digest) else 0
                same = note is not None and note[:2] == (i, digest)
                revisit = same and (note[2] != i or last == (i, digest))
                archive.add(record(i, link, data, digest, note[2] if same else None, revisit, date, copy))
                last = (i, digest)
                if archive.bytes >= file_bytes:
                    yield from archive.close()
        yield from archive.close() if archive else ()

    order = [F.col("page_id").asc_nulls_first(), F.col("digest"), F.col("kind"), F.col("url").asc_nulls_first()]
    schema = "name string, shard int, records long, bytes long, sha1 string"
    return write_files(records.unionByName(notes), len(starts) + 1, order, folder, write, schema)


def _members(path: str) -> Iterator[bytes]:
    """Decompressed gzip members of a file, which is read in pieces."""
    fs, inner = file_system(path)
    with fs.open_input_stream(inner, compression=None) as source:
        z, parts, data = zlib.decompressobj(31), [], source.read(1 << 20)
        while data:
            parts.append(z.decompress(data))
            if z.eof:
                yield b"".join(parts)
                data, z, parts = z.unused_data, zlib.decompressobj(31), []
            else:
                data = b""
            data = data or source.read(1 << 20)
        if parts:
            raise EOFError(f"{path} ends inside a record")


def parse_record(raw: bytes) -> dict:
    """Headers by lower-case name, `block`, and for HTTP blocks `http` (headers) and `payload`."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    out = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    out["block"] = rest[: int(out["content-length"])]
    if out["content-type"].startswith("application/http"):
        http, _, out["payload"] = out["block"].partition(b"\r\n\r\n")
        out["http"] = {k.lower(): v for k, v in (x.split(": ", 1) for x in http.decode().split("\r\n")[1:])}
    return out


def read_warc(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """Per record, read from the archives of the manifest and checked against its digests: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, file; the payload itself on request (null for revisits)."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "file"] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def rows(path: str) -> Iterator[tuple]:
        for raw in _members(path):
            r = parse_record(raw)
            if r["warc-type"] == "warcinfo":
                continue
            digest = base64.b32decode(r["warc-payload-digest"].removeprefix("sha1:")).hex()
            if hashlib.sha1(r["block"]).digest() != base64.b32decode(r["warc-block-digest"].removeprefix("sha1:")):
                raise ValueError(f"{path}: block of page {r.get('page-id')} does not match its digest")
            revisit = r["warc-type"] == "revisit"
            if not revisit and hashlib.sha1(r["payload"]).hexdigest() != digest:
                raise ValueError(f"{path}: payload of page {r.get('page-id')} does not match its digest")
            whole = (_int(r.get("page-id")), r.get("warc-target-uri"), int(r["http"]["content-length"]), digest, r["warc-type"],
                     _int(r.get("refers-to-page-id")), path.rsplit("/", 1)[-1], None if revisit else r["payload"])
            yield whole[: len(names)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                for row in rows(path):
                    held.append(row)
                    size += row[2] if with_payload else 200
                    if size > 4 << 20:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    def _batch(held: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=False)], names=names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string"
    files = spark.read.parquet(f"{folder}/_manifest").select("path")
    spread = max(1, min(files.count(), 10_000))
    return files.repartition(spread, "path").mapInArrow(read, schema + ", payload binary" * with_payload)


def _int(text: str | None) -> int | None:
    return None if text is None else int(text)


def warc_table(pages: DataFrame, **options) -> DataFrame:
    """Write the archives into a fresh folder below the shared one and read them back."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    write_warc(pages, folder, **options)
    return read_warc(spark, folder)
