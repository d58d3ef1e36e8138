"""WARC records as a table of chunks.

A record is rows of (archive, record_id, chunk_no, last, data, digest_so_far). The data of a
record's chunks, one after the other, are the bytes of a WARC 1.1 record; ``digest_so_far``
is the SHA-1 of the payload up to the chunk's end. Writer and reader hold one chunk of an
oversized payload at a time and carry its digest along, and the reader finds the first chunk
that does not agree. Records of one chunk are read where they lie; only the chunks of
longer ones are shuffled, to stand in order.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_folder

CHUNK_BYTES = 64 << 10
#: A payload of so many bytes is stored once.
REVISIT_BYTES = 1000
CHUNKS = "archive int, record_id string, chunk_no int, last boolean, data binary, digest_so_far string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest and refers_to: the largest page_id with the same payload, where that is another page.

    Only ids and digests are grouped; payloads are moved once, by page_id, so that a payload
    that a third of all pages have is no hot key. A null html is an empty payload. Pages
    without an id and repeated rows of the kept page are responses.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long = rows.where(F.length("payload") >= least).select("page_id", "digest")
    kept = long.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = long.join(kept, "digest").where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()
    return rows.join(revisits, ["page_id", "digest"], "left")


def record_urn(page_id: int | None, digest: str) -> str:
    """A record's id: its page and its payload's digest, so that pages whose ids repeat have records of their own, and a revisit can name the record it refers to."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def header(page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None, date: str) -> bytes:
    target = "".join(c for c in url or "" if c not in "\r\n")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_urn(page_id, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_urn(refers_to, digest)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"Content-Length: {size if refers_to is None else 0}", "", ""]
    return "\r\n".join(lines).encode()


def chunk_rows(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES, date: str | None = None) -> DataFrame:
    """The chunk rows of ``with_revisits`` rows; ``date`` (ISO 8601, UTC) is that of all records, else the time of the call."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, n = TaskContext.get().partitionId(), 0
        out: list[tuple] = []
        held = 0
        for batch in batches:
            ids, urls, digests, refers = (batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to"))
            for i, payload in enumerate(batch.column("payload")):
                body = memoryview(payload.as_buffer() or b"")
                head = header(ids[i], urls[i], digests[i], len(body), refers[i], date)
                stored = body if refers[i] is None else body[:0]
                running, record, at, no = hashlib.sha1(), f"{archive:08d}-{n:010d}", 0, 0
                n += 1
                while True:
                    piece = stored[at : at + chunk_bytes]
                    running.update(piece)
                    at += len(piece)
                    last = at >= len(stored)
                    data = b"".join((head if not no else b"", piece, b"\r\n\r\n" if last else b""))
                    out.append((archive, record, no, last, data, running.hexdigest()))
                    held += len(data)
                    no += 1
                    if held >= 4 << 20:
                        yield _batch(out)
                        out, held = [], 0
                    if last:
                        break
        if out:
            yield _batch(out)

    return rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, CHUNKS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.string())
    names = ["archive", "record_id", "chunk_no", "last", "data", "digest_so_far"]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def write(rows: DataFrame, path: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> str:
    """Writes the archives of ``with_revisits`` rows and returns their path."""
    path = path or f"{shared_folder(rows.sparkSession)}/warc-{uuid.uuid4().hex}"
    chunk_rows(rows, chunk_bytes).write.parquet(path)
    return path


class Record:
    """A record that is read chunk by chunk: the header, then the payload's length and digest so far."""

    def __init__(self) -> None:
        self.head, self.fields, self.seen, self.tail, self.sha = b"", None, 0, b"", hashlib.sha1()

    def add(self, data: memoryview, digest: str) -> None:
        if self.fields is None:
            self.head += bytes(data)
            if (end := self.head.find(b"\r\n\r\n")) < 0:
                return
            lines = self.head[:end].decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError(f"no WARC record: {lines[0][:40]!r}")
            self.fields = dict(x.split(": ", 1) for x in lines[1:])
            self.size = int(self.fields["Content-Length"])
            data, self.head = memoryview(self.head)[end + 4 :], b""
        body = data[: self.size - self.seen]
        self.sha.update(body)
        self.seen += len(body)
        self.tail += bytes(data[len(body) :])
        if self.sha.hexdigest() != digest:
            raise ValueError(f"payload differs from its digest after {self.seen} bytes: {self.fields['WARC-Record-ID']}")

    def result(self) -> tuple:
        if self.fields is None or self.seen != self.size or self.tail != b"\r\n\r\n":
            raise ValueError("a record ends too early")
        page = lambda name: self.fields.get(name, "::").split(":")[2]
        number = lambda name: int(page(name)) if page(name) else None
        kind, digest = self.fields["WARC-Type"], self.fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and self.sha.hexdigest() != digest:
            raise ValueError(f"payload differs from its digest: {self.fields['WARC-Record-ID']}")
        return number("WARC-Record-ID"), int(self.fields["WARC-Payload-Length"]), digest, kind, number("WARC-Refers-To")


def parse(chunks: DataFrame) -> DataFrame:
    """Records of chunks that stand in order; a record may go on in the next batch, not in another partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record = Record()
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for batch in batches:
            out = []
            for data, last, digest in zip(batch.column("data"), batch.column("last").to_pylist(), batch.column("digest_so_far").to_pylist(), strict=True):
                record.add(memoryview(data.as_buffer()), digest)
                if last:
                    out.append(record.result())
                    record = Record()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if record.fields or record.head:
            raise ValueError("a record ends too early")

    return chunks.select("data", "last", "digest_so_far").mapInArrow(run, RECORDS)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives at ``path``; every payload is read and held against its digests."""
    chunks = spark.read.schema(CHUNKS).parquet(path)
    alone = (F.col("chunk_no") == 0) & F.col("last")
    long = chunks.where(~alone).repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return parse(chunks.where(alone)).unionByName(parse(long))
