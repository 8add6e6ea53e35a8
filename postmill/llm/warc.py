"""WARC records as a table of chunks.

Every page becomes one record: a header, the payload and an empty line. A record is stored as rows
``(record_id, chunk_no, data, digest, last)``: ``data`` of chunk 0 starts with the header, a payload
larger than ``chunk_bytes`` goes on in further rows, and ``digest`` is the SHA-256 of the payload bytes
up to and with that row. Putting ``data`` in the order of ``chunk_no`` gives the record's WARC bytes, so
neither writing nor reading ever needs a second copy of a whole payload. Reading checks every running
digest.

Among payloads of at least ``MIN_REVISIT`` bytes that are equal, the one with the smallest page id is
stored, the others are revisit records without payload that refer to it.

A null html is an empty payload, a null url an empty target. Rows that repeat a page id are a record
each; if they hold the smallest id of equal payloads, each of them is a response. Rows without page id
are a response unless a row with an id has the same payload. An empty table gives an empty archive.
Extra columns are not stored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_REVISIT = 100
CHUNK_BYTES = 256 << 10
DATE = "2000-01-01T00:00:00Z"
BATCH_BYTES = 8 << 20

CHUNKS = "record_id string, chunk_no int, data binary, digest string, last boolean"
FOUND = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def with_types(pages: DataFrame) -> DataFrame:
    """``(page_id, url, payload, digest, first)``; ``first`` is the page that a revisit refers to, else null."""
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    equal = (
        rows.where(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    )
    joined = rows.join(equal, "digest", "left")
    return joined.withColumn("first", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))


def _header(kind: str, record: str, page: int | None, url: str | None, digest: str, stored: int, size: int, first: int | None) -> bytes:
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[^!-~]', _escape, url or '')}", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: text/html; charset=utf-8", f"Content-Length: {stored}",
        f"X-Payload-Length: {size}", f"X-Page-ID: {'' if page is None else page}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {first}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _escape(found: re.Match) -> str:
    return "".join(f"%{b:02X}" for b in found[0].encode("utf-8", "surrogatepass"))


class _Out:
    """Rows gathered until they are worth a batch."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size
        if self.size >= BATCH_BYTES or len(self.rows) >= 8192:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = zip(*self.rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema
            )
        self.rows, self.size = [], 0


def chunk_table(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk rows of every page's record."""
    schema = pa.schema([("record_id", pa.string()), ("chunk_no", pa.int32()), ("data", pa.binary()), ("digest", pa.string()), ("last", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(schema)
        for batch in batches:
            ids, urls, firsts, digests, names = (
                batch.column(c).to_pylist() for c in ("page_id", "url", "first", "digest", "record_id")
            )
            payloads = batch.column("payload")
            for i, name in enumerate(names):
                payload = memoryview(payloads[i].as_buffer())
                size, revisit = len(payload), firsts[i] is not None
                head = _header("revisit" if revisit else "response", name, ids[i], urls[i], digests[i], 0 if revisit else size, size, firsts[i])
                body = payload[:0] if revisit else payload
                hashed, at, number = hashlib.sha256(), 0, 0
                while True:
                    part = body[at : at + chunk_bytes]
                    hashed.update(part)
                    at += len(part)
                    last = at >= len(body)
                    data = b"".join((head if number == 0 else b"", part, b"\r\n\r\n" if last else b""))
                    yield from out.add((name, number, data, hashed.hexdigest(), last), len(data))
                    number += 1
                    if last:
                        break
        yield from out.flush()

    return with_types(pages).withColumn("record_id", F.uuid()).mapInArrow(run, CHUNKS)


def write_archive(pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> None:
    chunk_table(pages, chunk_bytes).write.option("compression", "zstd").parquet(path)


def _field(head: str, name: str) -> str:
    found = re.search(rf"^{name}: ?(.*)\r$", head, re.M)
    return found[1] if found else ""


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from chunk rows that come record by record in the order of their numbers."""
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()),
    ])
    out, head, hashed, left, expected = _Out(schema), "", None, 0, 0
    for batch in batches:
        numbers, digests, lasts = (batch.column(c).to_pylist() for c in ("chunk_no", "digest", "last"))
        for i, number in enumerate(numbers):
            data = memoryview(batch.column("data")[i].as_buffer())
            if number == 0:
                end = bytes(data[:65536]).find(b"\r\n\r\n")
                if end < 0:
                    end = bytes(data).index(b"\r\n\r\n")
                head, data = bytes(data[: end + 2]).decode(), data[end + 4 :]
                hashed, expected, left = hashlib.sha256(), 0, int(_field(head, "Content-Length"))
            elif number != expected:
                raise ValueError(f"chunk {expected} of a record is missing")
            part = data[: len(data) - 4] if lasts[i] else data
            hashed.update(part)
            left, expected = left - len(part), expected + 1
            if hashed.hexdigest() != digests[i]:
                raise ValueError("a chunk differs from its digest")
            if not lasts[i]:
                continue
            kind, digest = _field(head, "WARC-Type"), _field(head, "WARC-Payload-Digest").removeprefix("sha256:")
            if left or kind == "response" and hashed.hexdigest() != digest:
                raise ValueError("a record's payload differs from its header")
            page, first = _field(head, "X-Page-ID"), _field(head, "X-Refers-To-Page-ID")
            yield from out.add((
                int(page) if page else None, _field(head, "WARC-Target-URI"), int(_field(head, "X-Payload-Length")),
                digest, kind, int(first) if first else None,
            ), 200)
    yield from out.flush()


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, every payload checked.

    Records of one chunk, nearly all, are read where they lie; only the chunks of larger ones are brought
    together, and stream through one after the other.
    """
    chunks = spark.read.schema(CHUNKS).parquet(path)
    whole = (F.col("chunk_no") == 0) & F.col("last")
    single = chunks.where(whole).mapInArrow(_read, FOUND)
    several = chunks.where(~whole).repartition("record_id").sortWithinPartitions("record_id", "chunk_no").mapInArrow(_read, FOUND)
    return single.unionByName(several)
