"""WARC archives with revisit resolution.

``write`` makes one response record per page, each a gzip member of its own, in files of at most ``FILE_RECORDS``
records; ``read`` parses archives back. ``deduplicate`` shuffles only the records' headers by payload digest and length,
names the record with the smallest page_id the original (null ids last, then the record id), joins that back to the
records, and writes archives anew: originals with payload, the others as revisit records that refer to the original.
All headers are fresh: record ids, lengths, digests, references.

Files are written by Spark's text writer, so its commit protocol covers lost executors, and any file system will do. It
ends each row with a NUL, which is the last byte of a gzip member of under 16 MiB; a longer record takes several members,
as gzip allows. Payloads are the pages' html in UTF-8; a null html is empty. Equal page ids on several rows are
separate records. An empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.llm.common import batches, remove, rows_of, shared_path

FILE_RECORDS = 20_000
MEMBER = (1 << 24) - 1
CHUNK = 1 << 14
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's for URLs
URL_SAFE = "".join(chr(c) for c in range(0x21, 0x7F) if chr(c) != "%")


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, as WARC files have it."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(kind: str, headers: dict[str, object], block: bytes) -> bytes:
    fields = {"WARC-Type": kind, **headers, "WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Type": "application/http;msgtype=response", "Content-Length": len(block)}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def members(data: bytes) -> bytes:
    """``data`` as gzip members, without the NUL that ends the last one."""
    out = []
    for at in range(0, len(data), MEMBER):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(packer.compress(data[at : at + MEMBER]) + packer.flush())
    return b"".join(out)[:-1]


def http(payload: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()


def urn(name: str) -> str:
    return f"<urn:uuid:{name}>"


def save(rows: DataFrame, path: str) -> None:
    rows.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def write(pages: DataFrame, path: str, date: str | None = None) -> None:
    """A response record for each page (page_id, url, html)."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in it:
                for page_id, url, html in rows_of(batch, "page_id", "url", "html"):
                    payload = (html or "").encode()
                    head = {"WARC-Record-ID": urn(uuid.uuid4()), "WARC-Date": date, "WARC-Target-URI": None if url is None else quote(url, URL_SAFE), "WARC-Payload-Digest": f"sha1:{digest(payload)}", "Payload-Length": len(payload), "Page-ID": page_id}
                    yield (members(record("response", head, http(payload) + payload)),)

        yield from batches(rows(), "value binary", 500)

    save(pages.select("page_id", "url", "html").mapInArrow(each, "value binary"), path)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record in an archive file. Only one record is unpacked at a time."""
    held, at, view = b"", 0, memoryview(data)
    while at < len(data):
        unpacker, parts = zlib.decompressobj(31), [held]
        while at < len(data) and not unpacker.eof:
            parts.append(unpacker.decompress(view[at : at + CHUNK]))
            at = min(at + CHUNK, len(data))
        at -= len(unpacker.unused_data)
        held = b"".join(parts)
        while b"\r\n\r\n" in held:
            end = held.index(b"\r\n\r\n") + 4
            head = held[:end].decode().split("\r\n")
            if not head[0].startswith("WARC/1."):
                raise ValueError(f"not a WARC record: {head[0][:40]!r}")
            fields = dict(line.split(": ", 1) for line in head[1:] if line)
            size = int(fields["Content-Length"])
            if len(held) < end + size + 4:
                break
            yield fields, held[end : end + size]
            held = held[end + size + 4 :]
    if held:
        raise ValueError("an archive ends inside a record")


READ = "page_id bigint, url string, record_id string, record_type string, warc_date string, payload_digest string, payload_bytes bigint, refers_to_record string, refers_to bigint"


def read(spark: SparkSession, path: str, payload: bool = False, packed: bool = False) -> DataFrame:
    """One row per record; with ``payload``, a response's payload too (``packed``: compressed). A payload that doesn't fit its digest raises."""
    ddl = READ + ", payload binary" * payload

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in it:
                for content in batch.column(0):
                    for fields, block in parsed(content.as_buffer().to_pybytes()):
                        body, name = block[block.index(b"\r\n\r\n") + 4 :], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if fields["WARC-Type"] == "response" and digest(body) != name:
                            raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't fit its digest")
                        number = lambda k: int(fields[k]) if k in fields else None
                        url = fields.get("WARC-Target-URI")
                        yield (number("Page-ID"), None if url is None else unquote(url), fields["WARC-Record-ID"], fields["WARC-Type"], fields["WARC-Date"], name, number("Payload-Length"), fields.get("WARC-Refers-To"), number("Refers-To-Page-ID"), *([zlib.compress(body) if packed else body] if payload else []))

        yield from batches(rows(), ddl, 500 if payload else 5000)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(each, ddl)


def resolved(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """record_id and, for records that revisit another, that one's id, page and url; payloads under ``least_bytes`` stay."""
    rank = F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "record_id", "url", "warc_date")
    first = headers.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(F.min(rank).alias("first"))
    light = headers.select("record_id", "payload_digest", "payload_bytes").join(first, ["payload_digest", "payload_bytes"], "left")
    return light.select("record_id", F.when(F.col("first.record_id") != F.col("record_id"), F.col("first")).alias("original"))


def deduplicate(spark: SparkSession, source: str, target: str, least_bytes: int = 0) -> None:
    """Reads the archives at ``source`` and writes them to ``target`` with revisit records for repeated payloads."""
    whole = read(spark, source, True, packed=True).join(resolved(read(spark, source), least_bytes), "record_id")
    slim = whole.withColumn("payload", F.when(F.col("original").isNull(), F.col("payload")))
    flat = slim.select("page_id", "url", "record_id", "warc_date", "payload_digest", "payload_bytes", "payload", *[F.col(f"original.{k}").alias(f"first_{k}") for k in ("page_id", "url", "record_id", "warc_date")])

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = lambda name: urn(uuid.uuid5(NAMESPACE, name))
        address = lambda url: None if url is None else quote(url, URL_SAFE)

        def rows():
            for batch in it:
                for page_id, url, name, date, sha1, size, payload, first_page, first_url, first_name, first_date in rows_of(batch, *batch.schema.names):
                    head = {"WARC-Record-ID": fresh(name), "WARC-Date": date, "WARC-Target-URI": address(url), "WARC-Payload-Digest": f"sha1:{sha1}", "Payload-Length": size, "Page-ID": page_id}
                    if first_name is None:
                        payload = zlib.decompress(payload)
                        one = record("response", head, http(payload) + payload)
                    else:
                        head |= {"WARC-Refers-To": fresh(first_name), "WARC-Refers-To-Target-URI": address(first_url), "WARC-Refers-To-Date": first_date, "WARC-Profile": PROFILE, "Refers-To-Page-ID": first_page}
                        one = record("revisit", head, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
                    yield (members(one),)

        yield from batches(rows(), "value binary", 500)

    save(flat.mapInArrow(each, "value binary"), target)


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes, deduplicates and reads back; the deduplicated archives stay in the shared folder, the first ones go."""
    spark = pages.sparkSession
    first, last = shared_path(spark, "warc"), shared_path(spark, "warc-deduplicated")
    write(pages, first)
    deduplicate(spark, first, last, least_bytes)
    remove(spark, first)
    return read(spark, last)
