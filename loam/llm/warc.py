"""WARC archives: writing pages as records, and reading archives back record by record.

An archive is a file of gzip members, one per record. The writer names an archive by
its partition and attempt, writes it under another name and renames it when it is
complete. Only archives of attempts that succeeded are listed and read, so a task that
runs again, or late, never touches a file that is read. The reader is sequential: it inflates a
member incrementally, takes the record's block by its content length and verifies the
block's digest; memory is bounded by a chunk and one record.

The folder can be any that ``pyarrow.fs`` and Spark both reach by the same address (local
and HDFS ones are; schemes that only Spark knows, such as ``s3a``, aren't).
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import even_join, fresh_path, narrow_input, spool

#: Shared digests that are broadcast at most (some 20 MB).
SHARED_DIGESTS = 200_000
#: Payloads of fewer bytes are never revisited.
LEAST_PAYLOAD = 100
CHUNK = 1 << 16
_LEVEL = 1
_VERSION = b"WARC/1.1"
#: A fixed date: the same pages give the same archives.
_DATE = "1970-01-01T00:00:00Z"


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


class WarcError(ValueError):
    pass


def block_digest(block: bytes) -> str:
    return "sha256:" + base64.b32encode(hashlib.sha256(block).digest()).decode().rstrip("=")


def write_record(out: BinaryIO, headers: dict[str, str], block: bytes) -> None:
    """One gzip member: version, headers, block of the given length, two line ends."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    packer = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    out.write(packer.compress(_VERSION + b"\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode()))
    out.write(packer.compress(block))
    out.write(packer.compress(b"\r\n\r\n") + packer.flush())


def _members(source: BinaryIO) -> Iterator[bytes]:
    """The inflated bytes of each gzip member."""
    rest = b""
    while rest or (rest := source.read(CHUNK)):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            parts.append(inflate.decompress(rest))
            rest = inflate.unused_data
            if not inflate.eof and not (rest := source.read(CHUNK)):
                raise WarcError("the archive ends within a record")
        yield b"".join(parts)


def read_records(source: BinaryIO) -> Iterator[Record]:
    """All records of an archive in order; raises ``WarcError`` on bad framing or a bad digest."""
    for member in _members(source):
        head, gap, body = member.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        if not gap or not lines[0].startswith(b"WARC/"):
            raise WarcError("not a WARC record")
        headers = {k.decode().lower(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
        length = int(headers["content-length"])
        if len(body) != length + 4 or body[length:] != b"\r\n\r\n":
            raise WarcError("the content length does not fit the record")
        block = body[:length]
        if "warc-block-digest" in headers and headers["warc-block-digest"] != block_digest(block):
            raise WarcError("the block digest does not fit")
        yield Record(headers, block)


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> tuple[dict[str, str], bytes]:
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Date": _DATE,
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": block_digest(block),
    }
    if url:
        headers["WARC-Target-URI"] = "".join(url.split())
    if revisit:
        headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        headers["WARC-Refers-To"] = f"<urn:page:{refers_to}>"
    return headers, block


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    name = f"{root}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
    draft = f"{name}.draft"
    records, size = 0, 0
    with store.open_output_stream(draft, compression=None) as out:
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                packed = io.BytesIO()
                payload = (html.as_py() or "").encode()
                write_record(packed, *_record(page_id.as_py(), url.as_py(), payload, digest.as_py(), refers_to.as_py()))
                out.write(packed.getvalue())
                records += 1
                size += packed.tell()
    if records:
        store.move(draft, name)
        yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[1]]), pa.array([records]), pa.array([size])], ["archive", "records", "bytes"])
    else:
        store.delete_file(draft)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``(page_id, url, html)`` rows as WARC archives to ``folder``; ``(archive, records, bytes)``, one row per archive.

    Of records with equal payloads of ``LEAST_PAYLOAD`` bytes or more the one with the
    smallest page_id is a response and the others revisit it; shorter ones are
    responses. Rows that repeat the smallest id are responses too; a null id comes after
    all others, and payloads that only null ids have are responses. Null html is empty.
    """
    hashed = narrow_input(pages, page_id="page_id", url="url", html="html").withColumns(
        {"page_id": F.col("page_id").cast("long"), "digest": F.unhex(F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))}
    )
    # Only digests that several pages share, without their payloads, go through the aggregation.
    first = (
        hashed.where(F.octet_length("html") >= LEAST_PAYLOAD).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    )
    rows = even_join(hashed, spool(first, "digests"), "digest", by="page_id", how="left", limit=SHARED_DIGESTS).withColumn(
        "refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    )
    return spool(
        rows.select("page_id", "url", "html", F.lower(F.hex("digest")).alias("digest"), "refers_to").mapInArrow(
            lambda it: _write(it, folder), "archive string, records long, bytes long"
        ),
        "archives",
    )


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, root = fs.FileSystem.from_uri(folder)
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for archive in batch.column(0).to_pylist():
            rows = []
            with store.open_input_stream(f"{root}/{archive}", compression=None) as source:
                for record in read_records(source):
                    rows.append(_described(record))
                    if len(rows) == 1024:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _described(record: Record) -> tuple:
    h = record.headers
    http, _, payload = record.block.partition(b"\r\n\r\n")
    digest = h["warc-payload-digest"].removeprefix("sha256:")
    length = int(http.lower().rpartition(b"content-length:")[2])
    revisit = h["warc-type"] == "revisit"
    if not revisit and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise WarcError("the payload digest does not fit")
    return _page(h["warc-record-id"]), h.get("warc-target-uri"), length, digest, h["warc-type"], _page(h["warc-refers-to"]) if revisit else None


def read_archives(spark: SparkSession, folder: str, archives: DataFrame) -> DataFrame:
    """``(page_id, url, payload_bytes, payload_digest, record_type, refers_to)`` for every record of the archives named."""
    return archives.select("archive").mapInArrow(
        lambda it: _read(it, folder),
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long",
    )


def unfit_revisits(records: DataFrame) -> DataFrame:
    """Revisits among ``read_archives`` rows that refer to no response of the same payload digest and length."""
    responses = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    return records.where("record_type = 'revisit'").join(responses, ["refers_to", "payload_digest", "payload_bytes"], "left_anti")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to the shared folder and read the archives back: one row per row of ``pages``.

    As in ``write_archives``; rows that repeat an id give records of equal ids, extra
    columns are ignored and an empty table gives no rows.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    archives = write_archives(pages, folder)
    return read_archives(spark, folder, archives.repartition(spark.sparkContext.defaultParallelism, "archive"))


ORACLE_SQL = """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM hashed
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM firsts
"""
