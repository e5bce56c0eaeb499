"""WARC archives: written as one gzip member per record, read back sequentially.

Writing: every page becomes a WARC/1.1 record whose block is a HTTP response; its payload is the html in UTF-8. Of records
with equal payloads of at least ``LEAST`` bytes, that with the smallest page_id is a ``response`` and the others are
``revisit`` records that refer to it and leave the payload out; smaller ones are all ``response``. Tasks write archives
of about ``ARCHIVE`` bytes into a folder that executors share, under a temporary name first, so a repeated task leaves
whole files only.

Reading: an archive is a stream; members are decompressed a piece at a time, a record is framed by its headers and
Content-Length, and block and payload digests are verified. A task holds one record and one piece of input at a time.

Edge cases: null html: an empty payload. Empty payloads, and those under ``LEAST`` bytes, are never revisits. A null
page_id or url leaves its header out; rows with a null page_id are revisits where a row with an id has their payload,
else responses. Rows that repeat the smallest page_id of a payload are all responses. No rows give no rows. Other
columns are not archived.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import bounded_batches, cut, joined, partitions, scratch

LEAST, ARCHIVE, PIECE = 100, 64 << 20, 1 << 18
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


class WarcError(ValueError):
    """An archive that breaks the format, or a digest that doesn't hold."""


@dataclass
class Record:
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    @property
    def payload(self) -> bytes:
        return self.block.partition(END)[2]

    @property
    def http(self) -> dict[str, str]:
        return _headers(self.block.partition(END)[0])


def _headers(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _digest(data: bytes) -> str:
    return f"sha256:{hashlib.sha256(data).hexdigest()}"


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """The gzip member of one record."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}"]
    if page_id is not None:
        lines.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"WARC-Payload-Digest: {_digest(payload)}")
    if refers_to is None:
        block += payload
    lines += [f"WARC-Block-Digest: {_digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join((packer.compress("\r\n".join(lines).encode() + END + block + END), packer.flush()))


def records(stream: BinaryIO, piece: int = PIECE) -> Iterator[Record]:
    """The records of an archive, one by one."""
    left = stream.read(piece)
    while left:
        unpacker, held, headers, need = zlib.decompressobj(31), bytearray(), None, 0
        while not unpacker.eof:
            held += unpacker.decompress(left, piece)
            left = unpacker.unconsumed_tail or (unpacker.unused_data if unpacker.eof else b"")
            if headers is None and (at := held.find(END)) >= 0:
                if not held.startswith(b"WARC/1."):
                    raise WarcError("a record doesn't begin with its version")
                headers = _headers(bytes(held[:at]))
                del held[: at + 4]
                need = int(headers.get("content-length", -1))
                if need < 0:
                    raise WarcError("a record has no length")
            if headers is not None and len(held) > need + 4:
                raise WarcError("a record is longer than its length says")
            if not left and not unpacker.eof and not (left := stream.read(piece)):
                raise WarcError("an archive ends inside a record")
        if headers is None or len(held) != need + 4 or held[need:] != END:
            raise WarcError("a record isn't as long as its length says")
        record = Record(headers, bytes(held[:need]))
        if headers.get("warc-block-digest", _digest(record.block)) != _digest(record.block):
            raise WarcError("a block's digest doesn't hold")
        if headers["warc-type"] == "response" and headers["warc-payload-digest"] != _digest(record.payload):
            raise WarcError("a payload's digest doesn't hold")
        yield record
        left = left or stream.read(piece)


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, archive: int = ARCHIVE) -> DataFrame:
    """Writes ``pages(page_id, url, html)`` below ``folder``, which must be one that pyarrow can open on every executor.

    Returns one row ``(archive, records)`` per archive, written by then.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"), F.sha2(html, 256).alias("digest"))
    many = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    many = cut(many.where("n > 1 AND first IS NOT NULL").select("digest", "first"))
    rows = joined(rows, many, "digest", "left", many.count())
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        task, number, out, count, size = TaskContext.get(), 0, None, 0, 0
        name = draft = ""

        def close() -> pa.RecordBatch:
            out.close()
            store.move(draft, name)
            return pa.RecordBatch.from_pydict({"archive": [name], "records": [count]}, pa.schema([("archive", pa.string()), ("records", pa.int64())]))

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(k) for k in ("page_id", "url", "payload", "refers_to")), strict=True):
                if out is None:
                    name = f"{path}/part-{task.partitionId():06d}-{number:04d}.warc.gz"
                    draft = f"{name}.{task.taskAttemptId()}.draft"
                    out, count, size, number = store.open_output_stream(draft, compression=None), 0, 0, number + 1
                data = member(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py())
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= archive:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return cut(rows.select("page_id", "url", "payload", refers.alias("refers_to")).mapInArrow(run, "archive string, records long"))


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """A row per record of ``archives(archive)``: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)))
    number = lambda value: int(value.rpartition(":")[2].rstrip(">")) if value else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows = []
                with store.open_input_stream(name, compression=None) as stream:
                    for record in records(stream):
                        h = record.headers
                        rows.append((number(h.get("warc-record-id")), int(record.http["content-length"]), h["warc-payload-digest"].partition(":")[2], h["warc-type"], number(h.get("warc-refers-to"))))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)

    dealt = archives.select("archive").repartition(partitions(archives.sparkSession))
    return dealt.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages' archives to the shared folder, reads them back, and removes them."""
    with scratch(pages.sparkSession, "warc") as folder:
        return cut(read_archives(write_archives(pages, folder), folder))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
