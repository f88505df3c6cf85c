"""WARC archives: one gzip member per record, written by tasks and read back sequentially.

The reader goes through an archive once: it inflates member after member piece by piece, frames each
record by its Content-Length, and verifies block and payload digests while the bytes pass.
A broken or cut member raises ValueError with the archive's name.

Archives are written through pyarrow's file systems into a folder that driver and executors share.
A task writes under a name of its own and renames when it is done, so a task that runs again leaves
no half-written archive; an archive is closed after ROLL bytes, so none grows with the input.

Null html is the empty payload. Of rows with equal payloads of at least min_bytes bytes, those with
the smallest page_id (all of them, if it stands on several) are responses and all others revisit it; rows without a page_id are
responses and are never referred to. Null urls count as empty. An empty table gives no archive and no rows; columns
beside page_id, url and html are not looked at. Payloads of any length pass in pieces when read; a record is held whole when written.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.common import materialise, shared_dir

ROLL = 64 << 20
PIECE = 1 << 18
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One record, response or revisit, before compression."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or '').encode('unicode_escape').decode()}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[2:2] = [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _members(stream, name: str):
    """An iterator of inflated pieces for each gzip member of a stream; each must be read to its end."""
    held = b""

    while True:
        if not held and not (held := stream.read(PIECE)):
            return
        inflate = zlib.decompressobj(31)

        def pieces():
            nonlocal held
            while not inflate.eof:
                if not held and not (held := stream.read(PIECE)):
                    raise ValueError(f"{name}: the last member is cut")
                try:
                    piece = inflate.decompress(held, PIECE)
                except zlib.error as error:
                    raise ValueError(f"{name}: {error}") from error
                held = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
                if piece:
                    yield piece

        yield pieces()


def read_records(stream, name: str = "archive", with_payload: bool = False):
    """(headers, payload length, payload or None) of each record of a stream of gzip members, in order.

    The payload's length is that of the HTTP message, also for revisits, which don't hold it.
    """
    for pieces in _members(stream, name):
        buffer = b""
        for piece in pieces:
            buffer += piece
            if b"\r\n\r\n" in buffer:
                break
        head, found, rest = buffer.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not found or not lines[0].startswith("WARC/"):
            raise ValueError(f"{name}: no record header")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        left = int(headers["Content-Length"])
        block, payload, http, body, tail = hashlib.sha1(), hashlib.sha1(), b"", [], b""
        in_body, size = False, 0

        def take(data: bytes):
            nonlocal http, in_body, size
            if not in_body:
                http += data
                if b"\r\n\r\n" not in http:
                    return
                http, _, data = http.partition(b"\r\n\r\n")
                in_body = True
            payload.update(data)
            size += len(data)
            if with_payload:
                body.append(data)

        def feed(data: bytes):
            nonlocal left, tail
            own, after = data[:left], data[left:]
            left -= len(own)
            tail += after
            block.update(own)
            take(own)

        feed(rest)
        for piece in pieces:
            feed(piece)
        if left or tail != b"\r\n\r\n":
            raise ValueError(f"{name}: a record doesn't fit its Content-Length")
        if headers["WARC-Block-Digest"] != "sha1:" + base64.b32encode(block.digest()).decode():
            raise ValueError(f"{name}: block digest of {headers['WARC-Record-ID']}")
        if headers["WARC-Type"] == "response" and headers["WARC-Payload-Digest"] != "sha1:" + base64.b32encode(payload.digest()).decode():
            raise ValueError(f"{name}: payload digest of {headers['WARC-Record-ID']}")
        said = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
        yield headers, int(said["Content-Length"]), b"".join(body) if with_payload and headers["WARC-Type"] == "response" else None


def assign(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, digest, refers_to): which rows are revisits, and of what page.

    The smallest ids are found with partial aggregation; only payloads that occur twice are looked up, by narrow rows of ids and
    digests. What is met with the html are revisits by id and digest, so many copies of one payload are no hot key.
    """
    rows = pages.select(pages["page_id"].cast("bigint").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"], F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    firsts = rows.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = materialise(firsts.where("n > 1 AND first IS NOT NULL").select("digest", "first"), "firsts")
    again = rows.select("page_id", "digest").join(firsts, "digest").where("page_id <> first")
    again = materialise(again.select("page_id", "digest", F.col("first").alias("refers_to")).distinct(), "revisits")
    return rows.join(again, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")


def write(records: DataFrame, folder: str) -> DataFrame:
    """Write assign()'s rows as archives into folder; (path, records) of each archive, as a written table."""

    def run(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        name, out, count, size = None, None, 0, 0

        def close():
            out.close()
            system.move(f"{root}/{name}.part", f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([count], pa.int64())], names=["path", "records"])

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{root}/{name}.part", compression=None)
                raw = html.encode()
                member = gzip_member(record(page_id, url, raw, base64.b32encode(bytes.fromhex(digest)).decode(), refers_to))
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= ROLL:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    made = records.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "path string, records bigint")
    return materialise(made, "archives")


def read(spark: SparkSession, archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of archives(path): page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload."""

    def run(batches):
        from pyarrow import fs

        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def number(urn):
            digits = urn.removeprefix("<urn:page:").removesuffix(">")
            return int(digits) if digits else None

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(path)
                with system.open_input_stream(at, compression=None, buffer_size=PIECE) as stream:
                    part, held = [], 0
                    for headers, size, payload in read_records(stream, path, with_payload):
                        refers_to = headers.get("WARC-Refers-To")
                        url = headers["WARC-Target-URI"].encode().decode("unicode_escape")
                        row = (number(headers["WARC-Record-ID"]), url, size, headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"], refers_to and number(refers_to))
                        part.append((*row, payload)[: len(names)])
                        held += len(payload or b"")
                        if len(part) >= 4096 or held >= 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names=names)
                            part, held = [], 0
                    if part:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names=names)

    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path").repartition(n).mapInArrow(run, schema + ", payload binary" * with_payload)


def round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write pages as archives, and what a sequential read of them returns."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex[:12]}"
    return read(spark, write(assign(pages, min_bytes), folder))


#: The same result in DuckDB: five hexadecimal digits of the SHA-1 are four base32 letters.
ROUND_TRIP_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT page_id, octet_length(encode(p.html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) % 32 + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f ON p.html = f.html
"""
