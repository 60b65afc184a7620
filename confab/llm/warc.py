"""WARC archives: one gzip member per record, written and read back as a stream.

Equal payloads are found by digest before writing: the row with the largest id is a response, the
others are revisits that refer to it and carry no payload. The reader decompresses member after
member incrementally, frames records by Content-Length and verifies payload digests.
Archives lie in a folder that driver and executors share; a task that is run again writes new files,
and only files of tasks that ended well are in the manifest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confab.llm.common import table, written
from confab.sources.storage import scratch_path

MIN_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
_READ = 1 << 20
_DATE = "2000-01-01T00:00:00Z"
_MANIFEST = "path string, records long, bytes long"
_RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
_RECORDS_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


class WarcError(ValueError):
    """An archive that isn't framed as said or whose digest differs."""


def _fs(path: str):
    return pafs.FileSystem.from_uri(path)


def _line(value) -> str:
    """A header value: line ends and other control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record_bytes(page_id, url, payload: bytes, refers_to) -> bytes:
    """One gzip member holding a response, or a revisit of ``refers_to`` where that isn't None."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = http if revisit else http + payload
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode().split("\r\n")[1:])}


def members(stream) -> Iterator[Iterator[bytes]]:
    """Each gzip member of ``stream`` as an iterator of decompressed pieces, which must be used up."""
    rest = stream.read(_READ)
    while rest:
        z = zlib.decompressobj(31)

        def pieces(data=rest, z=z):
            nonlocal rest
            while True:
                got = z.decompress(data, _READ)
                if got:
                    yield got
                if z.eof:
                    rest = z.unused_data or stream.read(_READ)
                    return
                data = z.unconsumed_tail or stream.read(_READ)
                if not data:
                    raise WarcError("a gzip member ends early")

        yield pieces()


def read_records(stream) -> Iterator[dict]:
    """Records of an archive in order; raises WarcError on wrong framing or a wrong digest."""
    for pieces in members(stream):
        buf = bytearray()
        while (at := buf.find(b"\r\n\r\n")) < 0:
            piece = next(pieces, None)
            if piece is None:
                raise WarcError("a record has no end of headers")
            buf += piece
        if not buf.startswith(b"WARC/"):
            raise WarcError("not a WARC record")
        head = _headers(bytes(buf[:at]))
        del buf[: at + 4]
        for piece in pieces:
            buf += piece
        length = int(head["content-length"])
        if len(buf) != length + 4 or buf[length:] != b"\r\n\r\n":
            raise WarcError("content length and member differ")
        http, _, payload = bytes(buf[:length]).partition(b"\r\n\r\n")
        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:"))
        size = int(_headers(http)["content-length"])
        kind = head["warc-type"]
        if kind == "response" and (len(payload) != size or hashlib.sha1(payload).digest() != digest):
            raise WarcError("a payload's digest or length differs")
        number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
        yield {"page_id": number(head["warc-record-id"]), "url": head.get("warc-target-uri"), "record_type": kind, "payload_bytes": size, "payload_digest": digest.hex(), "refers_to": number(head.get("warc-refers-to")), "payload": payload if kind == "response" else None}


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) below ``folder``; gives the manifest (path, records, bytes).

    A null html is empty. Of equal payloads of ``MIN_REVISIT_BYTES`` or more, rows with the largest id
    are responses and rows with another (or no) id revisit it. Repeated rows are separate records.
    """
    own = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("same", F.when(F.octet_length("payload") >= MIN_REVISIT_BYTES, F.unhex(F.sha2("payload", 256))))
    facts = own.filter("same is not null").select("page_id", "same")
    tops = facts.groupBy("same").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = facts.join(tops, "same").filter(~F.col("page_id").eqNullSafe(F.col("top"))).distinct()
    again = written(again.select(F.col("page_id").alias("_id"), F.col("same").alias("_same"), "top"), "revisits")
    rows = own.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("same") == F.col("_same")), "left").select("page_id", "url", "payload", "top")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _fs(folder)
        files.create_dir(base, recursive=True)
        out, found, count = None, [], 0

        def close():
            nonlocal out, count
            if out is not None:
                found.append((name, count, out.tell()))
                out.close()
            out, count = None, 0

        for batch in batches:
            for page_id, url, payload, top in zip(*(batch.column(i) for i in range(4)), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = files.open_output_stream(f"{base}/{name}")
                out.write(record_bytes(page_id.as_py(), url.as_py(), payload.as_py(), top.as_py()))
                count += 1
                if out.tell() >= archive_bytes:
                    close()
        close()
        if found:
            names, counts, sizes = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x}" for x in names]), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["path", "records", "bytes"])

    return written(rows.mapInArrow(write, _MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = True, batch_bytes: int = 16 << 20) -> DataFrame:
    """Records of the archives of ``manifest`` (path), a task per some files; without ``payloads`` that column is null."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, name = _fs(path)
                with files.open_input_stream(name) as stream:
                    for record in read_records(stream):
                        held += record["payload_bytes"] + 200 if payloads else 200
                        rows.append(record if payloads else record | {"payload": None})
                        if held >= batch_bytes:
                            yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS_ARROW)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS_ARROW)

    files = manifest.select("path")
    return files.repartition(max(1, min(10_000, files.count())), "path").mapInArrow(read, _RECORDS)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``pages`` written as archives and read back; cases as in ``write_archives``, an empty table gives no rows."""
    folder = scratch_path(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), q AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS top FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM q
"""
