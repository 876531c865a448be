"""WARC archives: a writer of one gzip member per record, and a sequential reader.

The reader inflates members one at a time from fixed-size reads, frames each record by its Content-Length and checks
block and payload digests while the bytes pass by, so a record of any length needs no more memory than a read buffer
(plus its payload, if the caller asks for payloads).

Defined results: a null payload is an empty one; a null URL leaves out WARC-Target-URI; a null page_id is written as
``null``, comes after every other id and reads back as null; rows with the same page_id and payload are all responses if
that id is the smallest of its payload; an empty table gives no archive and no rows; other input columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidscope.workspace import fresh_path, materialize

READ_BYTES = 1 << 18
MANIFEST_SCHEMA = "path string, records long, bytes long"
RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, verified boolean"


class WarcError(ValueError):
    """An archive that breaks the format."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _escaped(url: str) -> str:
    """Control characters can't stand in a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "null" if page_id is None else str(page_id)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_escaped(url)}")
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(record: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def write_archives(
    pages: DataFrame, path: str | None = None, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    least_revisit_bytes: int = 0, file_bytes: int = 1 << 30, date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Write one record per row under ``path`` and return the manifest (path, records, bytes).

    ``path`` is a URI in a store that all executors share and Arrow's file systems open (files, HDFS, S3, GCS).

    Which page of equal payloads is the response is settled by an aggregation on the digest that combines before it
    shuffles; the payload itself moves once.  A task names its files by itself and the manifest lists those of the
    attempts that counted, so files that failed or speculative attempts left behind are never read.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    keyed = rows.withColumn("digest", F.sha1("payload"))
    first = (
        keyed.filter(F.length("payload") >= least_revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and first_id is not null").select("digest", "first_id")
    )
    # Written first: a join straight onto the aggregation would take over its partitioning, which Spark can't split.
    first = materialize(first, "warc-first")
    placed = keyed.join(first, "digest", "left").select("page_id", "url", "payload", "first_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        out, name, records, size, made = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, payload, first_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, records, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(name)
                revisit = first_id is not None and first_id != page_id
                data = _member(_record(page_id, url, payload, first_id if revisit else None, revisit, date))
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= file_bytes:
                    out.close()
                    made.append((name, records, size))
                    out = None
        if out is not None:
            out.close()
            made.append((name, records, size))
        yield pa.RecordBatch.from_pydict({"path": [f"{path}/{m[0].rsplit('/', 1)[1]}" for m in made], "records": [m[1] for m in made], "bytes": [m[2] for m in made]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return materialize(placed.mapInArrow(write, MANIFEST_SCHEMA), "warc-manifest")


def _inflated(stream, read_bytes: int) -> Iterator[Iterator[bytes]]:
    """The members of a gzip stream in turn, each as pieces of its content; a member must be used up before the next."""
    carry = stream.read(read_bytes)
    while carry:
        z = zlib.decompressobj(31)
        state = {"carry": carry}

        def pieces(z=z, state=state) -> Iterator[bytes]:
            data = state["carry"]
            while True:
                try:
                    piece = z.decompress(data, READ_BYTES)
                except zlib.error as e:
                    raise WarcError(f"broken gzip member: {e}") from e
                if piece:
                    yield piece
                if z.eof:
                    state["carry"] = z.unused_data
                    return
                data = z.unconsumed_tail or stream.read(read_bytes)
                if not data:  # what zlib still holds back may end the member
                    if piece := z.flush():
                        yield piece
                    if not z.eof:
                        raise WarcError("the archive ends inside a member")
                    state["carry"] = z.unused_data
                    return

        yield pieces()
        carry = state["carry"] or stream.read(read_bytes)


def _headers(raw: bytes) -> tuple[str, dict[str, str]]:
    first, *rest = raw.decode("utf-8", "replace").split("\r\n")
    found = {}
    for line in rest:
        name, colon, value = line.partition(":")
        if colon:
            found[name.strip().lower()] = value.strip()
    return first, found


def read_records(stream, with_payload: bool = False, read_bytes: int = READ_BYTES) -> Iterator[dict]:
    """Records of one archive in order, from a binary stream that need not be seekable."""
    for member in _inflated(stream, read_bytes):
        head, buffer = None, b""
        for piece in member:
            buffer += piece
            if (end := buffer.find(b"\r\n\r\n")) >= 0:
                head, buffer = buffer[:end], buffer[end + 4 :]
                break
        if head is None:
            raise WarcError("a record without the end of its header")
        version, fields = _headers(head)
        if not version.startswith("WARC/"):
            raise WarcError(f"a record that starts with {version[:20]!r}")
        try:
            left = int(fields["content-length"])
        except (KeyError, ValueError) as e:
            raise WarcError("a record without a Content-Length") from e
        block, payload, http, n_payload, kept = hashlib.sha1(), hashlib.sha1(), b"", 0, []
        http_fields: dict[str, str] | None = None
        source = iter([buffer]) if buffer else iter([])
        tail = b""
        for part in (p for xs in (source, member) for p in xs):
            body, tail = part[:left], tail + part[left:]
            left -= len(body)
            block.update(body)
            if http_fields is None:
                http += body
                if (end := http.find(b"\r\n\r\n")) < 0:
                    continue
                http_fields, body = _headers(http[:end])[1], http[end + 4 :]
            payload.update(body)
            n_payload += len(body)
            if with_payload:
                kept.append(body)
        if left or tail != b"\r\n\r\n":
            raise WarcError("Content-Length and the length of the block differ")
        revisit = fields.get("warc-type") == "revisit"
        stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        ok = fields.get("warc-block-digest", "").removeprefix("sha1:") == base64.b32encode(block.digest()).decode()
        if not revisit:
            ok = ok and stated == base64.b32encode(payload.digest()).decode()
        else:
            n_payload = int((http_fields or {}).get("content-length", 0))
        number = lambda x: int(m[1]) if (m := re.search(r"<urn:page:(-?\d+)>", x or "")) else None
        yield {
            "page_id": number(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "record_type": fields.get("warc-type"), "refers_to": number(fields.get("warc-refers-to")),
            "payload_bytes": n_payload, "payload_digest": stated, "verified": ok,
        } | ({"payload": b"".join(kept)} if with_payload else {})


def read_archives(spark: SparkSession, manifest: DataFrame, *, with_payload: bool = False, strict: bool = True) -> DataFrame:
    """One row per record of the archives in the manifest's ``path`` column, one task per file.

    A record whose digests don't hold raises WarcError, or with ``strict=False`` has ``verified`` false.
    """
    schema = RECORD_SCHEMA + (", payload binary" if with_payload else "")
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("verified", pa.bool_())]
    arrow = pa.schema(fields + [("payload", pa.binary())] * with_payload)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_stream(name) as stream:
                    for record in read_records(stream, with_payload):
                        if strict and not record["verified"]:
                            raise WarcError(f"{path}: the digests of record {record['page_id']} don't hold")
                        rows.append(record)
                        held += len(record.get("payload", b"")) + 200
                        if held > 1 << 23:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(read, schema)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through a WARC archive and back."""
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


QUERIES = {"op1_warc": op1_warc}
ORACLES: dict[str, str] = {}
