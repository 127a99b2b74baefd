"""WARC archives: one gzip member a record, written and read through Spark's own file sources, with salvage of damaged parts.

Writing: Spark's text writer puts out the bytes of each row and then its line separator. The last byte of a gzip member is the
top byte of its length, 0 below 16 MiB, so the separator is that zero byte; a longer record is followed by an empty member.
So archives go to any store that Spark writes to.

Reading: a member, or a plain record, is taken when it inflates, its checksum holds, its header parses, its block is as long as
the header says and the payload digest holds. After a failed check the reader searches for the next place where a gzip member
or a version line begins a valid record, goes on there, and logs the bytes between as a quarantined gap.

Defined results: null payloads count as empty; equal payloads of at least `least_bytes` bytes have one response, the record
with the smallest id, and revisits; rows with the same id are records of their own; a null id is read back as null; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import new_path, text_of, total_bytes

VERSION = b"WARC/1.1"
GZIP = b"\x1f\x8b\x08"
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff0300" + "00" * 8)
DATE = "2020-01-01T00:00:00Z"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
RECORD_SCHEMA = "kind string, file string, offset long, length long, reason string, record_type string, record_id string, target string, refers_to string, payload_bytes long, payload_digest string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, url: str, payload: bytes, refers_to: str | None = None, date: str = DATE) -> bytes:
    """One plain record. A revisit keeps the HTTP header with the full length, but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = [
        VERSION.decode(), f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {re.sub(r'\s', '%20', url)}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(plain: bytes, level: int = 6) -> bytes:
    """A gzip member whose last byte is zero."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = z.compress(plain) + z.flush()
    return out if out[-1] == 0 else out + EMPTY_MEMBER


class Short(ValueError):
    """What is there so far is in order, but the data end within it."""


def parse_plain(data: bytes, at: int) -> tuple[dict, int]:
    """The record that begins at a place, and its end. Raises ValueError with the reason when a check fails."""
    if not _VERSION_LINE.match(data, at):
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", at)
    head = {}
    for line in data[at : len(data) if end < 0 else end].split(b"\r\n")[1 : -1 if end < 0 else None]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("malformed header line")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if end < 0:
        raise Short("header does not end")
    if not head.get("content-length", "").isdecimal() or "warc-type" not in head:
        raise ValueError("no length or type")
    block_end = end + 4 + int(head["content-length"])
    if block_end + 4 > len(data):
        raise Short("block is not as long as stated")
    if data[block_end : block_end + 4] != b"\r\n\r\n":
        raise ValueError("block is not as long as stated")
    block = data[end + 4 : block_end]
    if "warc-block-digest" in head and head["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError("block digest differs")
    rec = {"record_type": head["warc-type"], "record_id": head.get("warc-record-id", "")[1:-1], "target": head.get("warc-target-uri"), "refers_to": head["warc-refers-to"][1:-1] if "warc-refers-to" in head else None}
    http, _, payload = block.partition(b"\r\n\r\n")
    full = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if rec["record_type"] == "response":
        if digest and base32_sha1(payload) != digest:
            raise ValueError("payload digest differs")
        rec |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest or base32_sha1(payload)}
    else:
        rec |= {"payload": None, "payload_bytes": int(full[1]) if full else None, "payload_digest": digest or None}
    return rec, block_end + 4


def parse_at(data: bytes, at: int) -> tuple[list[dict], int]:
    """Records of the member, or the plain record, at a place, and its end. An empty member has none."""
    if data[at : at + 3] != GZIP:
        rec, end = parse_plain(data, at)
        return [rec], end
    z = zlib.decompressobj(31)
    try:
        plain = z.decompress(memoryview(data)[at:])
    except zlib.error as e:
        raise ValueError(f"member: {e}") from None
    if not z.eof:
        raise Short("member is cut off")
    end, recs, p = len(data) - len(z.unused_data), [], 0
    while p < len(plain):
        try:
            rec, p = parse_plain(plain, p)
        except Short as e:  # the member is whole, its record isn't
            raise ValueError(str(e)) from None
        recs.append(rec)
    return recs, end


def salvage(data: bytes, window: int = 1 << 20):
    """Yields ("record", offset, length, record) and ("gap", offset, length, reason); the bytes yielded cover the whole file."""
    at, n = 0, len(data)
    while at < n:
        try:
            recs, end = _parse_windowed(data, at, window)
            for k, r in enumerate(recs):
                yield "record", at, end - at if k == 0 else 0, r
            at = end
            continue
        except ValueError as e:
            why = str(e)
        p = at + 1
        while True:
            m = _START.search(data, p)
            p = m.start() if m else n
            if p >= n:
                break
            try:
                _parse_windowed(data, p, window)
                break
            except ValueError:
                p += 1
        yield "gap", at, p - at, why
        at = p


def _parse_windowed(data: bytes, at: int, window: int) -> tuple[list[dict], int]:
    """Parses from a copy of a window that grows only while a record, in order so far, ends beyond it: the rest of the file isn't copied for each."""
    size = window
    while True:
        try:
            recs, end = parse_at(data[at : at + size], 0)
            return recs, at + end
        except Short:
            if at + size >= len(data):
                raise
            size *= 8


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0, key: str = "page_id", url: str = "url", body: str = "html", per_file: int = 20000, file_bytes: int = 64 << 20) -> None:
    """A record a row, in archives under path; equal payloads (same SHA-256 and length) become revisits of the smallest key.

    A file gets `per_file` records at most, and less where that many payloads of mean size would be more than `file_bytes`."""
    n, nbytes = total_bytes(pages, body)
    per_file = max(1, min(per_file, file_bytes * n // max(nbytes, 1)))
    rows = pages.select(F.col(key).alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"), text_of(body).cast("binary").alias("body"))
    rows = rows.withColumn("sha", F.sha2("body", 256)).withColumn("size", F.octet_length("body"))
    first = rows.groupBy("sha", "size").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("size") >= least_bytes)).select("sha", "first")
    marked = rows.join(first, "sha", "left").select("id", "url", "body", F.when(F.col("first") != F.col("id"), F.col("first")).alias("refers"))

    def make(batches):
        for b in batches:
            out = []
            for i, u, body_, r in zip(*(b.column(c).to_pylist() for c in ("id", "url", "body", "refers")), strict=True):
                kind = "response" if r is None else "revisit"
                out.append(member(record(kind, f"urn:page:{i}", u, body_, None if r is None else f"urn:page:{r}"))[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    members = marked.mapInArrow(make, "member binary").select(F.col("member").cast("string").alias("value"))
    members.write.option("lineSep", "\x00").option("maxRecordsPerFile", per_file).text(path)


def read_archive(pages_session, path: str) -> DataFrame:
    """Records and quarantined gaps of the archives under path; kind is "record" or "gap". One file is held at a time."""
    files = pages_session.read.format("binaryFile").load(path).select("path", "content")

    def scan(batches):
        names = [f.partition(" ")[0] for f in RECORD_SCHEMA.split(", ")]
        for b in batches:
            for file, content in zip(b.column("path"), b.column("content"), strict=True):
                rows: list[tuple] = []
                for kind, at, length, what in salvage(content.as_py()):
                    if kind == "gap":
                        rows.append((kind, file.as_py(), at, length, what, None, None, None, None, None, None))
                    else:
                        rows.append((kind, file.as_py(), at, length, None, *(what[c] for c in names[5:])))
                cols = list(zip(*rows, strict=True)) or [[]] * len(names)
                kinds = [pa.int64() if n in ("offset", "length", "payload_bytes") else pa.string() for n in names]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names)

    return files.mapInArrow(scan, RECORD_SCHEMA)


def round_trip(pages: DataFrame, least_bytes: int = 0, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Writes the archives, reads them back: key, payload_bytes, payload_digest, record_type, refers_to of each record.

    A gap in archives that were just written is an error, which fails the query; read_archive returns gaps as rows."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archive(pages, path, least_bytes, key, url, body)
    kind = pages.select(key).schema[0].dataType
    ids = lambda c: F.nullif(F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1), F.lit("")).cast(kind)
    gap = F.raise_error(F.concat(F.lit("quarantined bytes in "), "file", F.lit(" at "), "offset", F.lit(": "), F.coalesce("reason", F.lit(""))))
    recs = read_archive(spark, path).where(F.when(F.col("kind") == "record", True).otherwise(gap.cast("boolean")))
    return recs.select(ids(F.col("record_id")).alias(key), "payload_bytes", "payload_digest", "record_type", F.when(F.col("refers_to").isNotNull(), ids(F.col("refers_to"))).alias("refers_to"))
