"""WARC archives: one gzip member per record, written by Spark and read back record by record.

Archives are written through Spark's text writer, whose commit protocol keeps them whole when executors are lost. It
writes a separator after each value; the separator is an empty gzip member, so a file is a valid run of members. Each
archive has a bounded size, as Spark gives a reader one archive at a time; the reader inflates and frames it record by
record.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm.common import pieces, scratch

#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
#: Written together: bytes of records, and so many of these an archive. A record is never split.
GROUP, GROUPS = 1 << 18, 8
#: Bytes given to zlib at a time.
CHUNK = 1 << 16
EMPTY_MEMBER = bytes.fromhex("1f8b080000000000000303000000000000000000")


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit that names the page it repeats; both carry the payload's digest and length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return member("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def members(data: bytes) -> Iterator[tuple[bytes, bool]]:
    """The content of each gzip member that has any, decompressed in chunks, and whether it is whole. After a broken member it searches for the next."""
    at = 0
    view = memoryview(data)
    while at < len(data):
        z, out, start, broken = zlib.decompressobj(31), [], at, False
        while at < len(data) and not z.eof:
            chunk = view[at : at + CHUNK]
            try:
                out.append(z.decompress(chunk))
            except zlib.error:
                broken = True
                break
            at += len(chunk) - len(z.unused_data)
        if not z.eof:
            yield b"".join(out), False
            found = data.find(b"\x1f\x8b\x08", start + 1)
            at = len(data) if found < 0 else found
        elif any(out):
            yield b"".join(out), True


@dataclass
class Record:
    """A record as read. intact: framing and digests hold."""

    headers: dict[str, str] = field(default_factory=dict)
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    intact: bool = False


def _lines(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode("utf-8", "replace").split("\r\n")[1:]) if k}


def read_record(data: bytes, whole: bool) -> Record:
    head, gap, rest = data.partition(b"\r\n\r\n")
    r = Record(_lines(head))
    size = r.headers.get("content-length", "")
    n = int(size) if size.isdigit() else len(rest)
    block = rest[:n]
    http, split, r.payload = block.partition(b"\r\n\r\n")
    r.http = _lines(http)
    sha = lambda x: "sha1:" + hashlib.sha1(x).hexdigest()
    r.intact = bool(whole and head.startswith(b"WARC/1.") and gap and size.isdigit() and rest[n:] == b"\r\n\r\n" and split and r.headers.get("warc-block-digest") == sha(block))
    if r.headers.get("warc-type") == "response":
        r.intact &= r.headers.get("warc-payload-digest") == sha(r.payload) and r.http.get("content-length") == str(len(r.payload))
    return r


def _page(urn: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn)
    return int(m[1]) if m else None


def write_archives(pages: DataFrame, path: str, group: int = GROUP, groups: int = GROUPS) -> None:
    """Writes a record per row of pages (page_id, url, html) to archives below `path`, of about group * groups bytes at most.

    Of rows with equal payloads of REVISIT_BYTES or more, those with the largest page_id are responses, the others
    revisit it; rows with the same page_id and payload are both responses. Null html: an empty payload. Null page_id or
    url: the record has none. An empty table gives no records. Other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = F.octet_length("html") >= REVISIT_BYTES
    last = rows.filter(large).groupBy(F.col("digest").alias("d")).agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(last, F.col("digest") == F.col("d"), "left").withColumn("refers_to", F.when(F.coalesce(F.col("page_id") < F.col("last"), F.col("last").isNotNull() & F.col("page_id").isNull()), F.col("last")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = lambda held: pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])
        held, size = [], 0
        for batch in batches:
            for part in pieces(batch, "html"):
                for i, u, h, d, r in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                    held.append(record(i, u, h.encode(), d, r))
                    size += len(held[-1])
                    if size >= group:
                        yield value(held)
                        held, size = [], 0
        if held:
            yield value(held)

    out = rows.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "value binary")
    out.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", groups).option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean, payload binary"


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives below `path`; payload is null for revisits, and everywhere if not asked for. A damaged record has intact false and what could be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_()), ("payload", pa.binary())])
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for data, whole in members(content.as_buffer().to_pybytes() if hasattr(content, "as_buffer") else content.as_py()):
                    r = read_record(data, whole)
                    kind, size = r.headers.get("warc-type"), r.http.get("content-length", "")
                    rows.append((_page(r.headers.get("warc-record-id", "")), r.headers.get("warc-target-uri"), len(r.payload) if kind == "response" else int(size) if size.isdigit() else None, r.headers.get("warc-payload-digest", "").removeprefix("sha1:") or None, kind, _page(r.headers.get("warc-refers-to", "")), r.intact, r.payload if payload and kind == "response" else None))
                    if len(rows) == 64:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, READ_SCHEMA)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Writes the pages below the shared folder and reads them back."""
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path, payload=False)
