"""WARC archives: written with an index, read back by byte ranges.

Writing. Each task writes one archive of gzip members, a member per record, into the shared folder and returns the index row
of every record: file, offset, length, URL, digest. The file name is new for each attempt, and only rows of finished attempts
reach the index, so a task that runs again leaves an unused file behind but never a wrong entry.

Reading. The wanted index rows are sorted by file and offset; records in the same ``RANGE_BYTES`` stretch of a file become one
range, which one read fetches; members are cut out of it and parsed.

A page whose payload a larger page id also has is written as a ``revisit`` of that page's record, without the payload. The
largest id per payload comes from a map-side-reduced aggregate; only payloads that occur twice are joined back.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, through_table
from .common import arrow_pass, read_table, ship_package

RANGE_BYTES = 4 << 20
#: Bytes that one task reads, about.
TASK_BYTES = 16 << 20
#: Payloads of at least so many bytes are written once.
LEAST_BYTES = 0
#: Up to so many repeated payloads travel to every task; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Uncompressed bytes after which a task starts another archive.
ARCHIVE_BYTES = 256 << 20
INDEX = "file string, offset long, length long, url string, payload_digest string, page_id long, record_type string"


def open_store(url: str):
    """(file system, path) of a folder in any store that Arrow knows."""
    from pyarrow import fs

    if "://" not in url and not url.startswith("file:"):
        return fs.LocalFileSystem(), url
    if re.match(r"file:/+", url):
        return fs.LocalFileSystem(), "/" + re.sub(r"^file:/+", "", url)
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", url))


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:x-page:{page_id}>"


def build_record(page_id, url: str | None, payload: bytes, refers_to) -> tuple[bytes, str]:
    """One WARC record and its payload digest. ``refers_to``: page id of the response that has the payload, or None."""
    digest = sha1_base32(payload)
    target = quote(url, safe=":/?#[]@!$&'()*+,;=%~-._") if url else f"urn:x-page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    kind = "revisit" if refers_to is not None else "response"
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id if page_id is not None else uuid.uuid4())}", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", digest


def parse_record(record: bytes) -> dict:
    """Headers (lower case), HTTP headers and payload of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = dict(re.findall(r"^([^:\r\n]+): *([^\r\n]*)", head.decode(), re.M))
    headers = {k.lower(): v for k, v in headers.items()}
    body = rest[: int(headers["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    full = int(re.search(rb"(?im)^content-length: *(\d+)", http)[1])
    return {"headers": headers, "payload": payload, "full_bytes": full}


def mark_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, html, refers_to). A page refers to the largest page id with its payload, if that is not its own."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = rows.withColumn("payload_key", F.sha1(F.col("html").cast("binary")))
    large = keyed.filter(F.octet_length("html") >= least_bytes)
    repeated = large.groupBy("payload_key").agg(F.max("page_id").alias("last_id"), F.count("*").alias("n")).filter("n > 1 and last_id is not null")
    repeated = through_table(repeated.select("payload_key", "last_id"), "repeated")
    side = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated
    joined = keyed.join(side, "payload_key", "left")
    refers = F.when((F.col("last_id") > F.col("page_id")) & (F.octet_length("html") >= least_bytes), F.col("last_id"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html, refers_to) as .warc.gz files into ``folder``; the stored index of all records."""
    ship_package(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        out = name = None
        for batch in batches:
            rows = []
            for page, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is None or offset > ARCHIVE_BYTES:
                    if out:
                        out.close()
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                record, digest = build_record(page, url, html.encode(), refers)
                member = gzip.compress(record, 3, mtime=0)
                out.write(member)
                rows.append((name, offset, len(member), url, digest, page, "revisit" if refers is not None else "response"))
                offset += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), index_types, strict=True)], names=names)
        if out:
            out.close()

    names = [c.split()[0] for c in INDEX.split(", ")]
    index_types = [{"string": pa.string(), "long": pa.int64()}[c.split()[1]] for c in INDEX.split(", ")]
    return through_table(pages.mapInArrow(write, INDEX), "index")


def read_records(index: DataFrame, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of the records in ``index``.

    Records are grouped by file and stretch of ``range_bytes``; one read covers a group from its first to its last byte.
    """
    ranges = (
        index.groupBy("file", F.floor(F.col("offset") / range_bytes).alias("stretch"))
        .agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"), F.array_sort(F.collect_list(F.struct("offset", "length", "page_id", "url"))).alias("records"))
        .select("file", "start", "end", "records")
    )
    # a range is a small row that stands for a large read: tasks are dealt by the bytes to read
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    ranges = ranges.repartition(max(1, -(-total // TASK_BYTES)), "file", "start")

    def read(files, starts, ends, groups):
        store, base = open_store(folder)
        for file, start, end, records in zip(files, starts, ends, groups, strict=True):
            with store.open_input_file(f"{base}/{file}") as archive:
                data = archive.read_at(end - start, start)
            for r in records:
                found = parse_record(gzip.decompress(data[r["offset"] - start : r["offset"] - start + r["length"]]))
                headers, payload = found["headers"], found["payload"]
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                refers = headers.get("warc-refers-to")
                if refers is None and sha1_base32(payload) != digest:
                    raise ValueError(f"payload of {headers['warc-record-id']} in {file} does not have its digest")
                source = int(refers.removeprefix("<urn:x-page:").rstrip(">")) if refers else None
                yield r["page_id"], r["url"], found["full_bytes"], digest, headers["warc-type"], source, payload if refers is None else None

    return arrow_pass(ranges, read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_pages(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> tuple[DataFrame, str]:
    """Write ``pages`` (page_id, url, html and any other columns) to a new folder: (index, folder).

    A null html is empty. A null url becomes a URN of the page. A null page id is always a response and is never referred to.
    Rows that repeat a page id with the same payload are all written as the largest id's rows are. An empty table writes
    no file.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    return write_archives(mark_revisits(pages, least_bytes), folder), folder


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = archive_pages(read_table(spark, sf_dir, "pages"))
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op6_warc": op6_warc}
ORACLE_SQL: dict[str, str] = {}
