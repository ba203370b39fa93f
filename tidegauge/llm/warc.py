"""WARC archives: one gzip member per record, and a sequential reader.

Spark writes the archives, so they can be on any file system it knows and a repeated task leaves no half file.
Its text writer ends each row with a separator; here that is the zero byte with which every gzip
member of less than 16 MB ends, so rows are members without their last byte. Larger records are segmented
into continuation records, as the format allows.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tidegauge.llm.texts import bound_batches, record_batch, written
from tidegauge.runtime import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Block bytes of one segment; a member must stay below 16 MB.
SEGMENT = 8 * 1024 * 1024
# Bytes of html that one archive holds on average.
ARCHIVE = 32 * 1024 * 1024
_SLICE = 64 * 1024


def sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _gzip(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in [*headers, ("Content-Length", str(len(block)))])]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _flat(value: str | None) -> str:
    """A header value on one line."""
    return " ".join((value or "").split())


def members(row: dict) -> Iterator[bytes]:
    """Gzip members of a row: its response or revisit record, and continuations of a long one."""
    payload, urn = row["payload"], f"<urn:row:{row['row_id']}>"
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    revisit = row["row_id"] != row["first_row"]
    block = http if revisit else http + payload
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", urn),
               ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", _flat(row["url"])),
               ("WARC-Payload-Digest", f"sha1:{row['digest']}"), ("Page-ID", "" if row["page_id"] is None else str(row["page_id"]))]
    if revisit:
        headers += [("WARC-Refers-To", f"<urn:row:{row['first_row']}>"),
                    ("Refers-To-Page-ID", "" if row["first_page"] is None else str(row["first_page"])),
                    ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    headers.append(("Content-Type", "application/http; msgtype=response"))
    parts = [block[at:at + SEGMENT] for at in range(0, len(block), SEGMENT)]
    if len(parts) > 1:
        headers.append(("WARC-Segment-Number", "1"))
    yield _gzip(_record([*headers, ("WARC-Block-Digest", f"sha1:{sha1(parts[0])}")], parts[0]))
    for number, part in enumerate(parts[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:row:{row['row_id']}:{number}>"),
                ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", urn),
                ("WARC-Segment-Number", str(number)), ("WARC-Block-Digest", f"sha1:{sha1(part)}")]
        if number == len(parts):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _gzip(_record(more, part))


def inflated(raw: bytes | memoryview) -> Iterator[bytes]:
    """Uncompressed bytes of each gzip member, decompressed in slices."""
    view, at = memoryview(raw), 0
    while at < len(view):
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if at >= len(view):
                raise ValueError("the archive ends inside a member")
            piece = view[at:at + _SLICE]
            parts.append(unpacker.decompress(piece))
            at += len(piece) - len(unpacker.unused_data)
        yield b"".join(parts)


def framed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block that Content-Length delimits."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("a member does not start with a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = int(headers["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the block does not end where Content-Length says")
    block = rest[:size]
    if headers.get("warc-block-digest", f"sha1:{sha1(block)}") != f"sha1:{sha1(block)}":
        raise ValueError(f"wrong block digest of {headers.get('warc-record-id')}")
    return headers, block


def records(raw: bytes | memoryview) -> Iterator[dict]:
    """Records of an archive in order, segments joined and payload digests verified."""
    pending = None
    for member in inflated(raw):
        headers, block = framed(member)
        if headers["warc-type"] == "continuation":
            if pending is None or headers["warc-segment-origin-id"] != pending[0]["warc-record-id"]:
                raise ValueError("a continuation does not follow its record")
            pending[1].append(block)
            if "warc-segment-total-length" not in headers:
                continue
            (headers, blocks), pending = pending, None
            block = b"".join(blocks)
        elif "warc-segment-number" in headers:
            pending = headers, [block]
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        lengths = [line.split(b":")[1] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        digest = headers["warc-payload-digest"].removeprefix("sha1:")
        if headers["warc-type"] == "response" and (len(payload) != int(lengths[0]) or sha1(payload) != digest):
            raise ValueError(f"wrong payload digest of {headers['warc-record-id']}")
        yield {"headers": headers, "payload": payload, "payload_bytes": int(lengths[0]), "digest": digest}
    if pending is not None:
        raise ValueError("a segmented record has no end")


def write_archives(pages: DataFrame, path: str, least: int = 0, key: str = "page_id", url: str = "url",
                   html: str = "html") -> None:
    """Write a record per row to gzipped archives below `path`.

    A null html is empty. Of rows with equal payloads of at least `least` bytes the one with the smallest key is
    a response, others revisit it; of rows with equal keys and payloads one is the response; null keys are the
    largest. Smaller payloads are all responses.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    rows = written(pages.select(
        F.col(key).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8").alias("payload"),
        F.monotonically_increasing_id().alias("row_id")).withColumns(
        {"sha": F.sha1("payload"), "size": F.octet_length("payload")}), "pages")
    order = F.struct(F.col("page_id").isNull().alias("no"), "page_id", "row_id")
    firsts = (rows.filter(F.col("size") >= least).groupBy("sha").agg(
        F.min(order).alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
        .select("sha", F.col("first.page_id").alias("first_page"), F.col("first.row_id").alias("first_row")))
    mean = rows.agg(F.avg("size")).first()[0] or 0
    linked = rows.join(firsts, "sha", "left").withColumn(
        "first_row", F.when(F.col("size") >= least, F.col("first_row"))).select(
        "page_id", "url", "payload", "row_id", F.coalesce("first_row", "row_id").alias("first_row"), "first_page",
        F.unhex("sha").alias("sha"))
    schema = pa.schema([("member", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                row["digest"] = base64.b32encode(row["sha"]).decode()
                packed = list(members(row))
                if any(member[-1] for member in packed):
                    raise ValueError("a member does not end with a zero byte")
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(packed)[:-1]], pa.binary())], schema=schema)

    # A row holds all members of its record, so segments stay together wherever a file ends.
    (linked.mapInArrow(pack, from_arrow_schema(schema)).select(F.col("member").cast("string").alias("value"))
     .write.option("lineSep", "\0").option("compression", "none")
     .option("maxRecordsPerFile", int(ARCHIVE // (mean + 1)) + 1).text(path))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives below `path`, in any order: key, url, type, payload size, digest, payload, what it refers to."""
    bound_batches(spark)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
                        ("refers_to", pa.int64())])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                rows = []
                for record in records(memoryview(raw.as_buffer())):
                    headers = record["headers"]
                    number = [int(v) if (v := headers.get(n)) else None for n in ("page-id", "refers-to-page-id")]
                    rows.append((number[0], headers["warc-target-uri"], headers["warc-type"], record["payload_bytes"],
                                 record["digest"], record["payload"], number[1]))
                    if len(rows) == 256:
                        yield record_batch(rows, schema)
                        rows = []
                yield record_batch(rows, schema)

    # Empty partitions leave empty files.
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("content")
    return files.mapInArrow(unpack, from_arrow_schema(schema))


def archived(pages: DataFrame, path: str | None = None, least: int = 0) -> DataFrame:
    """Write archives, read them back, and return the records without url and payload."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "archives")
    write_archives(pages, path, least)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
