"""WARC archives: writing, reading and transaction assembly (operator 5).

``write_archives`` turns every page into a request, a response (or revisit) and a metadata record
and writes them with Spark's text sink: a WARC file is a run of ``header CRLF block CRLF CRLF``, so a
record is one value and the line end is two CRLF.  The sink's commit protocol covers lost executors,
and archives land in any file system Spark can write to.

``read_records`` reads archives of any origin (plain or gzip, one or many members) by
content length, one task per group of files.  ``assemble`` joins the records of a transaction through
their concurrent-to identifiers, whichever side names the other, and gives one nested row per
capture; orphans stay as captures without a response.

Defined results: null HTML is an empty payload; null page ids are kept; of equal payloads, rows with
the smallest id are responses and the rest revisit them, rows that repeat an id with the same payload
included; exactly repeated rows come back as often as they were written; an empty table gives empty
archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.llm.common import checked_broadcast
from lexiframe.session import checkpointed

CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # RFC 4648
RECORDS_PER_FILE = 6000


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a text's UTF-8 bytes as 32 base32 letters: four for every five hex digits."""
    digest = F.sha1(payload.cast("binary"))
    letters = []
    for start in range(1, 41, 5):
        value = F.conv(F.substring(digest, start, 5), 16, 10).cast("int")
        letters += [
            F.substring(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1))
            for shift in (15, 10, 5, 0)
        ]
    return F.concat(*letters)


def record_id(kind: str, page_id: Column, salt: Column) -> Column:
    """Name of a record: kind and a salt in the first half, the page id in the second."""
    check = F.md5(F.concat(F.lit(kind), F.lit("/"), salt).cast("binary"))
    page = F.lower(F.lpad(F.hex(F.coalesce(page_id, F.lit(0)).cast("bigint")), 16, "0"))
    known = F.when(page_id.isNull(), "9").otherwise("8")
    return F.concat(
        F.lit("<urn:uuid:"), F.substring(check, 1, 8), F.lit("-"), F.substring(check, 9, 4), F.lit("-"),
        known, F.substring(check, 13, 3), F.lit("-"), F.substring(page, 1, 4), F.lit("-"),
        F.substring(page, 5, 12), F.lit(">"),
    )


def page_of(record: Column) -> Column:
    """Page id in a name made by ``record_id``; null for unknown pages and other names."""
    found = r"^<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-8[0-9a-f]{3}-([0-9a-f]{4})-([0-9a-f]{12})>$"
    digits = F.concat(F.regexp_extract(record, found, 1), F.regexp_extract(record, found, 2))
    return F.when(digits != "", F.conv(digits, 16, -10).cast("bigint"))


def _record(headers: list[Column], block: Column) -> Column:
    """A record without the two line ends that close it; null headers are left out."""
    return F.concat(
        F.concat_ws(CRLF, F.lit("WARC/1.1"), *headers),
        F.lit(CRLF + "Content-Length: "), F.octet_length(block).cast("string"),
        F.lit(CRLF + CRLF), block,
    )


def _header(name: str, value: Column | str) -> Column:
    value = F.lit(value) if isinstance(value, str) else value
    return F.concat(F.lit(f"{name}: "), value)


def write_archives(
    pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z"
) -> None:
    """Write ``pages(page_id, url, html)`` as gzip WARC files below ``path``.

    Payloads of at least ``min_bytes`` that are equal are stored once.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    url = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), F.lit("about:blank"))
    rows = pages.select(
        "page_id",
        url.alias("url"),
        html.alias("html"),
        F.octet_length(html).cast("bigint").alias("bytes"),
        base32_sha1(html).alias("digest"),
    ).withColumn("salt", F.concat_ws("/", "page_id", "url", "digest"))
    first = F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "salt")
    again = checkpointed(
        rows.where(F.col("bytes") >= min_bytes)
        .groupBy(F.col("digest").alias("same"), F.col("bytes").alias("long"))
        .agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n"),
        "payloads",
    )
    rows = rows.join(
        checked_broadcast(again), (F.col("digest") == F.col("same")) & (F.col("bytes") == F.col("long")), "left"
    ).withColumn(
        "revisit",
        F.col("same").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id")),
    )
    me = record_id("response", F.col("page_id"), F.col("salt"))
    common = [_header("WARC-Date", date), _header("WARC-Target-URI", F.col("url"))]
    digest = _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("bytes").cast("string"), F.lit(CRLF + CRLF),
    )
    capture = _record(
        [
            _header("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
            _header("WARC-Record-ID", me),
            *common,
            digest,
            F.when(
                F.col("revisit"),
                _header("WARC-Refers-To", record_id("response", F.col("first.page_id"), F.col("first.salt"))),
            ),
            F.when(
                F.col("revisit"),
                _header("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ),
            _header("Content-Type", "application/http;msgtype=response"),
        ],
        F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("html"))),
    )
    request = _record(
        [
            _header("WARC-Type", "request"),
            _header("WARC-Record-ID", record_id("request", F.col("page_id"), F.col("salt"))),
            _header("WARC-Concurrent-To", me),
            *common,
            _header("Content-Type", "application/http;msgtype=request"),
        ],
        F.concat(
            F.lit("GET "), F.regexp_replace("url", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""),
            F.lit(f" HTTP/1.1{CRLF}Host: "), F.regexp_extract("url", "://([^/?#]*)", 1), F.lit(CRLF + CRLF),
        ),
    )
    metadata = _record(
        [
            _header("WARC-Type", "metadata"),
            _header("WARC-Record-ID", record_id("metadata", F.col("page_id"), F.col("salt"))),
            _header("WARC-Concurrent-To", me),
            *common,
            _header("Content-Type", "application/warc-fields"),
        ],
        F.concat(
            F.coalesce(F.concat(F.lit("pageId: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit("")),
            F.lit("payloadBytes: "), F.col("bytes").cast("string"), F.lit(CRLF),
        ),
    )
    (
        rows.select(F.explode(F.array(request, capture, metadata)).alias("value"))
        .write.option("lineSep", CRLF + CRLF)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(path)
    )


RECORD_TYPE = (
    "record_id string, type string, concurrent_to string, refers_to string, target_uri string,"
    " date string, digest string, payload_bytes bigint, payload binary, fields map<string,string>"
)
_SCHEMA = pa.schema(
    [
        *((n, pa.string()) for n in ("record_id", "type", "concurrent_to", "refers_to", "target_uri", "date", "digest")),
        ("payload_bytes", pa.int64()),
        ("payload", pa.binary()),
        ("fields", pa.map_(pa.string(), pa.string())),
    ]
)


def _unpacked(data: bytes) -> bytes:
    """Content of an archive: plain, or gzip of any number of members."""
    parts = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        parts.append(member.decompress(data) + member.flush())
        data = member.unused_data
    parts.append(data)
    return b"".join(parts)


def _headers(head: bytes) -> dict[str, str]:
    lines = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in lines if name.strip()}


def _records(data: bytes, keep_payload: bool):
    """Records of an unpacked archive, found by their content length."""
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        head = _headers(data[at:end])
        start = end + 4
        at = start + int(head.get("content-length", 0))
        block, kind, fields = data[start:at], head.get("warc-type", ""), {}
        payload, digest = None, head.get("warc-payload-digest")
        if kind == "response":
            payload = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
            digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        elif head.get("content-type", "").startswith("application/warc-fields"):
            fields = _headers(b"\r\n" + block)
        yield {
            "record_id": head.get("warc-record-id"),
            "type": kind,
            "concurrent_to": head.get("warc-concurrent-to"),
            "refers_to": head.get("warc-refers-to"),
            "target_uri": head.get("warc-target-uri"),
            "date": head.get("warc-date"),
            "digest": digest,
            "payload_bytes": None if payload is None else len(payload),
            "payload": payload if keep_payload else None,
            "fields": list(fields.items()),
        }


def read_records(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """One row per record of all archives below ``path``.

    Digests and lengths of responses are computed from the payload that was read.
    """

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for record in _records(_unpacked(content.as_py()), keep_payload):
                    rows.append(record)
                    size += len(record["payload"] or b"") + 500
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, RECORD_TYPE)


def assemble(records: DataFrame) -> DataFrame:
    """``capture, response, request, metadata, copies``: one row per transaction.

    Every record goes to the name its concurrent-to points at (or its own); a response also goes
    to its own name, and what meets there is then gathered by response.  Both steps aggregate
    before they shuffle.  ``copies`` counts responses with the same name.
    """
    body = F.struct(*records.columns)
    answer = F.col("type").isin("response", "revisit", "resource", "conversion")
    own = F.col("record_id")
    names = F.when(answer, F.array_compact(F.array(own, "concurrent_to"))).otherwise(
        F.array(F.coalesce("concurrent_to", own))
    )
    parts = [c for c in records.columns if c != "fields"]
    first = lambda kind: F.min_by(F.when(kind, body), F.when(kind, F.struct(*parts)))
    by_name = (
        records.withColumn("name", F.explode(names))
        .groupBy("name")
        .agg(
            first(answer).alias("response"),
            first(F.col("type") == "request").alias("request"),
            first(F.col("type") == "metadata").alias("metadata"),
            F.sum(F.when(answer & (F.col("name") == own), 1).otherwise(0)).alias("copies"),
        )
    )
    pick = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(f"{c}.record_id")))
    return (
        by_name.groupBy(F.coalesce("response.record_id", "name").alias("capture"))
        .agg(*(pick(c).alias(c) for c in ("response", "request", "metadata")), F.sum("copies").alias("copies"))
    )


def page_captures(captures: DataFrame) -> DataFrame:
    """Digest columns of captures that ``write_archives`` made, one row per page row."""
    full = F.col("response.type") == "response"
    return captures.select(
        F.col("metadata.fields")["pageid"].cast("bigint").alias("page_id"),
        F.when(full, F.col("response.payload_bytes"))
        .otherwise(F.col("metadata.fields")["payloadbytes"].cast("bigint"))
        .alias("payload_bytes"),
        F.regexp_replace("response.digest", "^sha1:", "").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        page_of(F.col("response.refers_to")).alias("refers_to"),
        F.explode(F.sequence(F.lit(1), F.greatest(F.col("copies"), F.lit(1)).cast("int"))).alias("copy"),
    ).drop("copy")
