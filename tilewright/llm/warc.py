"""WARC archives: write captures, read them back, assemble transactions.

A capture is a request, a response (or a revisit of an equal payload) and a metadata record; request and
metadata name the capture by WARC-Concurrent-To. Archives are gzip text files in a shared folder, written by
Spark's own writer and read as whole files of a bounded number of records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_of

# Fixed values of the format.
VERSION = "WARC/1.1"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"

RECORDS_PER_FILE = 1000
RECORDS = (
    "warc_type string, record_id string, concurrent_to string, refers_to string, target_uri string, payload_digest string, "
    "found_digest string, payload_bytes bigint, fields map<string,string>, block binary"
)


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a hex digest whose length is a multiple of five digits."""
    def four(i: Column) -> Column:
        value = F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[
            F.substring(F.lit(BASE32), F.shiftright(value, k).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for k in (15, 10, 5, 0)
        ])

    return F.array_join(F.transform(F.sequence(F.lit(0), (F.length(digest) / 5).cast("int") - 1), four), "")


def _record_id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def plan_captures(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, sha1, n, first, copy``: ``first`` is the smallest page_id with an equal payload where the page
    revisits it, else null. ``copy`` numbers rows of one page_id and payload from 1, so that each becomes a capture of its own.

    Only digests are grouped and joined to find copies; payloads are equal if SHA-1 and length are. A null html
    is an empty payload. A null page_id is never revisited nor a revisit.
    """
    rows = pages.select("page_id", "url", text_of("html").alias("html"))
    rows = rows.withColumns({"sha1": F.sha1("html"), "n": F.octet_length("html").cast("bigint")})
    facts = rows.where(F.col("n") >= min_bytes).select("page_id", "sha1", "n")
    firsts = facts.groupBy("sha1", "n").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last")
    revisits = facts.join(firsts, ["sha1", "n"]).where("page_id > first").select("page_id", "sha1", "first").distinct()
    # The join has brought these rows together; which of them comes first does not matter.
    met = W.partitionBy("page_id", "sha1").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.join(revisits, ["page_id", "sha1"], "left").select("page_id", "url", "html", "sha1", "n", "first", F.count(F.lit(1)).over(met).alias("copy"))


def _record(kind: str, record_id: Column, headers: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    lines = [F.lit(f"{VERSION}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), record_id, F.lit("\r\n")]
    for name, value in headers:
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    lines += [F.lit(f"Content-Type: {content_type}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block]
    return F.concat(*lines)


def write_warc(captures: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes planned captures (``plan_captures``) as ``.gz`` archives below ``path``: three records per capture."""
    url = F.regexp_replace(F.col("url").cast("string"), r"[\x00-\x20\x7F]", "_")
    digest = F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1")))
    again = F.col("first").isNotNull()
    kind = F.when(again, F.lit("revisit")).otherwise(F.lit("response"))
    own = _record_id(kind, F.col("page_id"), F.col("sha1"), F.col("copy"))
    asked = _record_id(F.lit("request"), F.col("page_id"), F.col("sha1"), F.col("copy"))
    noted = _record_id(F.lit("metadata"), F.col("page_id"), F.col("sha1"), F.col("copy"))
    stamp = F.lit(date)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    base = [("WARC-Target-URI", url), ("WARC-Date", stamp)]
    profile = F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    capture = F.when(
        again,
        _record("revisit", own, [
            *base, ("WARC-Payload-Digest", digest), ("WARC-Profile", profile),
            ("WARC-Refers-To", _record_id(F.lit("response"), F.col("first"), F.col("sha1"), F.lit(1))),
        ], "application/http;msgtype=response", http),
    ).otherwise(
        _record("response", own, [*base, ("WARC-Payload-Digest", digest)], "application/http;msgtype=response", F.concat(http, F.col("html")))
    )
    path_part = F.coalesce(F.nullif(F.regexp_replace(url, r"^[a-z]+://[^/]*", ""), F.lit("")), F.lit("/"))
    request = _record(
        "request", asked, [*base, ("WARC-Concurrent-To", own)], "application/http;msgtype=request",
        F.concat(F.lit("GET "), path_part, F.lit(" HTTP/1.1" + END)),
    )
    metadata = _record(
        "metadata", noted, [*base, ("WARC-Concurrent-To", own)], "application/warc-fields",
        F.concat_ws("", F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n"))),
    )
    rows = captures.select(F.explode(F.array(request, capture, metadata)).alias("value"))
    rows.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(lower-case header fields, block) of each record of an unpacked archive; blocks are cut by Content-Length."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("archive ends inside a record")
        yield fields, block


def split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload


def _row(fields: dict[str, str], block: bytes, keep_block: bool) -> dict:
    kind = fields.get("warc-type")
    size = found = None
    extra: dict[str, str] = {}
    if kind == "response":
        _, payload = split_http(block)
        size, found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    elif kind == "revisit":
        http, _ = split_http(block)
        size = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
    elif fields.get("content-type") == "application/warc-fields":
        for line in block.decode("utf-8", "replace").splitlines():
            name, _, value = line.partition(":")
            extra[name.strip().lower()] = value.strip()
    digest = fields.get("warc-payload-digest")
    return {
        "warc_type": kind, "record_id": fields.get("warc-record-id"), "concurrent_to": fields.get("warc-concurrent-to"),
        "refers_to": fields.get("warc-refers-to"), "target_uri": fields.get("warc-target-uri"),
        "payload_digest": digest.partition(":")[2] if digest else None, "found_digest": found, "payload_bytes": size,
        "fields": list(extra.items()), "block": block if keep_block else None,
    }


def read_warc(spark: SparkSession, path: str, keep_block: bool = True) -> DataFrame:
    """One row per record of the gzip archives below ``path`` (columns as in ``RECORDS``)."""
    files = spark.read.format("binaryFile").load(path).select("content")
    types = pa.schema([
        *[(n, pa.string()) for n in ("warc_type", "record_id", "concurrent_to", "refers_to", "target_uri", "payload_digest", "found_digest")],
        ("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("block", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[dict] = []
                size = 0
                for fields, block in parse_records(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                    rows.append(_row(fields, block, keep_block))
                    size += len(block)
                    if size > 16_000_000 or len(rows) >= 2000:
                        yield pa.RecordBatch.from_pylist(rows, types)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, types)

    return files.mapInArrow(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture`` (the response or revisit), ``requests`` and ``metadata`` (arrays).

    Other records join through WARC-Concurrent-To, directly or through one record between. A record that names
    no capture in the table is left out. Records that repeat a record id of a capture are one capture.
    """
    columns = records.columns
    captures = records.where(F.col("warc_type").isin("response", "revisit") & F.col("record_id").isNotNull()).select(
        F.col("record_id").alias("root"), F.struct(*columns).alias("capture")
    ).dropDuplicates(["root"])
    rest = records.where(~F.col("warc_type").isin("response", "revisit") & F.col("concurrent_to").isNotNull())
    hops = rest.select(F.col("record_id").alias("via"), F.col("concurrent_to").alias("beyond")).where("via is not null").dropDuplicates(["via"])
    named = rest.select("concurrent_to", F.struct(*columns).alias("record"))
    reached = named.join(hops, F.col("concurrent_to") == F.col("via"), "left").select(F.coalesce("beyond", "concurrent_to").alias("root"), "record")
    joined = reached.groupBy("root").agg(
        F.collect_list(F.when(F.col("record.warc_type") == "request", F.col("record"))).alias("requests"),
        F.collect_list(F.when(F.col("record.warc_type") == "metadata", F.col("record"))).alias("metadata"),
    )
    return captures.join(joined, "root", "left").select(
        F.col("root").alias("record_id"), "capture",
        F.coalesce("requests", F.array()).alias("requests"), F.coalesce("metadata", F.array()).alias("metadata"),
    )
