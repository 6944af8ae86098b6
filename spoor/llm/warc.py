"""WARC archives without repeated payloads.

Headers alone (digest, id, length) are shuffled to find each payload's original, pre-aggregated so that
one digest may hold any share of the rows. Every other record of the digest becomes a revisit record that
refers to the original. Records are strings, written by Spark's text writer with CRLF CRLF between them,
which is the WARC record separator, so archives land in any store that Spark writes. Payloads are read
back from whole archive files, whose number of records is bounded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.session import _checkpoint_dir

HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_PER_FILE = 5000
SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: each five hex digits are four base32 digits."""
    groups = [F.lpad(F.conv(F.substring(F.sha1(data), 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """`pages` (page_id, url, payload, row_no) with payload_bytes, payload_digest and `original` (row, id and url, null for responses).

    Of equal payloads of at least `min_bytes` bytes the row with the largest (page_id, row_no) is the
    response; a null page_id is smaller than any other.
    """
    data = F.encode("payload", "UTF-8")
    rows = pages.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(data)})
    heads = rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max(F.struct("page_id", "row_no", "url")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = rows.join(heads, ["payload_digest", "payload_bytes"], "left")
    return rows.withColumn("original", F.when(F.col("first.row_no") != F.col("row_no"), F.col("first"))).drop("first")


def _record(date: str) -> Column:
    urn = lambda page, row: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), row.cast("string"), F.lit(">"))
    clean = lambda url: F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", " ")
    revisit = F.col("original").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("payload")))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"), F.col("row_no"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", clean(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit(PROFILE)),
            line("WARC-Refers-To", urn(F.col("original.page_id"), F.col("original.row_no"))),
            line("WARC-Refers-To-Target-URI", clean(F.col("original.url"))),
            line("WARC-Refers-To-Date", F.lit(date)),
            line("X-Original-Payload-Length", F.col("payload_bytes").cast("string")),
        )).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"), block,
    )


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write one record per row of `pages` below `path` as gzip-compressed WARC files.

    Null payloads are empty, null URLs are written empty, line ends in URLs become spaces; null and repeated
    ids are told apart by a row number. Other columns are ignored. An empty table writes no records.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("row_no", F.xxhash64("page_id", "url", "payload"))
    same = rows.groupBy("page_id", "row_no").count().filter("count > 1").limit(1)
    if not same.isEmpty():  # rows that repeat in every column are numbered
        rows = rows.withColumn("row_no", F.monotonically_increasing_id())
    resolve_revisits(rows, min_bytes).select(_record(date).alias("record")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse_warc(content: bytes):
    """(header fields, block) of every record of an archive."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        fields = dict(x.split(": ", 1) for x in content[at:end].decode("utf-8", "surrogatepass").split("\r\n")[1:])
        size = int(fields["Content-Length"])
        yield fields, content[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _read(batches):
    number = lambda urn: None if (x := urn.strip("<>").split(":")[2]) == "none" else int(x)
    for b in batches:
        for content in b.column(0):
            rows = []
            for fields, block in parse_warc(gzip.decompress(content.as_py())):
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                refers = None
                if fields["WARC-Type"] == "revisit":
                    size, refers = int(fields["X-Original-Payload-Length"]), number(fields["WARC-Refers-To"])
                else:
                    payload = block.split(b"\r\n\r\n", 1)[1]
                    size = len(payload)
                    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
                rows.append((number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], refers))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below `path`; payloads are checked against their digests."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(_read, SCHEMA)


def archive_folder(spark: SparkSession) -> str:
    return f"{_checkpoint_dir(spark)}/warc/{uuid.uuid4().hex}"
