"""WARC archives with revisit records, written and read by Spark.

Headers (id, url, digest, length) are shuffled by payload digest and joined to the first response of that digest;
payloads only move once, to meet their decision. Archives are written as gzip files through Spark's text writer:
a record is text that ends with the blank lines that separate records, so any store that Spark can write to holds
them and lost tasks are written again. A gzip file is read by one task in order; records are framed by their
Content-Length, so a payload may hold anything, also the first line of a record.

Defined results: a null payload is empty. Payloads shorter than ``min_bytes`` are always responses. Of equal
payloads the smallest id is the response (null ids last, then the smaller url, null last); of repeated rows one
is the response and the others revisit it. White space and control characters in urls are percent-encoded in
headers. An empty table writes an archive without records. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, scratch_path

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def resolve(headers: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Headers (page_id, url, digest, bytes, copies) with the response of their digest in ``first``.

    ``first`` is null where all payloads of the digest are responses. One aggregate by digest with map-side
    combine and one join of headers; equal digests may be any share of the rows, adaptive execution splits such
    a join.
    """
    order = F.struct(
        F.col("page_id").isNull().alias("a"), F.col("page_id"), F.col("url").isNull().alias("b"), F.col("url")
    )
    firsts = (
        headers.where(F.col("bytes") >= min_bytes)
        .groupBy("digest")
        .agg(F.min(order).alias("first"), F.sum("copies").alias("all"))
        .where("`all` > 1")
        .select("digest", "first")
    )
    return headers.join(firsts, "digest", "left").withColumn("is_first", F.col("first").eqNullSafe(order))


def _record_id(page_id: Column, url: Column, digest: Column, nth: Column) -> Column:
    parts = [F.coalesce(c.cast("string"), F.lit("-")) for c in (page_id, nth, digest, url)]
    h = F.md5(F.concat_ws("\n", *parts))
    groups = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *groups), F.lit(">"))


def _safe(url: Column) -> Column:
    out = url
    for char, code in (("%", "%25"), (" ", "%20"), ("\t", "%09"), ("\n", "%0A"), ("\x0b", "%0B"), ("\x0c", "%0C"), ("\r", "%0D")):
        if char != "%":  # a url's own escapes stay
            out = F.replace(out, F.lit(char), F.lit(code))
    return out


def write_archives(
    pages: DataFrame,
    path: str,
    date: str,
    min_bytes: int = 100,
    page_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
) -> None:
    """One record for each row of ``pages``; rows with a payload seen before become revisit records."""
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"),
    ).withColumns({"digest": F.sha2(F.col("payload"), 256), "bytes": F.octet_length("payload").cast("long")})
    name = [F.coalesce(c.cast("string"), F.lit("-")) for c in (F.col("page_id"), F.col("digest"), F.col("url"))]
    rows = rows.withColumn("row_key", F.concat_ws("|", F.col("page_id").isNull().cast("string"), *name))
    headers = rows.groupBy("row_key", "page_id", "url", "digest", "bytes").agg(F.count(F.lit(1)).alias("copies"))
    decided = cut(resolve(headers, min_bytes).select("row_key", "first", "is_first"), "warc-headers")
    # the window and the join share one exchange of the payloads
    nth = F.row_number().over(Window.partitionBy("row_key").orderBy("bytes"))
    met = rows.withColumn("nth", nth).join(decided, "row_key")
    keys = ("page_id", "url", "digest", "nth")
    long_enough = F.col("first").isNotNull() & (F.col("bytes") >= min_bytes)
    revisit = long_enough & ~(F.col("is_first") & (F.col("nth") == 1))
    met = met.withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))

    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("bytes").cast("string"),
        F.lit(CRLF + CRLF),
    )
    block = F.concat(http, body)

    def line(name: str, value: Column) -> Column:
        """A header line, empty where the value is null."""
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))

    first = F.col("first")
    record = F.concat(
        F.lit(VERSION + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _record_id(*[F.col(k) for k in keys])),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _safe(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("WARC-Refers-To", F.when(revisit, _record_id(first.page_id, first.url, F.col("digest"), F.lit(1)))),
        line("WARC-Refers-To-Target-URI", F.when(revisit, _safe(first.url))),
        line("WARC-Refers-To-Date", F.when(revisit, F.lit(date))),
        line("Source-Row-ID", F.col("page_id").cast("string")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
    )
    met.select(record.alias("value")).write.option("compression", "gzip").option("lineSep", CRLF * 2).text(path)


RECORD = (
    "record_id string, record_type string, target_uri string, page_id long, refers_to_record string, "
    "declared_digest string, payload_digest string, payload_bytes long, payload binary"
)


def _parse(record: bytes) -> tuple | None:
    """Fields of one whole record, or None if its block is still short."""
    head, blank, block = record.partition(b"\r\n\r\n")
    fields = {}
    for x in head.split(b"\r\n"):
        name, _, value = x.partition(b":")
        fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    length = int(fields.get(b"content-length", -1)) if blank else -1
    if not blank or len(block) < length + 4:
        return None
    if length < 0 or block[length:] != b"\r\n\r\n":
        raise ValueError(f"malformed record {fields.get(b'warc-record-id')}: block of {len(block)} bytes, declared {length}")
    block = block[:length]
    payload = block.partition(b"\r\n\r\n")[2] if fields.get(b"content-type", "").startswith("application/http") else block
    kind = fields.get(b"warc-type")
    whole = kind != "revisit"
    return (
        fields.get(b"warc-record-id"), kind, fields.get(b"warc-target-uri"),
        int(fields[b"source-row-id"]) if b"source-row-id" in fields else None,
        fields.get(b"warc-refers-to"), fields.get(b"warc-payload-digest", "").removeprefix("sha256:") or None,
        hashlib.sha256(payload).hexdigest() if whole else None, len(payload) if whole else None,
        payload if whole else None,
    )


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of gzip archives. A file is read by one task, record by record."""
    lines = spark.read.option("lineSep", VERSION + CRLF).text(path).select(
        F.col("value").cast("binary").alias("value"),
        F.col("_metadata.file_path").alias("file"),
        (F.col("_metadata.file_block_length") == F.col("_metadata.file_size")).alias("whole"),
    )
    schema = RECORD if with_payload else RECORD.replace(", payload binary", "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, held = None, []
        for batch in batches:
            found = []
            for value, at, whole in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if not whole:
                    raise ValueError(f"{at} was split: compress it, or raise spark.sql.files.maxPartitionBytes")
                if at != file:
                    if held:
                        raise ValueError(f"{file} ends inside a record")
                    file = at
                    if not value:
                        continue
                held.append(value)
                record = _parse((VERSION + CRLF).encode().join(held))
                if record:
                    found.append(record)
                    held = []
            if found:
                columns = list(zip(*found, strict=True))[: len(names)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        if held:
            raise ValueError(f"{file} ends inside a record")

    return lines.mapInArrow(run, schema)


def with_originals(records: DataFrame) -> DataFrame:
    """Records where revisits carry digest, length and id of the response they refer to."""
    originals = records.where("record_type = 'response'").select(
        F.col("record_id").alias("_of"), F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"),
        F.col("payload_bytes").alias("_bytes"),
    )
    met = records.join(originals, F.col("refers_to_record") == F.col("_of"), "left")
    return met.select(
        "page_id",
        F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"),
        F.coalesce("payload_digest", "_digest").alias("payload_digest"),
        "record_type",
        F.when(F.col("record_type") == "revisit", F.col("_page")).alias("refers_to"),
        "declared_digest",
        "target_uri",
    )


def round_trip(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", min_bytes: int = 100) -> DataFrame:
    """Writes ``pages`` to archives in the scratch folder and returns what they hold, a row for each record."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, date, min_bytes)
    return with_originals(cut(read_archives(spark, path, with_payload=False), "warc-records"))


SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first IS NULL OR f.first = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first <> d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= 100
"""
