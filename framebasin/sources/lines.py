"""Text files as numbered lines.

A big file is read in splits by many tasks. The split's start offset is file
metadata, and rows of one split arrive in order, so (split start, position in
split) orders the lines of a file. Line numbers come from line counts per split
plus a prefix sum over the splits of a file - no file is read by one task, and
nothing larger than one row per split is shuffled for it.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import natural_key
from ..operators.running import group_rank
from ..session import cut


#: Encodings tried in turn. A byte order mark decides for the first; a text with NUL characters is no text.
ENCODINGS = ("utf-16", "utf-8-sig", "utf-16le", "utf-8")
_WIDE = ("utf16", "utf32")


def _text(spark: SparkSession, paths, options: dict) -> DataFrame:
    """``file, blk, pos, value`` of the text source."""
    return spark.read.options(**options).text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("blk"),
        F.monotonically_increasing_id().alias("pos"),
        "value",
    )


def _decoded(encoding: str):
    """Lines in a charset whose line breaks are single bytes, decoded batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [v.decode(encoding) for v in batch.column("value").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("value"), "value", pa.array(text, pa.string()))

    return run


def _decode(content: bytes, tried: Sequence[str]) -> tuple[str | None, str]:
    for encoding in tried:
        marked = content[:2] in (b"\xff\xfe", b"\xfe\xff")
        if encoding.replace("-", "").replace("_", "").lower() == "utf16" and not marked and len(tried) > 1:
            continue
        try:
            text = content.decode(encoding)
        except UnicodeDecodeError:
            continue
        if len(tried) == 1 or "\0" not in text:
            return encoding, text
    return None, ""


def _whole(spark: SparkSession, paths, tried: Sequence[str], options: dict, only: DataFrame | None = None) -> DataFrame:
    """``file, encoding, blk, pos, value`` of files decoded in one piece: wide encodings have no line break of one byte."""
    files = spark.read.format("binaryFile").options(**options).load(paths).select(F.col("_metadata.file_path").alias("file"), "content")
    files = files if only is None else files.join(only, "file", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                encoding, text = _decode(content, tried)
                lines = text.split("\n") if text else [""]
                lines = lines[:-1] if len(lines) > 1 and not lines[-1] else lines
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file] * len(lines)), pa.array([encoding] * len(lines), pa.string()),
                        pa.array([0] * len(lines), pa.int64()), pa.array(range(len(lines)), pa.int64()), pa.array(lines, pa.string()),
                    ],
                    ["file", "encoding", "blk", "pos", "value"],
                )

    return files.mapInArrow(run, "file string, encoding string, blk long, pos long, value string")


def _narrow(spark: SparkSession, paths, options: dict) -> DataFrame:
    """``file, utf8`` of files with lines: whether all bytes are UTF-8, without NUL and without a wide mark."""
    rows = _text(spark, paths, options)
    first = F.min_by(F.hex(F.substring(F.col("value").cast("binary"), 1, 2)), F.struct("blk", "pos"))
    judged = rows.groupBy("file").agg(
        F.min(F.is_valid_utf8("value") & (F.instr("value", "\0") == 0)).alias("fits"), first.alias("first")
    )
    return cut(judged.select("file", (F.col("fits") & ~F.col("first").isin("FFFE", "FEFF")).alias("utf8")), "encodings")


def encodings_of(spark: SparkSession, paths, tried: Sequence[str] = ENCODINGS, **options) -> DataFrame:
    """A10: ``file, encoding`` of all files with content, NULL where every encoding that was tried fails."""
    narrow = _narrow(spark, paths, options)
    name = next((e for e in tried if e.startswith("utf-8")), None)
    plain = F.col("utf8") if name else F.lit(False)
    wide = _whole(spark, paths, tried, options, narrow.where(~plain)).where("pos = 0").select("file", "encoding")
    return narrow.where(plain).select("file", F.lit(name).alias("encoding")).union(wide)


def scan_lines(spark: SparkSession, paths, encoding: str | Sequence[str] | None = None, **options) -> DataFrame:
    """``file, blk, pos, line`` of text files; ``pos`` orders the lines of a split.

    The lines are written once to the scratch folder. Split bounds depend on the settings and the executors of the
    moment, so numbers counted in one scan would not fit the lines of another; both come from the table.

    ``encoding`` is a Python codec, or several that are tried in turn for each file; files that none of them fits have
    no lines (``encodings_of`` names them). Files in a wide encoding are decoded in one piece.
    """
    names = ("file", "blk", "pos", "value")
    if encoding is None:
        rows = _text(spark, paths, options)
    elif isinstance(encoding, str):
        if encoding.replace("-", "").replace("_", "").lower().startswith(_WIDE):
            rows = _whole(spark, paths, [encoding], options).select(*names)
        else:
            raw = _text(spark, paths, options).withColumn("value", F.col("value").cast("binary"))
            rows = raw.mapInArrow(_decoded(encoding), "file string, blk long, pos long, value string")
    else:
        narrow = _narrow(spark, paths, options)
        plain = F.col("utf8") if any(e.startswith("utf-8") for e in encoding) else F.lit(False)
        rows = _text(spark, paths, options).join(narrow.where(plain), "file", "left_semi").select(*names)
        wide = narrow.where(~plain)
        if not wide.isEmpty():
            rows = rows.union(_whole(spark, paths, encoding, options, wide).where("encoding IS NOT NULL").select(*names))
        rows = rows.withColumn("value", F.regexp_replace("value", "^\ufeff", ""))
    return cut(rows.select("file", "blk", "pos", F.rtrim(F.regexp_replace("value", "\r$", "")).alias("line")), "lines")


def number_lines(scan: DataFrame, flags: Mapping[str, Column] | None = None) -> DataFrame:
    """Add the 0-based ``line_no`` in each file, and inclusive running counts of ``flags``.

    The first pass keeps one row per split; written as a table its size is known,
    so Spark broadcasts it only while it is small and shuffles otherwise.
    """
    flags = dict(flags or {})
    blocks = cut(
        scan.groupBy("file", "blk").agg(
            F.min("pos").alias("first"),
            F.count(F.lit(1)).alias("n"),
            *[F.count_if(c).alias(f"__c_{k}") for k, c in flags.items()],
        ),
        "splits",
    )
    w = Window.partitionBy("file").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(
        "file",
        "blk",
        (F.coalesce(F.sum("n").over(w), F.lit(0)) - F.col("first")).alias("shift"),
        *[F.coalesce(F.sum(f"__c_{k}").over(w), F.lit(0)).alias(f"__c_{k}") for k in flags],
    )
    local = Window.partitionBy("file", "blk").orderBy("pos")
    counts = [
        (F.col(f"__c_{k}") + F.sum(F.when(c, 1).otherwise(0)).over(local)).alias(k)
        for k, c in flags.items()
    ]
    return scan.join(before, ["file", "blk"]).select(
        "file", "blk", (F.col("pos") + F.col("shift")).alias("line_no"), "line", *counts
    )


def read_lines(
    spark: SparkSession, paths, flags: Mapping[str, Column] | None = None, **options
) -> DataFrame:
    """``file, blk, line_no, line`` (and running flag counts) for a corpus of text files."""
    return number_lines(scan_lines(spark, paths, **options), flags)


def list_files(spark: SparkSession, paths, **options) -> DataFrame:
    """``file, bytes, file_ord``: dense order by natural sort of the path. Reads no contents."""
    reader = spark.read.format("binaryFile").options(**options)
    files = reader.load(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("length").alias("bytes")
    )
    keyed = files.withColumn("__nk", natural_key(F.col("file")))
    ranked = group_rank(keyed, [], ["__nk", "file"], "file_ord")
    # as a table its size is known: joins on the file broadcast it only while it is small
    return cut(ranked.withColumn("file_ord", F.col("file_ord").cast("int")).drop("__nk"), "files")


def discover(
    spark: SparkSession, root, names: str | None = None, exclude: str | None = None
) -> DataFrame:
    """Files below ``root`` whose name matches ``names`` (glob), outputs excluded.

    ``exclude`` is a regular expression on the path. Contents are not read.
    """
    options = {"recursiveFileLookup": "true", **({"pathGlobFilter": names} if names else {})}
    if not exclude:
        return list_files(spark, root, **options)
    files = list_files(spark, root, **options).drop("file_ord").filter(~F.col("file").rlike(exclude))
    return group_rank(
        files.withColumn("__nk", natural_key(F.col("file"))), [], ["__nk", "file"], "file_ord"
    ).withColumn("file_ord", F.col("file_ord").cast("int")).drop("__nk")
