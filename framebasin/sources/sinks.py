"""Exports: frame-partitioned folders, audit ledgers, result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import render_frames

# Fixed value: frames per export folder.
GROUP_SIZE = 500


def with_export_group(frames: DataFrame, size: int = GROUP_SIZE, start: int = 0, col: str = "frame_no") -> DataFrame:
    """F8: export id ``start + frame`` and its folder number (``id // size``)."""
    ident = F.col(col) + F.lit(start)
    return frames.withColumns({"export_id": ident, "grp": F.floor(ident / size).cast("long")})


def next_export_id(spark: SparkSession, path: str) -> int:
    """Largest id already exported, plus one; 0 for a new folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return 0
    top = spark.read.parquet(path).agg(F.max("export_id")).first()[0]
    return 0 if top is None else top + 1


def export_frames(
    frames: DataFrame, path: str, size: int = GROUP_SIZE, continue_from: bool = True, col: str = "frame_no"
) -> DataFrame:
    """Frames by export folder, numbered on from what is there; returns what was written.

    Each row holds one frame's text and id, so a folder of ``size`` frames is a
    handful of rows whatever the corpus size.
    """
    spark = frames.sparkSession
    start = next_export_id(spark, path) if continue_from else 0
    numbered = with_export_group(frames, size, start, col)
    text = render_frames(numbered.withColumn("frame_idx", F.col("export_id"))).select(
        F.col("frame_idx").alias("export_id"), "value"
    )
    out = text.withColumn("grp", F.floor(F.col("export_id") / size).cast("long"))
    # rows of one folder meet in one task: a folder holds at most ``size`` frames
    out.repartition("grp").write.mode("append").partitionBy("grp").parquet(path)
    return numbered.select(col, "export_id", "grp")


def append_audit(records: DataFrame, path: str, mode: str = "append") -> None:
    """Run or extraction records, appended or overwritten."""
    records.write.mode(mode).parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "error") -> None:
    """A result table as CSV with header, or Parquet."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", "true").csv(path)
    else:
        writer.format(fmt).save(path)
