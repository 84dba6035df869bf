"""Counts and summaries over a corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_report(df: DataFrame, kept: Column, by: str = "file") -> DataFrame:
    """Frames read, kept and removed per file, and in total (file NULL)."""
    return df.rollup(by).agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if(kept).alias("kept"),
        F.count_if(~kept).alias("removed"),
    )


def dataset_summary(sets: DataFrame) -> DataFrame:
    """Species, frames and atoms per frame, from rows with ``natoms`` and ``elements``."""
    species = sets.select(F.explode("elements").alias("s")).agg(
        F.array_join(F.array_sort(F.collect_set("s")), " ").alias("species")
    )
    return sets.agg(
        F.count(F.lit(1)).alias("frames"),
        F.min("natoms").alias("min_atoms"),
        F.max("natoms").alias("max_atoms"),
    ).withColumn("species", species.scalar())
