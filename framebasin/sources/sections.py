"""Lines of a log with the section they stand in, open sections carried from split to split.

A section starts at an opening line and lasts to the next one. Each split counts its own lines and keeps its last
opener; a prefix over the splits of a file (a row for each split) gives every split its first line number and the
section that is still open where it starts. Inside a split a window over its lines does the rest, so no file is read by
one task, and lines that no caller needs are dropped before they are sorted.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def with_sections(
    scan: DataFrame, openers: Mapping[str, Column], keep: Column | None = None, flags: Mapping[str, Column] | None = None
) -> DataFrame:
    """``file, blk, line_no, line, section, opened, at`` of scanned lines, and inclusive running counts of ``flags``.

    ``openers`` names the section that a line opens (the first condition that holds); ``at`` counts from the opening
    line, ``opened`` is that line's number. Of the other lines only those that meet ``keep`` stay. Lines before the
    first opener have no section. Flags count opening or kept lines only.
    """
    flags = dict(flags or {})
    kind = F.coalesce(*[F.when(c, F.lit(k)) for k, c in openers.items()])
    marked = scan.withColumn("__kind", kind)
    opens = F.col("__kind").isNotNull()
    kept = opens if keep is None else opens | keep
    blocks = cut(
        marked.groupBy("file", "blk").agg(
            F.min("pos").alias("first"),
            F.count(F.lit(1)).alias("lines"),
            F.max(F.when(opens, F.struct("pos", "__kind"))).alias("last"),
            *[F.count_if(c & kept).alias(f"__c_{k}") for k, c in flags.items()],
        ),
        "splits",
    )
    before = Window.partitionBy("file").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("shift", F.coalesce(F.sum("lines").over(before), F.lit(0)) - F.col("first"))
    last = F.when(
        F.col("last").isNotNull(), F.struct((F.col("last.pos") + F.col("shift")).alias("no"), F.col("last.__kind").alias("kind"))
    )
    carried = placed.withColumn("__last", last).select(
        "file", "blk", "shift", F.last("__last", ignorenulls=True).over(before).alias("__open"),
        *[F.coalesce(F.sum(f"__c_{k}").over(before), F.lit(0)).alias(f"__c_{k}") for k in flags],
    )
    lines = marked.where(kept).join(carried, ["file", "blk"]).withColumn("line_no", F.col("pos") + F.col("shift"))
    inside = Window.partitionBy("file", "blk").orderBy("line_no")
    here = F.when(F.col("__kind").isNotNull(), F.struct(F.col("line_no").alias("no"), F.col("__kind").alias("kind")))
    counts = {k: F.col(f"__c_{k}") + F.sum(F.when(c, 1).otherwise(0)).over(inside) for k, c in flags.items()}
    found = lines.withColumns({"__here": F.coalesce(F.last(here, ignorenulls=True).over(inside), F.col("__open")), **counts})
    return found.select(
        "file", "blk", "line_no", "line", F.col("__here.kind").alias("section"), F.col("__here.no").alias("opened"),
        (F.col("line_no") - F.col("__here.no")).alias("at"), *flags,
    )
