"""Strict frame starts by the chain of count lines, exact for any file.

Candidate lines are resolved per split: for every candidate the split's task works out where the chain leaves the split.
Exits and the splits they lead to form a graph of a few rows per split; which of them the chain from the first line of
the file meets is found by doubling jumps, so the number of passes follows the logarithm of the number of splits.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .blocks import COUNT_LINE

_STARTS = T.ArrayType(
    T.StructType([T.StructField("line_no", T.LongType()), T.StructField("n", T.LongType())])
)


def _exits(cands: list, end: int) -> dict[int, int]:
    """Where the chain from each candidate leaves the split (``end`` is its last line + 1)."""
    out: dict[int, int] = {}
    for line_no, n in reversed(cands):
        nxt = line_no + n + 2
        out[line_no] = out.get(nxt, -1) if nxt < end else nxt
    return out


def _pairs(rows) -> list[tuple[int, int]]:
    return [(r["line_no"], r["n"]) for r in rows]


@F.pandas_udf(T.ArrayType(T.LongType()))
def _distinct_exits(cands: pd.Series, end: pd.Series) -> pd.Series:
    return pd.Series([sorted({x for x in _exits(_pairs(c), e).values() if x >= 0}) for c, e in zip(cands, end)])


@F.pandas_udf(T.ArrayType(T.LongType()))
def _exits_of(cands: pd.Series, end: pd.Series, entries: pd.Series) -> pd.Series:
    def one(rows, stop, wanted):
        exits = _exits(_pairs(rows), stop)
        return [exits.get(w, -1) for w in wanted]

    return pd.Series([one(*a) for a in zip(cands, end, entries)])


@F.pandas_udf(_STARTS)
def _chain(cands: pd.Series, end: pd.Series, entry: pd.Series) -> pd.Series:
    def one(rows, stop, at):
        size = dict(_pairs(rows))
        out = []
        while at < stop:
            if at not in size:
                raise ValueError(f"line {at}: an atom count was expected")
            if size[at] >= 0:
                out.append({"line_no": at, "n": size[at]})
            at += size[at] + 2
        return out

    return pd.Series([[] if pd.isna(a) else one(r, e, int(a)) for r, e, a in zip(cands, end, entry)])


def _candidates(scan: DataFrame) -> DataFrame:
    """One row per split: line range and the lines a frame could start at.

    A blank line is a candidate of size -1: the chain steps over it to the next line.
    """
    count = F.regexp_extract("line", COUNT_LINE, 1)
    size = F.when(F.length("line") == 0, F.lit(-1).cast("long")).when(count != "", count.try_cast("bigint"))
    blocks = cut(
        scan.groupBy("file", "blk").agg(
            F.min("pos").alias("first"),
            F.count(F.lit(1)).alias("lines"),
            F.array_sort(
                F.collect_list(F.when(size.isNotNull(), F.struct("pos", size.alias("n"))))
            ).alias("at"),
        ),
        "splits",
    )
    w = Window.partitionBy("file").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    slim = blocks.select("file", "blk", F.coalesce(F.sum("lines").over(w), F.lit(0)).alias("start"))
    return blocks.join(slim, ["file", "blk"]).select(
        "file",
        "blk",
        "start",
        (F.col("start") + F.col("lines")).alias("end"),
        (F.col("start") - F.col("first")).alias("shift"),
        F.transform(
            "at",
            lambda c: F.struct(
                (c["pos"] - F.col("first") + F.col("start")).alias("line_no"), c["n"].alias("n")
            ),
        ).alias("cands"),
    )


def _entries(blocks: DataFrame) -> DataFrame:
    """Line at which the chain of count lines enters each split (NULL: passes over it)."""
    first = blocks.select("file").distinct().withColumn("at", F.lit(0).cast("long"))
    if blocks.where(F.col("start") > 0).isEmpty():
        return blocks.select("file", "blk", F.lit(0).cast("long").alias("entry"))
    exits = blocks.select("file", F.explode(_distinct_exits("cands", "end")).alias("at")).union(first).distinct()
    # the split that holds each exit: the last split start at or before it
    bounds = blocks.select("file", F.col("start").alias("at"), "blk", "end").where(F.col("end") > F.col("start"))
    asked = exits.select("file", "at", F.lit(None).cast("long").alias("blk"), F.lit(None).cast("long").alias("end"))
    order = Window.partitionBy("file").orderBy("at", F.col("blk").isNull())  # a few rows for each split
    held = F.last(F.when(F.col("blk").isNotNull(), F.struct("blk", "end")), ignorenulls=True).over(order)
    met = bounds.union(asked).withColumn("in", held).where("blk IS NULL AND at < in.end").select("file", "at", "in.blk")
    wanted = met.groupBy("file", "blk").agg(F.sort_array(F.collect_list("at")).alias("entries"))
    answers = blocks.join(wanted, ["file", "blk"]).select("file", "blk", "entries", _exits_of("cands", "end", "entries").alias("exits"))
    steps = answers.select("file", "blk", F.inline(F.arrays_zip("entries", "exits"))).toDF("file", "blk", "at", "to")
    steps = cut(steps, "steps")
    reached, jumps = cut(first, "reached"), steps.select("file", "at", "to")
    known = reached.count()
    while True:
        onward = reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = cut(reached.union(onward).distinct(), "reached")
        far = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("far"))
        jumps = cut(jumps.join(far, ["file", "to"]).select("file", "at", F.col("far").alias("to")), "jumps")
        more = reached.count()
        if more == known:
            break
        known = more
    used = steps.join(reached, ["file", "at"])
    broken = F.raise_error(F.format_string("%s: an atom count was expected after offset %d", F.col("file"), F.col("blk")))
    entry = F.when(F.col("to") < 0, broken.cast("long")).otherwise(F.col("at"))
    return blocks.select("file", "blk").join(used.select("file", "blk", entry.alias("entry")), ["file", "blk"], "left")


def chained_blocks(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Frames of the named files as arrays of lines: ``file, frame_idx, line_no, ls``."""
    scan = cut(lines.withColumn("pos", F.monotonically_increasing_id()).join(files, "file", "left_semi"), "lines")
    blocks = _candidates(scan)
    chained = cut(
        blocks.join(_entries(blocks), ["file", "blk"]).select(
            "file", "blk", "shift", _chain("cands", "end", "entry").alias("starts")
        ),
        "starts",
    )
    w = Window.partitionBy("file").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    before = chained.select("file", "blk", "shift", F.size("starts").alias("k")).select(
        "file", "blk", "shift", F.coalesce(F.sum("k").over(w), F.lit(0)).alias("seen")
    )
    lines = scan.join(before, ["file", "blk"]).select(
        "file", "blk", "seen", (F.col("pos") + F.col("shift")).alias("line_no"), "line",
        F.lit(None).cast("long").alias("n"),
    )
    starts = chained.select("file", "blk", F.explode("starts").alias("h")).select(
        "file", "blk", F.lit(None).cast("long").alias("seen"), "h.line_no",
        F.lit(None).cast("string").alias("line"), "h.n",
    )
    # a start row sorts just before the line it marks; splits bound the window
    local = Window.partitionBy("file", "blk").orderBy("line_no", F.col("line").isNotNull())
    held = (
        lines.unionByName(starts)
        .withColumn("__f", F.count("n").over(local))
        .filter(F.col("line").isNotNull())
        .withColumn("frame_idx", F.col("seen") + F.col("__f") - 1)
        .filter(F.col("frame_idx") >= 0)
    )
    grouped = held.groupBy("file", "frame_idx").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    return grouped.select("file", "frame_idx", F.get("ls", F.lit(0))["line_no"].alias("line_no"), F.transform("ls", lambda s: s["line"]).alias("ls"))
