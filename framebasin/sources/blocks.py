"""Frames cut out of text splits in the scanning task.

A task walks the lines of its split and emits whole frames; only what stands before the first and after the last
frame of a split, the piece of a frame that straddles the border, is shuffled and put together. A tolerant frame
starts at every lone count, so the first one of a split is certain. A strict frame starts where the count lines say,
so a split that begins inside a file takes the first lone count whose rows look like atoms and that leads to another
count. A row per split tells how many lines stood before that frame and how many its last frame still lacks; if these
do not add up from border to border, the guess was wrong or the file is broken, and the file is read by the chain of
its count lines instead (``chain``), which raises on broken files. Every line of a file is in a frame, in a piece or
blank between frames; that is checked too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut

_NUM = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
ATOM_ROW = rf"^\s*[^\s=]+\s+{_NUM}\s+{_NUM}\s+{_NUM}(\s|$)"
COUNT_LINE = r"^\s*(\d+)(\s|$)"
LONE_COUNT = r"^\s*0*[1-9]\d*\s*$"

_FRAME, _HEAD, _TAIL, _SPLIT = range(4)
_SCHEMA = "file string, blk long, kind int, nth long, at long, ls array<string>, lines long, frames long, head long, trail long, need long, spoiled boolean"
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]
_TYPES = [
    pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(),
]
_ROWS_OUT = 2000


class _Walker:
    """The lines of one split, one after the other; rows to emit gather in ``out``."""

    def __init__(self, file: str, blk: int, strict: bool):
        self.file, self.blk, self.strict = file, blk, strict
        self.out: list[tuple] = []
        self.held: list[str] = []  # lines before the first frame, then of the open frame
        self.seen = self.given = self.frames = self.head = self.trail = 0
        self.size: int | None = None  # lines of the open frame, once its header is read
        self.started = strict and blk == 0
        self.guess: int | None = None  # a held line that may start the first frame
        self.spoiled = False
        self.at = 0

    def add(self, line: str) -> None:
        self.seen += 1
        if self.started and self.strict:
            self._step(line, self.seen - 1)
        elif self.strict:
            self.held.append(line)
            self._look()
        else:
            if _LONE(line):
                self._close()
                self.started, self.at = True, self.seen - 1
            self.held.append(line)

    def _step(self, line: str, no: int) -> None:
        """A line of a strict split whose frames are known to start here."""
        if self.size is None:
            count = None if self.spoiled else _COUNT(line)
            if not count:
                self.spoiled = self.spoiled or bool(line)
                self.given += 1  # blank between frames, or the rest of a broken split
                return
            self.size, self.at = int(count.group(1)) + 2, no
        self.held.append(line)
        if len(self.held) == self.size:
            self._close()

    def _look(self) -> None:
        """Judge the newest held line: a guess holds while atoms follow it and is a start once a count follows them."""
        at = len(self.held) - 1
        while at < len(self.held):
            line = self.held[at]
            if self.guess is None:
                if _LONE0(line):
                    self.guess = at
            elif at > self.guess + 1:
                inside = at < self.guess + 2 + int(self.held[self.guess])
                if inside and not _ATOM(line) or not inside and line and not _LONE0(line):
                    at, self.guess = self.guess, None  # the next line is judged anew
                elif not inside and line:
                    return self._start()
            at += 1

    def _start(self) -> None:
        lines, first = self.held, self.guess
        self.held, self.started = [], True
        self._piece(lines[:first])
        for k in range(first, len(lines)):
            self._step(lines[k], k)

    def _piece(self, lines: list[str]) -> None:
        """The lines before the first frame."""
        self.head = len(lines)
        while self.trail < len(lines) and not lines[-1 - self.trail]:
            self.trail += 1
        if lines:
            self._emit(_HEAD, 0, 0, lines)

    def _close(self) -> None:
        """The held lines are a whole frame, or in a tolerant split those before the first one."""
        if not self.started:
            self._piece(self.held)
        elif self.held:
            self._emit(_FRAME, self.frames, self.at, self.held)
            self.frames += 1
        self.held, self.size = [], None

    def end(self) -> None:
        if not self.started and self.guess is not None:
            self._start()
        need = None
        if not self.started:
            self._piece(self.held)
        else:
            need = self.size - len(self.held) if self.held and self.strict else 0
            if self.held:
                self._emit(_TAIL, self.frames, self.at, self.held)
                self.frames += 1
        if self.given != self.seen:
            raise RuntimeError(f"{self.file}: {self.seen} lines were read and {self.given} passed on")
        self.out.append((self.file, self.blk, _SPLIT, *[None] * 3, self.seen, self.frames, self.head, self.trail, need, self.spoiled))

    def _emit(self, kind: int, nth: int, at: int, lines: list[str]) -> None:
        self.given += len(lines)
        self.out.append((self.file, self.blk, kind, nth, at, lines, *[None] * 6))


_LONE = re.compile(LONE_COUNT).match
_LONE0 = re.compile(r"^\s*\d+\s*$").match
_COUNT = re.compile(COUNT_LINE).match
_ATOM = re.compile(ATOM_ROW).match


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


def _walk(strict: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = None
        for batch in batches:
            for file, blk, line in zip(*(batch.column(c).to_pylist() for c in ("file", "blk", "line")), strict=True):
                if walker is None or file != walker.file or blk != walker.blk:
                    if walker is not None:
                        walker.end()
                        yield _batch(walker.out)
                    walker = _Walker(file, blk, strict)
                walker.add(line)
            if walker is not None and len(walker.out) >= _ROWS_OUT:
                yield _batch(walker.out)
                walker.out = []
        if walker is not None:
            walker.end()
            yield _batch(walker.out)

    return run


def scan_text(spark: SparkSession, paths, **options) -> DataFrame:
    """``file, blk, line`` as the text source reads them: lines of a split in order, splits in any."""
    rows = (spark.read.options(**options) if options else spark.read).text(paths)
    return rows.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("blk"), F.rtrim("value").alias("line")
    )


def frame_blocks(spark: SparkSession, paths, strict: bool = True, **options) -> DataFrame:
    """Frames as arrays of lines: ``file, frame_idx, line_no, ls``, the header line first.

    Strict: the count line decides how many lines follow; a file whose lines do not fit is an error. Tolerant: a lone
    positive integer opens a frame and everything up to the next one is its body; lines before the first one go.
    """
    return blocks_of(scan_text(spark, paths, **options), strict)


def blocks_of(lines: DataFrame, strict: bool = True) -> DataFrame:
    """``frame_blocks`` of lines (``file, blk, line``) that come as ``scan_text`` gives them."""
    found = cut(lines.mapInArrow(_walk(strict), _SCHEMA), "blocks")
    splits = found.where(F.col("kind") == _SPLIT)
    by_file = Window.partitionBy("file").orderBy("blk")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    has = F.col("need").isNotNull().cast("long")
    whole = splits.select(
        "file", "blk", "lines", "head", "trail", "need", "spoiled",
        F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("start"),
        F.coalesce(F.sum("frames").over(before), F.lit(0)).alias("base"),
        F.sum(has).over(by_file.rowsBetween(Window.unboundedPreceding, 0)).alias("open"),
    )
    whole = cut(whole.withColumn("into", F.col("open") - F.when(F.col("need").isNotNull(), 1).otherwise(0)), "borders")
    odd = _misfits(whole) if strict else None
    if odd is not None and odd.isEmpty():
        odd = None
    if odd is not None:
        odd = cut(odd, "odd")
        found, whole = found.join(odd, "file", "left_anti"), whole.join(odd, "file", "left_anti")
    place = whole.select("file", "blk", "start", "base", "open", "into")
    frames = found.where(F.col("kind") == _FRAME).join(place, ["file", "blk"]).select(
        "file", (F.col("base") + F.col("nth")).alias("frame_idx"), (F.col("start") + F.col("at")).alias("line_no"), "ls"
    )
    opened = F.when(F.col("kind") == _TAIL, F.col("open")).otherwise(F.col("into"))
    pieces = found.where(F.col("kind").isin(_HEAD, _TAIL)).join(place, ["file", "blk"]).withColumn("open", opened).where("open > 0")
    tail = F.col("kind") == _TAIL
    joined = pieces.groupBy("file", "open").agg(
        F.max(F.when(tail, F.col("base") + F.col("nth"))).alias("frame_idx"),
        F.max(F.when(tail, F.col("start") + F.col("at"))).alias("line_no"),
        F.array_sort(F.collect_list(F.struct("blk", F.when(tail, 1).otherwise(0).alias("t"), "ls"))).alias("parts"),
    ).where("frame_idx IS NOT NULL")  # blank lines after a whole frame have no tail
    ls = F.flatten(F.transform("parts", lambda p: p["ls"]))
    if strict:
        size = F.regexp_extract(F.get(F.get("parts", F.lit(0))["ls"], F.lit(0)), COUNT_LINE, 1).cast("int") + 2
        ls = F.slice(ls, F.lit(1), size)
    out = frames.union(joined.select("file", "frame_idx", "line_no", ls.alias("ls")))
    if odd is None:
        return out
    from .chain import chained_blocks

    return out.union(chained_blocks(lines, odd))


def _misfits(splits: DataFrame) -> DataFrame:
    """Files whose pieces do not add up: the lines before a frame are not those that the frame before lacks."""
    per_frame = splits.groupBy("file", F.col("into").alias("open")).agg(
        F.sum("head").alias("have"), F.max_by("trail", F.when(F.col("head") > 0, F.col("blk"))).alias("blanks")
    )
    needed = splits.where("need IS NOT NULL").select("file", "open", "need")
    met = needed.join(per_frame, ["file", "open"], "full").select(
        "file", (F.coalesce("have", F.lit(0)) - F.coalesce("need", F.lit(0))).alias("extra"), F.coalesce("blanks", F.lit(0)).alias("blanks")
    )
    wrong = met.where((F.col("extra") < 0) | (F.col("extra") > F.col("blanks"))).select("file")
    return wrong.union(splits.where("spoiled").select("file")).distinct()
