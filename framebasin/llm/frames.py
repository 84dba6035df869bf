"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCH = 4 << 20  # bytes of an Arrow batch; the JVM, the pipe and the worker each hold one or two for every task

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lean(df: DataFrame, name: str) -> DataFrame:
    """``cut`` with Arrow batches bounded by bytes, so that memory does not follow the length of the texts."""
    conf = df.sparkSession.conf
    before = conf.get(_BATCH_KEY, None)
    conf.set(_BATCH_KEY, str(_BATCH))
    try:
        return cut(df, name)
    finally:
        conf.unset(_BATCH_KEY) if before is None else conf.set(_BATCH_KEY, before)


def give_back() -> None:
    """What Arrow and the C library hold for reuse goes back; workers live on through many stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving back its memory when the task's rows end."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return mapped


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that the text column holds about ``most`` bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        per_row = max(1, batch.column(column).nbytes // batch.num_rows)
        step = max(1, most // per_row)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


#: One struct holds the columns an operator doesn't use, so their names can't meet its own.
_REST = "__rest"


def carry(df: DataFrame, needed: tuple[str, ...]) -> DataFrame:
    """``df`` with the needed columns and all others in one struct."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in needed]
    return df.select(*[F.col(f"`{c}`") for c in needed], F.struct(*(rest or [F.lit(0).alias("none")])).alias(_REST))


def restore(out: DataFrame, df: DataFrame, needed: tuple[str, ...], new: tuple[str, ...] = (), drop: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``df`` in its order, then the new ones; a new column replaces an old one of its name."""
    old = [
        F.col(f"`{c}`") if c in needed else F.col(f"{_REST}.`{c}`").alias(c)
        for c in df.columns
        if c not in new and c not in drop
    ]
    return out.select(*old, *[F.col(f"`{c}`") for c in new])
