"""Scratch space and table cutting shared by all operators.

Multi-pass operators (farthest-point sampling, crowded-group de-duplication)
cut their lineage by writing a table to the shared folder the cluster names in
``spark.checkpoint.dir``. A lost executor then re-reads files instead of
recomputing the whole history.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def setting(spark: SparkSession, key: str, default: str | None = None) -> str | None:
    """Session setting with a default (session conf first, then context conf)."""
    value = spark.conf.get(key, None)
    return value if value is not None else default


def scratch_root(spark: SparkSession) -> str:
    """Shared scratch folder; a temporary one only where none is configured and all tasks run on this machine."""
    root = setting(spark, _CHECKPOINT_KEY)
    if root is None:
        master = setting(spark, "spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set {_CHECKPOINT_KEY} to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="framebasin-")
        spark.conf.set(_CHECKPOINT_KEY, root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/framebasin/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as a table in the scratch folder and read it back.

    Shuffle files of the write go as soon as the table is there; nothing reads them again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if (inside := _passing.get()) is not None:
        inside.append(path)
    before = spark.conf.get(_CLEANUP_KEY, "false")
    spark.conf.set(_CLEANUP_KEY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP_KEY, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[Callable[[], DataFrame]], DataFrame]]:
    """Tables that ``cut`` writes inside are removed at the end, but for those that a call of the yielded function writes.

    What is returned may read such lasting tables only; they go with an enclosing block, if there is one.
    """
    around, paths = _passing.get(), []
    token = _passing.set(paths)

    def lasting(write: Callable[[], DataFrame]) -> DataFrame:
        before = _passing.set(around)
        try:
            return write()
        finally:
            _passing.reset(before)

    try:
        yield lasting
    finally:
        _passing.reset(token)
        for path in paths:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
