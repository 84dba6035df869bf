"""Picking frames: top-N, slices, uniform and random samples, splits, ledgers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import group_rank

# Default picks per source and least uncertainty.
TOP_N = 15
MIN_UNCERTAINTY = 0.3

_GROUP_LIMIT = 1000  # up to here Spark prunes each group before the shuffle
_TAKE_LIMIT = 100_000  # up to here a sorted limit is merged from small per-task heaps


def filter_uncertainty(df: DataFrame, least: float = MIN_UNCERTAINTY, col: str = "uncertainty") -> DataFrame:
    """Uncertainty present and at least ``least``."""
    return df.filter(F.col(col) >= least)


def filter_deviation(df: DataFrame, least: float, col: str) -> DataFrame:
    """Deviation strictly above ``least``."""
    return df.filter(F.col(col) > least)


def top_n(
    df: DataFrame, by: str, n: int, per: Sequence[str] = (), order: Sequence[str] = ("frame_idx",)
) -> DataFrame:
    """The ``n`` rows with the largest ``by``, per group or overall; ties take the earlier row.

    Rows whose ``by`` is NULL or NaN are never picked.
    """
    df = df.filter(F.col(by).isNotNull() & ~F.isnan(F.col(by).cast("double")))
    ascending = [-F.col(by), *[F.col(c) for c in order]]
    if per and n <= _GROUP_LIMIT:
        w = Window.partitionBy(*per).orderBy(*ascending)
        ranked = df.withColumn("rank", F.row_number().over(w))
    elif not per and n <= _TAKE_LIMIT:
        return df.orderBy(*ascending).limit(n)
    else:
        ranked = group_rank(df, per, ascending, "rank", start=1)
    return ranked.filter(F.col("rank") <= n).drop("rank")


def uncertainty_stats(df: DataFrame, by: str = "source", value: str = "uncertainty") -> DataFrame:
    """Frames, min, mean and max per source, and one row (source NULL) over all."""
    return df.rollup(by).agg(
        F.count(F.lit(1)).alias("frames"),
        F.min(value).alias("u_min"),
        F.avg(value).alias("u_mean"),
        F.max(value).alias("u_max"),
    )


def pick(df: DataFrame, index: int, base: int = 0, col: str = "frame_idx") -> DataFrame:
    """One frame by number."""
    return df.filter(F.col(col) == index - base)


def pick_many(df: DataFrame, indices: Iterable[int], base: int = 0, col: str = "frame_idx") -> DataFrame:
    """Frames by number; repeats count once, a number out of range is an error."""
    wanted = sorted({i - base for i in indices})
    count = df.count()
    outside = [i for i in wanted if not 0 <= i < count]
    if outside:
        raise ValueError(f"frame numbers out of range [0, {count}): {outside}")
    table = df.sparkSession.createDataFrame([(i,) for i in wanted], f"{col} long")
    return df.join(table, col, "left_semi")


def frame_slice(df: DataFrame, start: int, end: int, col: str = "frame_idx") -> DataFrame:
    """Frames ``[start, end)``; bounds beyond the data are harmless."""
    return df.filter((F.col(col) >= max(start, 0)) & (F.col(col) < end))


def frame_range(df: DataFrame, a: float, b: float, col: str = "frame_idx") -> DataFrame:
    """Frames ``[int(a n), int(b n))`` of ``n``."""
    n = df.count()
    return frame_slice(df, int(a * n), int(b * n), col)


def uniform_indices(df: DataFrame, k: int, n: int, skip: int = 0, col: str = "frame_idx") -> DataFrame:
    """``k`` evenly spaced positions of ``n``, truncated to integers, the last one exact."""
    spark = df.sparkSession
    if k < 1:
        return spark.range(0).select(F.col("id").alias(col))
    step = (n - 1) / (k - 1) if k > 1 else 0.0
    at = F.floor(F.col("id") * F.lit(step))
    if k > 1:
        at = F.when(F.col("id") == k - 1, n - 1).otherwise(at)
    return spark.range(k).select((at + skip).cast("long").alias(col))


def sample_uniform(df: DataFrame, k: int, skip: int = 0, col: str = "frame_idx") -> DataFrame:
    """``k`` evenly spaced frames after the first ``skip``; repeats stay if k exceeds n."""
    n = df.count() - skip
    return df.join(uniform_indices(df, k, n, skip, col), col)


def shuffle_key(seed: int, *cols: str | Column) -> Column:
    """Reproducible random order: a digest of the row key and the seed."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *cols))


def sample_random(
    df: DataFrame,
    k: int,
    seed: int,
    key: Sequence[str] = ("frame_idx",),
    scope: tuple[int, int] | None = None,
    ledger: DataFrame | None = None,
) -> DataFrame:
    """``k`` frames without replacement, inside a closed scope, not exported before.

    Fewer than ``k`` candidates is an error.
    """
    pool = df
    if scope is not None:
        pool = pool.filter(F.col(key[-1]).between(*scope))
    if ledger is not None:
        pool = new_frames(pool, ledger, key).drop("event")
    count = pool.count()
    if count < k:
        raise ValueError(f"only {count} frames are available, {k} were asked for")
    picked = pool.withColumn("__h", shuffle_key(seed, *key))
    order = ["__h", *key]
    if k <= _TAKE_LIMIT:
        return picked.orderBy(*order).limit(k).drop("__h")
    return group_rank(picked, [], order, "__r").filter(F.col("__r") < k).drop("__h", "__r")


def half_even(x: float) -> int:
    return int(round(x))


def split(df: DataFrame, ratio: float = 0.8, seed: int = 0, key: Sequence[str] = ("frame_idx",)) -> DataFrame:
    """Shuffled split of exact size (rounded half to even) in column ``part``."""
    size = half_even(df.count() * ratio)
    ranked = group_rank(
        df.withColumn("__h", shuffle_key(seed, *key)), [], ["__h", *key], "__r"
    )
    return ranked.withColumn("part", F.when(F.col("__r") < size, "train").otherwise("test")).drop("__h", "__r")


def test_count(size: float | int, n: int) -> int:
    """Frames in the test set: a share of ``n`` (at least one) or a plain count, always below ``n``."""
    if isinstance(size, float):
        if not 0 < size < 1:
            raise ValueError("a share must lie between 0 and 1")
        number = max(1, int(n * size + 0.5))
    else:
        number = size
    if number < 1 or number >= n:
        raise ValueError(f"test set of {number} frames out of {n}")
    return number


def split_test(
    df: DataFrame,
    size: float | int,
    method: str = "uniform",
    seed: int = 0,
    vector: str | None = None,
    col: str = "frame_idx",
) -> tuple[DataFrame, DataFrame]:
    """(train, test); test by uniform, random or farthest-point choice, train is the rest."""
    n = df.count()
    number = test_count(size, n)
    if method == "uniform":
        test = df.join(uniform_indices(df, number, n, 0, col), col, "left_semi")
    elif method == "random":
        test = sample_random(df, number, seed, (col,))
    elif method == "fps":
        from .descriptors import farthest_points

        picks = farthest_points(df, vector, (col,), count=number)
        test = df.join(picks.select(col), col, "left_semi")
    else:
        raise ValueError(f"unknown method {method!r}")
    return df.join(test.select(col), col, "left_anti"), test


# -- export ledger ---------------------------------------------------------------


def refresh_ledger(ledger: DataFrame, present: DataFrame, path: str = "path") -> DataFrame:
    """Status of ledger rows against the paths that exist now."""
    seen = present.select(path).distinct().withColumn("__there", F.lit(True))
    there = F.col("__there").isNotNull()
    return (
        ledger.join(seen, path, "left")
        .withColumn("event", F.when(there, F.col("event")).otherwise("removed"))
        .withColumn("status", F.when(there, "present").otherwise("lost"))
        .drop("__there")
    )


def new_frames(df: DataFrame, ledger: DataFrame, key: Sequence[str] = ("frame_idx",)) -> DataFrame:
    """Frames to export: never recorded (``new``) or recorded but lost (``rebuilt``)."""
    state = ledger.groupBy(*key).agg(
        F.max(F.when(F.col("status") == "present", 1).otherwise(0)).alias("__present")
    )
    return (
        df.join(state, list(key), "left")
        .filter(F.coalesce("__present", F.lit(0)) == 0)
        .withColumn("event", F.when(F.col("__present").isNull(), "new").otherwise("rebuilt"))
        .drop("__present")
    )
