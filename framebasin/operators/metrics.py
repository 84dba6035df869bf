"""Prediction errors and distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten_components(df: DataFrame, pred: str, true: str, by: Sequence[str] = ()) -> DataFrame:
    """Component pairs of two array columns, one row each."""
    return df.select(
        *by, F.inline(F.arrays_zip(F.col(pred).alias("pred"), F.col(true).alias("true")))
    )


def parity(
    df: DataFrame,
    pred: str = "pred",
    true: str = "true",
    by: Sequence[str] = (),
    scale: float = 1000.0,
    zero_variance: str = "null",
) -> DataFrame:
    """RMSE and MAE (times ``scale``) and R² in one pass.

    The total sum of squares comes from the merged population variance, which
    needs no second pass for the mean. With no variance R² is NULL, or 1 with
    ``zero_variance="one"``.
    """
    p, t = F.col(pred), F.col(true)
    n = F.count(t - p)
    ss_res = F.sum((t - p) * (t - p))
    ss_tot = F.var_pop(t) * n
    flat = {"null": F.lit(None).cast("double"), "one": F.lit(1.0)}[zero_variance]
    return df.groupBy(*by).agg(
        n.alias("n"),
        (F.sqrt(ss_res / n) * scale).alias("rmse"),
        (F.avg(F.abs(p - t)) * scale).alias("mae"),
        F.when(ss_tot == 0, flat).otherwise(1 - ss_res / ss_tot).alias("r2"),
    )


def histogram(df: DataFrame, col: str, bins: int = 35) -> DataFrame:
    """Counts of ``bins`` equal-width bins between min and max; the last bin is closed.

    Empty bins are listed with 0. NULL and NaN fall in no bin.
    """
    df = df.filter(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double")))
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    spark = df.sparkSession
    if lo is None:
        return spark.range(0).select(
            F.col("id").alias("bin"), F.lit(0.0).alias("left"), F.lit(0).cast("long").alias("n")
        )
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    b = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("long")
    counts = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(bins).select(
        F.col("id").alias("bin"), (F.lit(lo) + F.col("id") * F.lit(width)).alias("left")
    )
    return grid.join(counts, "bin", "left").select("bin", "left", F.coalesce("n", F.lit(0)).alias("n"))


def value_range(df: DataFrame, cols: Sequence[str], pad: float = 0.05, tick: float | None = None) -> DataFrame:
    """Common min and max of some columns, padded by a share of the range or widened to ticks."""
    lo = F.least(*[F.min(c) for c in cols]) if len(cols) > 1 else F.min(cols[0])
    hi = F.greatest(*[F.max(c) for c in cols]) if len(cols) > 1 else F.max(cols[0])
    if tick is not None:
        return df.agg(
            (F.floor(lo / tick) * F.lit(tick)).alias("lo"), (F.ceil(hi / tick) * F.lit(tick)).alias("hi")
        )
    span = F.when(hi == lo, 1.0).otherwise(hi - lo)
    return df.agg((lo - span * pad).alias("lo"), (hi + span * pad).alias("hi"))
