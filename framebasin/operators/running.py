"""Ranks, running sums and lags that survive a hot group.

A plain window sorts one whole group in one task. Here groups above a row limit
are first split into ordered segments; windows run per (group, segment) and the
segment totals, a table bounded by the number of segments, are added back.
Groups below the limit take the plain window, so ordinary data pays one cheap
count and no extra shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import setting

HOT_ROWS_KEY = "framebasin.hotGroupRows"
HOT_ROWS = 2_000_000
MAX_HOT = 4096  # a hot group holds more than 1/4096 of all rows, so there are at most this many
_SAMPLES = 16  # sampled rows per segment; they only place the cut points
_FAN = 64  # cut points per second-level list

_SEG = "__seg"
_HOT = "__hot"


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL; the keys of ``left`` are kept."""
    names = {k: f"__k_{i}" for i, k in enumerate(keys)}
    side = right.withColumnsRenamed(names)
    met = left.join(side, [F.col(f"`{k}`").eqNullSafe(F.col(v)) for k, v in names.items()], how)
    return met.drop(*names.values())


class Ordered:
    """Rows grouped ``by`` some columns and totally ordered inside each group.

    ``order`` must be ascending expressions that are unique within a group
    (negate a number to sort it descending).
    """

    def __init__(
        self,
        df: DataFrame,
        by: Sequence[str],
        order: Sequence[str | Column],
        hot_rows: int | None = None,
    ):
        self.by = list(by)
        self.order = _cols(order)
        self._segments_bounded = True
        self.df = df
        self.split = False
        limit = hot_rows or int(setting(df.sparkSession, HOT_ROWS_KEY, str(HOT_ROWS)))
        self._split_hot(limit)

    @classmethod
    def from_segments(
        cls, df: DataFrame, by: Sequence[str], seg: str, order: Sequence[str | Column]
    ) -> "Ordered":
        """Use segments the data already has (ordered, bounded in size)."""
        self = cls.__new__(cls)
        self.by, self.order = list(by), _cols(order)
        self.df = df.withColumn(_SEG, F.col(seg)).withColumn(_HOT, F.lit(True))
        self.split = True
        self._segments_bounded = False
        return self

    # -- splitting -----------------------------------------------------------

    def _split_hot(self, limit: int) -> None:
        df = self.df
        counts = df.groupBy(*self.by).agg(F.count(F.lit(1)).alias("__n"))
        top = counts.agg(F.max("__n").alias("most"), F.sum("__n").alias("total")).first()
        if top["most"] is None:
            return
        limit = max(limit, top["total"] // MAX_HOT)
        if top["most"] <= limit:
            return
        key = F.struct(*self.order)
        step = max(1, limit // _SAMPLES)
        if self.by:
            hot = counts.filter(F.col("__n") > limit).select(*self.by)
            rows = null_safe_join(df, F.broadcast(hot), self.by, "left_semi")
        else:
            rows = df
        sample = (
            rows.select(*self.by, key.alias("__k"))
            .filter(F.pmod(F.xxhash64("__k"), F.lit(step)) == 0)
            .groupBy(*self.by)
            .agg(F.array_sort(F.collect_list("__k")).alias("__s"))
            .select(
                *self.by,
                F.filter("__s", lambda _, i: i % _SAMPLES == _SAMPLES - 1).alias("__b"),
            )
            .filter(F.size("__b") > 0)
            .select(
                *self.by,
                F.transform(
                    F.sequence(F.lit(0), F.floor((F.size("__b") - 1) / _FAN).cast("int")),
                    lambda j: F.slice("__b", j * _FAN + 1, F.lit(_FAN)),
                ).alias("__fine"),
            )
        )
        # at most MAX_HOT rows and a few thousand cut points in all
        cuts = df.sparkSession.createDataFrame(sample.collect(), sample.schema)
        joined = (
            null_safe_join(df, F.broadcast(cuts), self.by, "left")
            if self.by
            else df.withColumn("__fine", cuts.select("__fine").scalar())
        )
        coarse = F.size(
            F.filter(F.slice("__fine", 2, F.greatest(F.size("__fine"), F.lit(1))), lambda c: F.get(c, F.lit(0)) <= key)
        )
        fine = F.size(F.filter(F.get("__fine", coarse), lambda c: c <= key))
        self.df = (
            joined.withColumn(_HOT, F.col("__fine").isNotNull())
            .withColumn(
                _SEG, F.when(F.col(_HOT), coarse * (_FAN + 1) + fine).otherwise(F.lit(0))
            )
            .drop("__fine")
        )
        self.split = True

    def _window(self) -> Window:
        keys = [*self.by, _SEG] if self.split else (self.by or [F.lit(0)])
        return Window.partitionBy(*keys).orderBy(*self.order)

    def _carry(self, aggs: Mapping[str, Column], combine) -> DataFrame:
        """One row per segment with what its predecessors in the group carry in."""
        per_seg = (
            self.df.filter(_HOT)
            .groupBy(*self.by, _SEG)
            .agg(*[c.alias(n) for n, c in aggs.items()])
        )
        w = Window.partitionBy(*(self.by or [F.lit(0)])).orderBy(_SEG)
        return per_seg.select(*self.by, _SEG, *[combine(n, w).alias(n) for n in aggs])

    def _attach(self, carry: DataFrame) -> DataFrame:
        keys = [*self.by, _SEG]
        side = F.broadcast(carry) if self._segments_bounded else carry
        return null_safe_join(self.df, side, keys, "left")

    # -- results -------------------------------------------------------------

    def rank(self, name: str, start: int = 0) -> "Ordered":
        """Position in the group, counted from ``start``."""
        w = self._window()
        if not self.split:
            self.df = self.df.withColumn(name, (F.row_number().over(w) + (start - 1)).cast("long"))
            return self
        carry = self._carry(
            {"__c": F.count(F.lit(1))},
            lambda n, sw: F.sum(n).over(sw.rowsBetween(Window.unboundedPreceding, -1)),
        )
        ranked = self.df.withColumn(name, F.row_number().over(w).cast("long"))
        self.df = ranked
        self.df = (
            self._attach(carry)
            .withColumn(name, F.col(name) + F.coalesce("__c", F.lit(0)) + F.lit(start - 1))
            .drop("__c")
        )
        return self

    def running_sum(self, sums: Mapping[str, Column]) -> "Ordered":
        """Inclusive running totals, one output column per entry."""
        w = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = {n: F.sum(c).over(w) for n, c in sums.items()}
        if not self.split:
            self.df = self.df.withColumns(local)
            return self
        carry = self._carry(
            {f"__c_{n}": F.sum(c) for n, c in sums.items()},
            lambda n, sw: F.sum(n).over(sw.rowsBetween(Window.unboundedPreceding, -1)),
        )
        self.df = self.df.withColumns(local)
        self.df = (
            self._attach(carry)
            .withColumns({n: F.col(n) + F.coalesce(f"__c_{n}", F.lit(0)) for n in sums})
            .drop(*[f"__c_{n}" for n in sums])
        )
        return self

    def lag(self, lags: Mapping[str, Column]) -> "Ordered":
        """Previous value in the group (NULL on the first row)."""
        w = self._window()
        local = {n: F.lag(c).over(w) for n, c in lags.items()}
        if not self.split:
            self.df = self.df.withColumns(local)
            return self
        key = F.struct(*self.order)
        carry = self._carry(
            {f"__c_{n}": F.max_by(c, key) for n, c in lags.items()},
            lambda n, sw: F.lag(n).over(sw),
        )
        first = F.row_number().over(w) == 1
        self.df = self.df.withColumns({**local, "__first": first})
        self.df = (
            self._attach(carry)
            .withColumns(
                {n: F.when(F.col("__first"), F.col(f"__c_{n}")).otherwise(F.col(n)) for n in lags}
            )
            .drop("__first", *[f"__c_{n}" for n in lags])
        )
        return self

    def group_size(self, name: str) -> "Ordered":
        """Rows in the group of each row."""
        if not self.split:
            size = F.count(F.lit(1)).over(Window.partitionBy(*(self.by or [F.lit(0)])))
            self.df = self.df.withColumn(name, size)
            return self
        sizes = self.df.groupBy(*self.by).agg(F.count(F.lit(1)).alias(name))
        if self.by:
            self.df = null_safe_join(self.df, sizes, self.by)
        else:
            self.df = self.df.withColumn(name, sizes.scalar())
        return self

    def result(self) -> DataFrame:
        return self.df.drop(_SEG, _HOT)


def group_rank(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    name: str,
    start: int = 0,
    hot_rows: int | None = None,
) -> DataFrame:
    """position of each row in its group; ``by=[]`` ranks the whole table."""
    return Ordered(df, by, order, hot_rows).rank(name, start).result()


def prefix_offsets(df: DataFrame, order: str, size: str, name: str, block: int = 4096) -> DataFrame:
    """Exclusive prefix sum of ``size`` over dense integer ``order``, in two levels.

    Used for global positions over files: totals per block of ``block`` entries
    are summed first, so no window sees more than a block or the block list.
    """
    b = F.floor(F.col(order) / block)
    blocks = df.groupBy(b.alias("__b")).agg(F.sum(size).alias("__t"))
    bw = Window.partitionBy(F.lit(0)).orderBy("__b")
    before = blocks.select(
        "__b",
        F.coalesce(F.sum("__t").over(bw.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
    )
    iw = Window.partitionBy("__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("__b", b)
        .withColumn("__in", F.coalesce(F.sum(size).over(iw), F.lit(0)))
        .join(before, "__b")
        .withColumn(name, (F.col("__in") + F.col("__before")).cast("long"))
        .drop("__b", "__in", "__before")
    )
