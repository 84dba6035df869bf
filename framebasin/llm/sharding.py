"""Shards of equal bytes, tokens and rows by vector bin packing.

1. Rows with equal texts form a group; its vector is the sum of bytes, tokens and rows, each as a share of what one
   shard is to hold. A group above a whole shard in any of them (48 at most) is dealt into pieces by its ids.
2. Groups go to shards in descending order of their largest share, each to the shard where the dot product of its
   vector with the residual capacity, bytes counting most, is highest, among those that have room for it if any has.
3. Large groups are placed first and one after the other; by arithmetic there are at most ``3 * shards * fine * cells``.
   The others are dealt into cells by hash. Every cell has its share of the residual capacity of each shard
   and packs its groups as a sorted stream, so only the loads of the shards are held, and cells run side by side.
4. Slots number the rows of a shard without gaps: rows of earlier cells, of earlier groups of the cell, place in group.

Rows move once, with their group; no group is collected, and a hot one is split by step 1 and in ordered segments.

Defined results: a null text has no bytes and no tokens; null texts form a group, apart from empty ones. Rows of one
text that repeat an id too stay together, whatever their number. Two texts with one 64-bit hash form one group, which
is packed as such. An empty table gives an empty result. Extra columns stay; ``size``, ``shard`` and ``slot`` replace
columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.running import Ordered
from ..session import cut
from .frames import carry, n_words, restore

DIMS = ("bytes", "tokens", "rows")


@dataclass(frozen=True)
class Plan:
    shards: int = 16
    per_cell: int = 8192  # groups that a cell packs
    most_cells: int = 1024
    fine: int = 8  # a group above 1 / fine of a cell's part of a shard is placed before the cells
    pieces: int = 4  # of a group that no shard can hold, for each shard it would fill
    weights: tuple[float, float, float] = (4.0, 2.0, 1.0)  # of bytes, tokens and rows in the dot product


class Packer:
    """Loads of all shards; ``put`` places one vector."""

    def __init__(self, free: np.ndarray, weights: tuple[float, float, float], turn: int = 0):
        self.weights = weights
        self.turn = turn % len(free)  # the shard that is first among equals
        self.free = np.roll(free, -self.turn, axis=0).T.copy()
        self.rows = [0] * len(free)

    def put(self, share: Sequence[float], rows: int) -> tuple[int, int]:
        """The shard of a group, and the number of rows placed there before it."""
        (a, b, c), (x, y, z), (u, v, w) = self.free, share, self.weights
        dot = a * (u * x) + b * (v * y) + c * (w * z)
        room = (a >= x) & (b >= y) & (c >= z)
        at = int(np.argmax(np.where(room, dot, -np.inf) if room.any() else dot))
        self.free[:, at] -= share
        shard = (at + self.turn) % len(self.rows)
        before = self.rows[shard]
        self.rows[shard] += rows
        return shard, before


def _vector() -> list[Column]:
    sums = (F.sum("_bytes"), F.sum("_tokens"), F.count(F.lit(1)))
    return [c.cast("long").alias(n) for c, n in zip(sums, DIMS, strict=True)]


def place(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``docs`` (doc_id, text, any more) with ``size``, bytes of the text plus one, ``shard`` and ``slot``."""
    spark = docs.sparkSession
    needed = ("doc_id", "text")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    rows = carry(docs, needed).withColumns({"_group": F.xxhash64("text"), "_bytes": size, "_tokens": n_words(F.col("text"))})
    groups = cut(rows.groupBy("_group").agg(*_vector()), "groups")
    totals = groups.agg(*[F.coalesce(F.sum(d), F.lit(0)) for d in DIMS], F.count(F.lit(1))).first()
    cap = [t / plan.shards for t in totals[:3]]
    share = {d: (F.col(d) / F.lit(c)) if c else F.lit(0.0) for d, c in zip(DIMS, cap, strict=True)}
    weight = F.greatest(*share.values())
    large = {r["_group"]: int(np.ceil(r["w"] * plan.pieces)) for r in groups.where(weight > 1).select("_group", weight.alias("w")).collect()}
    piece = F.lit(0)
    for group, pieces in large.items():  # three for each shard at most
        piece = F.when(F.col("_group") == group, F.pmod(F.xxhash64("doc_id"), F.lit(pieces)).cast("int")).otherwise(piece)
    rows = rows.withColumn("_piece", piece)
    units = groups.withColumn("_piece", F.lit(0))
    if large:
        cut_up = rows.where(F.col("_group").isin(*large)).groupBy("_group", "_piece").agg(*_vector())
        units = units.where(~F.col("_group").isin(*large)).unionByName(cut_up)
    cells = min(plan.most_cells, max(1, -(-totals[3] // plan.per_cell)))
    units = cut(
        units.select(
            "_group", "_piece", *DIMS, weight.alias("_weight"),
            F.pmod(F.xxhash64(F.lit("cell"), "_group", "_piece"), F.lit(cells)).cast("int").alias("_cell"),
        ),
        "units",
    )
    limit = 1 / (plan.fine * cells)
    early, free = _place_large(units.where(F.col("_weight") > limit), cap, plan)
    late = _place_cells(units.where(F.col("_weight") <= limit), cap, free, cells, plan)
    placed = cut(early.unionByName(late), "placed")
    counts = placed.groupBy("_shard", "_cell").agg(F.sum("rows").alias("n")).collect()  # shards * (cells + 1) rows at most
    base, before = [], dict.fromkeys(range(plan.shards), 0)
    for r in sorted(counts):
        base.append((r["_shard"], r["_cell"], before[r["_shard"]]))
        before[r["_shard"]] += r["n"]
    bases = spark.createDataFrame(base, "_shard int, _cell int, _base long")
    first = placed.join(F.broadcast(bases), ["_shard", "_cell"]).select("_group", "_piece", "_shard", (F.col("_base") + F.col("_before")).alias("_first"))
    ranked = Ordered(rows.drop("_tokens"), ["_group", "_piece"], ["doc_id"]).rank("_rank").result()
    met = ranked.join(first, ["_group", "_piece"])
    met = met.withColumns({"size": F.col("_bytes"), "shard": F.col("_shard"), "slot": F.col("_first") + F.col("_rank")})
    return restore(met, docs, needed, ("size", "shard", "slot"))


_PLACED = "_group long, _piece int, rows long, _cell int, _shard int, _before long"


def _place_large(units: DataFrame, cap: list[float], plan: Plan) -> tuple[DataFrame, np.ndarray]:
    """The few large groups, in descending order, and what is free in each shard afterwards."""
    packer = Packer(np.ones((plan.shards, len(DIMS))), plan.weights)
    out = []
    for r in units.orderBy(F.desc("_weight"), "_group", "_piece").collect():  # 3 * shards * fine * cells at most
        shard, before = packer.put(tuple(r[d] / c if c else 0.0 for d, c in zip(DIMS, cap, strict=True)), r["rows"])
        out.append((r["_group"], r["_piece"], r["rows"], -1, shard, before))
    return units.sparkSession.createDataFrame(out, _PLACED), packer.free.T


def _place_cells(units: DataFrame, cap: list[float], free: np.ndarray, cells: int, plan: Plan) -> DataFrame:
    """All other groups, cell by cell: a cell fills its part of what is free."""
    scale = np.array([1 / c if c else 0.0 for c in cap])
    sums = np.zeros((cells, len(DIMS)))
    for r in units.groupBy("_cell").agg(*[F.sum(d).alias(d) for d in DIMS]).collect():  # a row for each cell
        sums[r["_cell"]] = np.array([r[d] for d in DIMS]) * scale
    left = np.maximum(free, 0)
    part, weights = left / np.maximum(left.sum(axis=0), 1e-300), plan.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, packer = None, None
        for batch in batches:
            put = []
            shares = np.stack([batch.column(d).to_numpy() for d in DIMS], axis=1) * scale
            for c, rows, x in zip(batch.column("_cell").to_pylist(), batch.column("rows").to_pylist(), shares, strict=True):
                if c != cell:
                    cell, packer = c, Packer(part * sums[c], weights, c)
                put.append(packer.put(x, rows))
            shard, before = zip(*put, strict=True) if put else ((), ())
            kept = [batch.column(n) for n in ("_group", "_piece", "rows", "_cell")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(shard, pa.int32()), pa.array(before, pa.int64())],
                ["_group", "_piece", "rows", "_cell", "_shard", "_before"],
            )

    dealt = units.repartition(cells, "_cell").sortWithinPartitions("_cell", F.desc("_weight"), "_group", "_piece")
    return dealt.mapInArrow(run, _PLACED)


def write_shards(placed: DataFrame, path: str, files: int = 4) -> None:
    """A folder for each shard, its rows in the order of their slots over about ``files`` files."""
    shards = placed.agg(F.coalesce(F.max("shard"), F.lit(0))).first()[0] + 1
    ordered = placed.repartitionByRange(shards * files, "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)
