"""Trajectory statistics over positions in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cell
from .running import Ordered

AXES = ("fx", "fy", "fz")


def unwrap(
    positions: DataFrame,
    by: Sequence[str] = ("file", "atom_idx"),
    order: Sequence[str] = ("frame_idx",),
    axes: Sequence[str] = AXES,
    hot_rows: int | None = None,
) -> DataFrame:
    """unwrapped displacement ``u_<axis>`` from the first frame, in fractional units.

    A step longer than half a cell is folded by one cell. ``step`` counts from
    0 at the origin frame.
    """
    o = Ordered(positions, by, order, hot_rows)
    o.lag({f"__p_{a}": F.col(a) for a in axes})

    def folded(a: str) -> Column:
        d = F.col(a) - F.col(f"__p_{a}")
        return F.coalesce(F.when(F.abs(d) > 0.5, d - F.signum(d)).otherwise(d), F.lit(0.0))

    o.running_sum({f"u_{a}": folded(a) for a in axes}).rank("step")
    return o.result().drop(*[f"__p_{a}" for a in axes])


def msd(
    positions: DataFrame,
    lattice: Column | None = None,
    by: Sequence[str] = ("file", "atom_idx"),
    order: Sequence[str] = ("frame_idx",),
    axes: Sequence[str] = AXES,
    group: Sequence[str] = ("step", "species"),
    **kw,
) -> DataFrame:
    """Mean squared displacement per step and species, total and per axis, and its root.

    ``lattice`` (nine components) turns fractional into Cartesian displacement.
    """
    moved = unwrap(positions, by, order, axes, **kw).filter(F.col("step") > 0)
    frac = [F.col(f"u_{a}") for a in axes]
    cart = cell.to_cart(frac, lattice) if lattice is not None else frac
    sq = [c * c for c in cart]
    out = moved.groupBy(*group).agg(
        F.avg(sum(sq[1:], sq[0])).alias("msd"),
        *[F.avg(s).alias(f"msd_{n}") for s, n in zip(sq, "xyz")],
    )
    return out.withColumns(
        {"rmsd": F.sqrt("msd"), **{f"rmsd_{n}": F.sqrt(f"msd_{n}") for n in "xyz"}}
    )


def track(frames: DataFrame, indices: Sequence[Sequence[int]], base: int = 1) -> DataFrame:
    """Length of fixed atom pairs, or angle at the middle of fixed triplets, per frame."""
    rows = [list(t) for t in indices]
    width = {len(t) for t in rows}
    if width not in ({2}, {3}):
        raise ValueError("all index tuples must be pairs, or all must be triplets")
    # atoms of a frame sit in its row, so the lookup needs no join
    tuples = F.array(*[F.array(*[F.lit(i - base) for i in t]) for t in rows])
    picked = frames.withColumn("inv", cell.cell_inverse(F.col("lattice"))).select(
        "file_ord", "frame_idx", "lattice", "inv", "pbc", "atoms", F.posexplode(tuples).alias("tuple", "t")
    )

    def at(k: int) -> Column:
        return F.get("atoms", F.get("t", F.lit(k)))

    def link(p: int, q: int) -> list[Column]:
        dr = [at(q)[c] - at(p)[c] for c in "xyz"]
        return cell.min_image(dr, F.col("lattice"), F.col("inv"), F.col("pbc"))

    if width == {2}:
        value = cell.norm(link(0, 1)).alias("length")
    else:
        value = cell.angle_deg(link(1, 0), link(1, 2)).alias("angle")
    return picked.select("file_ord", "frame_idx", "tuple", value)


def series_stats(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation, max and min of a series."""
    return df.groupBy(*by).agg(
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.max(value).alias("max"),
        F.min(value).alias("min"),
    )


def with_time(
    df: DataFrame, potim: float, unit: str = "ps", offset: float = 0.0,
    step: str = "step", energy: str = "energy",
) -> DataFrame:
    """Time of each step and energy relative to ``offset``."""
    scale = {"fs": 1.0, "ps": 1000.0}[unit]
    return df.withColumns(
        {"time": F.col(step) * F.lit(float(potim)) / F.lit(scale), energy: F.col(energy) - F.lit(offset)}
    )


def filter_time(df: DataFrame, lo: float, hi: float, time: str = "time") -> DataFrame:
    """Closed time interval, ends clipped to the data; an empty interval is an error."""
    end = df.agg(F.max(time)).first()[0]
    lo, hi = max(lo, 0.0), min(hi, end) if end is not None else hi
    if end is None or lo >= hi:
        raise ValueError(f"no data in the time interval [{lo}, {hi}]")
    return df.filter(F.col(time).between(lo, hi))
