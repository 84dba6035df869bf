"""Bands, level tables and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .running import Ordered

# What counts as a rigid shift between two systems.
SHIFT_MIN, SHIFT_TOL = 0.3, 0.02
_BIN_ROWS = 5000  # of a gap bin in one block
_MAX_TASKS = 20_000  # that pairs of blocks are spread over; a task takes several beyond that


def band_edges(bands: DataFrame, order: Sequence[str] = ("row", "band"), k: str = "k", energy: str = "energy") -> DataFrame:
    """Highest energy below 0 and lowest above 0, with the k of their first occurrence, and the gap."""
    e = F.col(energy)
    pos = F.struct(*order)
    # among equal energies the earlier position wins, so compare (energy, position)
    vbm = F.max(F.when(e < 0, e))
    cbm = F.min(F.when(e > 0, e))
    return (
        bands.filter(e != 0)
        .groupBy((e > 0).alias("above"), e.alias("e"))
        .agg(F.min_by(F.col(k), pos).alias("k"))
        .agg(
            F.max(F.when(~F.col("above"), F.col("e"))).alias("vbm"),
            F.max_by("k", F.when(~F.col("above"), F.col("e"))).alias("vbm_k"),
            F.min(F.when(F.col("above"), F.col("e"))).alias("cbm"),
            F.min_by("k", F.when(F.col("above"), F.col("e"))).alias("cbm_k"),
        )
        .withColumn("gap", F.col("cbm") - F.col("vbm"))
    )


def align_energy(df: DataFrame, ref: float, cols: Sequence[str] = ("energy",)) -> DataFrame:
    """Energies relative to a reference level (Fermi level, common level)."""
    return df.withColumns({c: F.col(c) - F.lit(float(ref)) for c in cols})


def align_mid_gap(bands: DataFrame, **kw) -> DataFrame:
    """Energies shifted so that the middle of the gap is 0; unchanged without a gap."""
    edge = band_edges(bands, **kw).first()
    energy = kw.get("energy", "energy")
    if edge["vbm"] is None or edge["cbm"] is None:
        return bands
    return align_energy(bands, (edge["vbm"] + edge["cbm"]) / 2, [energy])


def level_table(levels: DataFrame) -> DataFrame:
    """Gap per system."""
    return levels.withColumn("gap", F.col("cbm") - F.col("vbm"))


def band_offsets(levels: DataFrame, pairs: DataFrame) -> DataFrame:
    """CBO and VBO of listed system pairs (``a``, ``b``)."""
    la = levels.select(F.col("system").alias("a"), F.col("vbm").alias("va"), F.col("cbm").alias("ca"))
    lb = levels.select(F.col("system").alias("b"), F.col("vbm").alias("vb"), F.col("cbm").alias("cb"))
    return pairs.join(la, "a").join(lb, "b").select(
        "a", "b", F.abs(F.col("cb") - F.col("ca")).alias("cbo"), F.abs(F.col("vb") - F.col("va")).alias("vbo")
    )


def rigid_shift(levels: DataFrame, order: str = "ord") -> DataFrame:
    """Pairs with equal gap and both edges moved alike.

    Two systems can only pair if their gaps differ by less than the tolerance, so gaps are binned and only
    neighbouring bins meet. Every pair of a crowded bin may be a result, so a bin is dealt into blocks; two blocks of
    one bin, or of a bin and the next, meet in a cell, each pair of rows in one. The table is small beside its pairs:
    cells are spread by their number, not by bytes.
    """
    t = level_table(levels).withColumn("bin", F.floor(F.col("gap") / SHIFT_TOL))
    counts = cut(t.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / _BIN_ROWS).cast("int").alias("deals")), "bins")
    beside = [
        counts.select((F.col("bin") - o).alias("bin"), F.col("deals").alias(name)) for o, name in ((1, "above"), (-1, "below"))
    ]
    met = counts.join(beside[0], "bin", "left").join(beside[1], "bin", "left").na.fill(0, ["above", "below"])
    own, above = F.col("deals").cast("long"), F.col("above").cast("long")
    cells = met.where("bin is not null").agg(F.sum(own * (own + 1) / 2 + own * above).cast("long")).first()[0]
    tasks = max(1, min(cells or 1, _MAX_TASKS))
    dealt = t.join(met, "bin").withColumn("block", F.pmod(F.xxhash64(order, "system"), F.col("deals")).cast("int"))

    def blocks(n) -> F.Column:
        return F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: k < n)

    def side(prefix: str, cells: list[F.Column]) -> DataFrame:
        named = [F.col(c).alias(f"{prefix}_{n}") for c, n in (("system", "s"), (order, "o"), ("vbm", "v"), ("cbm", "c"), ("gap", "g"))]
        return dealt.select(F.inline(F.concat(*cells)), *named).repartition(tasks, "lo", "step", "p", "q")

    def cell(lo, step: int, p, q) -> F.Column:
        return F.struct(lo.alias("lo"), F.lit(step).alias("step"), p.alias("p"), q.alias("q"))

    here, at = F.col("bin"), F.col("block")
    left = side("x", [
        F.transform(F.filter(blocks(F.col("deals")), lambda k: k >= at), lambda k: cell(here, 0, at, k)),
        F.transform(blocks(F.col("above")), lambda k: cell(here, 1, at, k)),
    ])
    right = side("y", [
        F.transform(F.filter(blocks(F.col("deals")), lambda k: k <= at), lambda k: cell(here, 0, k, at)),
        F.transform(blocks(F.col("below")), lambda k: cell(here - 1, 1, k, at)),
    ])
    x_first = F.col("x_o") < F.col("y_o")
    # a block meets itself row by row both ways, other blocks meet once
    turned = (F.col("y_o") < F.col("x_o")) & ((F.col("step") == 1) | (F.col("p") != F.col("q")))
    dv, dc, dg = F.col("y_v") - F.col("x_v"), F.col("y_c") - F.col("x_c"), F.col("y_g") - F.col("x_g")
    pairs = left.join(right, ["lo", "step", "p", "q"]).filter(
        (x_first | turned) & (F.abs(dv) > SHIFT_MIN) & (F.abs(dv - dc) < SHIFT_TOL) & (F.abs(dg) < SHIFT_TOL)
    )
    pick = lambda one, two: F.when(x_first, F.col(one)).otherwise(F.col(two))
    return pairs.select(
        pick("x_s", "y_s").alias("a"), pick("y_s", "x_s").alias("b"), F.when(x_first, dv).otherwise(-dv).alias("dv"),
        pick("y_g", "x_g").alias("gap"),
    )


def segment_bands(bands: DataFrame, splits: Sequence[float], k: str = "k", both: bool = True) -> DataFrame:
    """Window of each point between k-splits; boundary points belong to both sides.

    ``both=False`` gives the one-sided variant, where a boundary belongs to the left window.
    """
    s = sorted(splits)
    if not s:
        return bands.withColumn("window", F.lit(0))
    x = F.col(k)
    bounds = F.array(*[F.lit(float(v)) for v in s])
    left = F.size(F.filter(bounds, lambda b: b < x))
    if not both:
        return bands.withColumn("window", left)
    right = F.size(F.filter(bounds, lambda b: b <= x))
    return bands.withColumn("window", F.explode(F.sequence(left, right)))


def segment_table(
    bands: DataFrame, splits: DataFrame, k: str = "k", split: str = "split", by: Sequence[str] = (), both: bool = True, **kw
) -> DataFrame:
    """D14 with the splits as a table: windows between the splits of each group ``by``, as :func:`segment_bands`.

    Points and splits are sorted together once; a point's window is the number of splits before it, a running count
    that is carried over segments where a group is large. A point on splits has a row for each window they bound.
    """
    x = F.col(k).cast("double")
    points = bands.select(*by, x.alias("__x"), F.lit(0).alias("__s"), F.struct(*bands.columns).alias("__row"), F.monotonically_increasing_id().alias("__id"))
    folded = splits.groupBy(*by, F.col(split).cast("double").alias("__x")).agg(F.count(F.lit(1)).alias("__n"))
    cuts = folded.select(
        *by, "__x", F.col("__n").alias("__s"), F.lit(None).cast(points.schema["__row"].dataType).alias("__row"), F.lit(-1).cast("long").alias("__id")
    )
    rows = points.withColumn("__s", F.lit(0).cast("long")).unionByName(cuts)
    # at equal places the split comes after the points: it doesn't count as before them
    o = Ordered(rows, list(by), ["__x", F.col("__id") < 0, "__id"], **kw).running_sum({"__left": F.col("__s")})
    counted = o.result().where("__id >= 0").select(*by, "__x", "__row", F.col("__left").cast("int").alias("__left"))
    if not both:
        return counted.select("__row.*", F.col("__left").alias("window"))
    on = [counted["__x"] == F.col("__at"), *[counted[c].eqNullSafe(F.col(f"__by_{c}")) for c in by]]
    met = counted.join(folded.select(F.col("__x").alias("__at"), "__n", *[F.col(c).alias(f"__by_{c}") for c in by]), on, "left")
    last = F.col("__left") + F.coalesce("__n", F.lit(0)).cast("int")
    return met.select("__row.*", F.explode(F.sequence("__left", last)).alias("window"))


def interval_mean(df: DataFrame, lo: float, hi: float, x: str = "z", y: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """Mean over a closed interval, NULL if nothing lies in it."""
    return df.groupBy(*by).agg(F.avg(F.when(F.col(x).between(lo, hi), F.col(y))).alias("mean"))


def segments(df: DataFrame, marker, by: Sequence[str] = (), order: Sequence[str] = ("row_no",), **kw) -> DataFrame:
    """rows between markers carry a segment id; markers themselves are left out."""
    o = Ordered(df.withColumn("__m", marker), by, order, **kw).running_sum({"segment": F.col("__m").cast("long")})
    return o.result().filter(~F.col("__m")).drop("__m")
