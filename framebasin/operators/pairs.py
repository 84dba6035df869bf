"""Distances inside frames: neighbours, shortest distances, RDF, bonds and angles.

Atoms come in long form (one row per atom). Minima and histograms of frames up to
``PACKED_FRAME`` atoms are taken inside the task that packs the frame (``kernel``);
only they are shuffled. Where pairs themselves are asked for, atoms of a small frame
share one bin; atoms of a larger frame are binned on a grid as wide as the cutoff, so
only atoms of neighbouring bins meet and a hot frame spreads over many keys.
Statistics that need every distance of a very large frame run on bounded tiles of
atoms and emit histogram counts, never pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cell
from ..functions.elements import atomic_rank
from ..session import cut
from . import kernel

FRAME = ("file_ord", "frame_idx")
SMALL_FRAME = 256
PACKED_FRAME = 4096
TILE = 512
# Fixed value: slack of the shortest-distance filter.
DISTANCE_SLACK = 1e-9


def with_size(atoms: DataFrame, frame: Sequence[str] = FRAME) -> DataFrame:
    """Add ``natoms`` per atom row where the source did not provide it."""
    if "natoms" in atoms.columns:
        return atoms
    sizes = atoms.groupBy(*frame).agg(F.count(F.lit(1)).alias("natoms"))
    return atoms.join(sizes, list(frame))


def _binned(atoms: DataFrame, cutoff: float, frame: Sequence[str], small: int) -> DataFrame:
    atoms = with_size(atoms, frame)
    tiny = F.col("natoms") <= small
    xyz = [F.col(c) for c in "xyz"]
    zero = F.lit(0).cast("long")
    if "lattice" not in atoms.columns:
        bins = [F.when(tiny, zero).otherwise(F.floor(c / cutoff)) for c in xyz]
        wide = [F.lit(None).cast("long")] * 3
    else:
        atoms = atoms.withColumn("inv", cell.cell_inverse(F.col("lattice")))
        on = F.col("inv").isNotNull() & F.exists("pbc", lambda p: p)
        frac = cell.to_frac(xyz, F.col("inv"))
        heights = cell.axis_heights(F.col("lattice"))
        bins, wide = [], []
        for k in range(3):
            axis = on & F.get("pbc", F.lit(k))
            n = F.greatest(F.floor(heights[k] / cutoff), F.lit(1)).cast("long")
            wide.append(F.when(axis & ~tiny, n))
            bins.append(
                F.when(tiny, zero)
                .when(axis, F.pmod(F.floor(frac[k] * n), n))
                .when(on, F.floor(frac[k] * heights[k] / cutoff))
                .otherwise(F.floor(xyz[k] / cutoff))
            )
    return atoms.withColumns(
        {
            **{f"b{k}": b.cast("long") for k, b in enumerate(bins)},
            **{f"n{k}": w for k, w in enumerate(wide)},
        }
    )


def _reach(k: int, tiny: Column) -> Column:
    """Bins an atom of axis bin ``b<k>`` can meet."""
    around = F.array(*[F.col(f"b{k}") + o for o in (-1, 0, 1)])
    folded = F.array_distinct(F.transform(around, lambda b: F.pmod(b, F.col(f"n{k}"))))
    return (
        F.when(tiny, F.array(F.col(f"b{k}")))
        .when(F.col(f"n{k}").isNotNull(), folded)
        .otherwise(around)
    )


def close_pairs(
    atoms: DataFrame,
    cutoff: float | None,
    frame: Sequence[str] = FRAME,
    centre: str | None = None,
    other: str | None = None,
    small: int = SMALL_FRAME,
) -> DataFrame:
    """Pairs of one frame no further apart than ``cutoff``.

    Without species each unordered pair comes once, ``i < j``. With ``centre``
    and ``other`` the pairs are directed, centre first. ``cutoff=None`` is for
    small frames only and gives all their pairs. Columns: the frame key,
    ``i, j, si, sj, d`` and the displacement ``vx, vy, vz`` from i to j.
    """
    binned = _binned(atoms, cutoff or 1.0, frame, small)
    periodic = "lattice" in binned.columns
    tiny = F.col("natoms") <= small
    reach = F.flatten(
        F.transform(
            _reach(0, tiny),
            lambda p: F.flatten(
                F.transform(
                    _reach(1, tiny),
                    lambda q: F.transform(
                        _reach(2, tiny), lambda r: F.struct(p.alias("b0"), q.alias("b1"), r.alias("b2"))
                    ),
                )
            ),
        )
    )
    extra = ["lattice", "inv", "pbc"] if periodic else []
    left_rows = binned if centre is None else binned.filter(F.col("species") == centre)
    right_rows = binned if other is None else binned.filter(F.col("species") == other)
    left = left_rows.select(
        *frame,
        F.col("atom_idx").alias("i"),
        F.col("species").alias("si"),
        *[F.col(c).alias(f"{c}1") for c in "xyz"],
        *extra,
        F.inline(reach),
    )
    right = right_rows.select(
        *frame,
        F.col("atom_idx").alias("j"),
        F.col("species").alias("sj"),
        *[F.col(c).alias(f"{c}2") for c in "xyz"],
        "b0",
        "b1",
        "b2",
    )
    met = left.join(right, [*frame, "b0", "b1", "b2"]).filter(
        F.col("i") < F.col("j") if centre is None else F.col("i") != F.col("j")
    )
    dr = [F.col(f"{c}2") - F.col(f"{c}1") for c in "xyz"]
    v = cell.min_image(dr, F.col("lattice"), F.col("inv"), F.col("pbc")) if periodic else dr
    out = met.select(*frame, "i", "j", "si", "sj", *[c.alias(n) for c, n in zip(v, ("vx", "vy", "vz"))])
    out = out.withColumn("d", cell.norm([F.col("vx"), F.col("vy"), F.col("vz")]))
    return out if cutoff is None else out.filter(F.col("d") <= cutoff)


def neighbours(
    atoms: DataFrame, centre: str, other: str, rcut: float, frame: Sequence[str] = FRAME, **kw
) -> DataFrame:
    """Neighbours of each centre strictly closer than ``rcut``."""
    return close_pairs(atoms, rcut, frame, centre, other, **kw).filter(F.col("d") < rcut)


def angles(nbr: DataFrame, frame: Sequence[str] = FRAME) -> DataFrame:
    """Angle at a centre for every two of its neighbours, each pair once."""
    key = [*frame, "i"]
    a = nbr.select(*key, F.col("j").alias("ja"), *[F.col(c).alias(f"{c}a") for c in ("vx", "vy", "vz")])
    b = nbr.select(*key, F.col("j").alias("jb"), *[F.col(c).alias(f"{c}b") for c in ("vx", "vy", "vz")])
    pairs = a.join(b, key).filter(F.col("ja") < F.col("jb"))
    angle = cell.angle_deg(*[[F.col(f"{c}{s}") for c in ("vx", "vy", "vz")] for s in "ab"])
    return pairs.select(*key, "ja", "jb", angle.alias("angle"))


def _describe(df: DataFrame, value: str, kind: str) -> DataFrame:
    """Count, mean and sample deviation (0 for a single value)."""
    return df.agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.when(F.count(value) == 1, 0.0).otherwise(F.stddev_samp(value)).alias("std"),
    ).select(F.lit(kind).alias("kind"), "n", "mean", "std")


def bond_angle_stats(
    atoms: DataFrame, e1: str, e2: str, rcut: float, frame: Sequence[str] = FRAME, **kw
) -> DataFrame:
    """Bond e1-e2, angle e1-e2-e1 (centre e2) and angle e2-e1-e2 (centre e1)."""
    at2 = neighbours(atoms, e2, e1, rcut, frame, **kw)
    at1 = neighbours(atoms, e1, e2, rcut, frame, **kw)
    return (
        _describe(at2, "d", f"{e1}-{e2}")
        .unionByName(_describe(angles(at2, frame), "angle", f"{e1}-{e2}-{e1}"))
        .unionByName(_describe(angles(at1, frame), "angle", f"{e2}-{e1}-{e2}"))
    )


# -- shortest distances --------------------------------------------------------


def _ordered_pair(si: Column, sj: Column) -> tuple[Column, Column]:
    ki, kj = F.struct(atomic_rank(si), si), F.struct(atomic_rank(sj), sj)
    return F.when(ki <= kj, si).otherwise(sj), F.when(ki <= kj, sj).otherwise(si)


def _shortest(pairs: DataFrame, frame: Sequence[str]) -> DataFrame:
    """Shortest distance and first frame per species pair.

    Plain minima per frame first: they fold all pairs of a frame by hashing, and
    only one row per frame and species pair reaches the ordered comparison.
    """
    per_frame = pairs.groupBy(*frame, "si", "sj").agg(F.min("d").alias("d"))
    a, b = _ordered_pair(F.col("si"), F.col("sj"))
    first = F.min(F.struct("d", *frame)).alias("m")
    return per_frame.groupBy(a.alias("sa"), b.alias("sb")).agg(first).select("sa", "sb", "m.*")


def _sites(atoms: DataFrame, frame: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct sites (frame, species, position), and the distance 0 of atoms sharing one.

    Any number of atoms on one spot folds map-side into a single site, so they
    are never paired with each other.
    """
    keep = [c for c in ("natoms", "lattice", "pbc") if c in atoms.columns]
    sites = atoms.groupBy(*frame, "species", "x", "y", "z").agg(
        F.min("atom_idx").alias("atom_idx"),
        F.count(F.lit(1)).alias("__c"),
        *[F.any_value(c).alias(c) for c in keep],
    )
    shared = sites.filter(F.col("__c") > 1).select(
        *frame, F.col("species").alias("si"), F.col("species").alias("sj"), F.lit(0.0).alias("d")
    )
    return sites.drop("__c"), shared


def _site_pairs(atoms: DataFrame, cutoff: float, frame: Sequence[str], small: int) -> DataFrame:
    sites, shared = _sites(atoms, frame)
    pairs = close_pairs(sites, cutoff, frame, small=small).select(*frame, "si", "sj", "d")
    return pairs.unionByName(shared)


def _spacing(atoms: DataFrame, frame: Sequence[str]) -> float:
    """Smallest mean spacing over the frames: with bins this wide a bin holds about one atom.

    Axes without extent (chains, planes) do not count; a frame on one spot has no spacing.
    """
    spans = [F.max(c) - F.min(c) for c in "xyz"]
    extent, axes = F.lit(1.0), F.lit(0)
    for s in spans:
        extent = extent * F.when(s > 0, s).otherwise(1.0)
        axes = axes + F.when(s > 0, 1).otherwise(0)
    per_frame = atoms.groupBy(*frame).agg(
        F.when(axes > 0, F.pow(extent / F.count(F.lit(1)), 1 / axes)).alias("s")
    )
    return max(per_frame.agg(F.min("s")).first()[0] or 1.0, 1e-6)


def pair_min_distance(
    atoms: DataFrame, frame: Sequence[str] = FRAME, small: int = PACKED_FRAME
) -> DataFrame:
    """Shortest distance per species pair over the corpus, with the first frame attaining it.

    Frames up to ``small`` atoms are measured whole, a few minima for each batch of frames leave the task. Larger
    frames are searched with a radius that starts at their atom spacing and doubles, up to what is already known from the small frames. A distance
    found within the radius is the exact minimum, so no frame is searched wider
    than its closest atoms require.
    """
    atoms = with_size(atoms, frame)
    frames = cut(kernel.packed(atoms, frame, small), "packed")
    best = _shortest(kernel.shortest(frames.where(F.col("natoms") <= small), frame), frame)
    if frames.where(F.col("natoms") > small).isEmpty():
        return best
    big = atoms.filter(F.col("natoms") > small)
    small = min(small, SMALL_FRAME)
    spark = atoms.sparkSession
    # results per species pair: a few thousand rows at most
    found = {(r["sa"], r["sb"]): tuple(r) for r in best.collect()}
    counts = big.groupBy(*frame, "species").agg(F.count(F.lit(1)).alias("c"))
    sides = counts.withColumnsRenamed({"species": "si", "c": "ci"}).join(
        counts.withColumnsRenamed({"species": "sj", "c": "cj"}), list(frame)
    )
    a, b = _ordered_pair(F.col("si"), F.col("sj"))
    open_pairs = {
        (r["sa"], r["sb"])
        for r in sides.filter((F.col("si") != F.col("sj")) | (F.col("ci") > 1))
        .select(a.alias("sa"), b.alias("sb"))
        .distinct()
        .collect()
    }
    radius = _spacing(big, frame)
    while open_pairs:
        bound = max(found[p][2] if p in found else float("inf") for p in open_pairs)
        reach = min(radius, max(bound, 1e-6))
        species = sorted({s for p in open_pairs for s in p})
        near = _site_pairs(big.filter(F.col("species").isin(species)), reach, frame, small)
        for r in _shortest(near, frame).collect():
            p = (r["sa"], r["sb"])
            if p not in found or tuple(r)[2:] < found[p][2:]:
                found[p] = tuple(r)
        open_pairs -= {p for p in open_pairs if p in found and found[p][2] <= reach}
        radius *= 2
    return spark.createDataFrame(list(found.values()), best.schema)


def pair_grid(atoms: DataFrame, frame: Sequence[str] = FRAME, **kw) -> DataFrame:
    """E5: every pair of the species union, NULL where no such pair was seen."""
    # species of a corpus: bounded by the number of elements
    names = [r[0] for r in atoms.select("species").distinct().collect()]
    spark = atoms.sparkSession
    pairs = spark.createDataFrame(
        list(itertools.combinations_with_replacement(sorted(names), 2)), "si string, sj string"
    )
    a, b = _ordered_pair(F.col("si"), F.col("sj"))
    grid = pairs.select(a.alias("sa"), b.alias("sb"))
    return grid.join(pair_min_distance(atoms, frame, **kw), ["sa", "sb"], "left")


def too_close(atoms: DataFrame, limit: float, frame: Sequence[str] = FRAME, **kw) -> DataFrame:
    """Frames with a pair closer than ``limit`` (with slack), and their shortest distance."""
    near = _site_pairs(with_size(atoms, frame), limit, frame, kw.get("small", SMALL_FRAME))
    near = near.filter(F.col("d") < limit - DISTANCE_SLACK)
    return near.groupBy(*frame).agg(F.min("d").alias("dmin"))


# -- radial distribution ---------------------------------------------------------


def _bin_index(d: Column, dr: float) -> Column:
    """Largest b with b*dr <= d, corrected for rounding in the division."""
    b = F.floor(d / dr)
    return F.when(d < b * dr, b - 1).when(d >= (b + 1) * dr, b + 1).otherwise(b)


_HIST = "si string, sj string, bin long, n long, on_edge long, dmax double"


def _tile_histogram(dr: float):
    def count(side_a, side_b, same, lattice, pbc, species, out):
        ia, sa, xa = side_a
        ib, sb, xb = side_b
        dv = xb[None, :, :] - xa[:, None, :]
        if lattice is not None:
            cellm = np.array(lattice, dtype=float).reshape(3, 3)
            flags = np.array(pbc, dtype=bool)
            if abs(np.linalg.det(cellm)) >= cell.SINGULAR and flags.any():
                fr = dv @ np.linalg.inv(cellm)
                fr[..., flags] -= np.rint(fr[..., flags])
                dv = fr @ cellm
        d = np.sqrt((dv * dv).sum(-1))
        take = np.triu(np.ones(d.shape, bool), 1) if same else np.ones(d.shape, bool)
        lo, hi = np.minimum(sa[:, None], sb[None, :]), np.maximum(sa[:, None], sb[None, :])
        d, code = d[take], (lo * len(species) + hi)[take]
        b = np.floor(d / dr).astype(np.int64)
        b = b - (d < b * dr) + (d >= (b + 1) * dr)
        for c in np.unique(code):
            m = code == c
            bins, where = np.unique(b[m], return_inverse=True)
            n = np.bincount(where)
            edge = np.bincount(where, weights=(d[m] == b[m] * dr)).astype(np.int64)
            top = np.full(len(bins), -np.inf)
            np.maximum.at(top, where, d[m])
            out.append(
                pd.DataFrame(
                    {"si": species[c // len(species)], "sj": species[c % len(species)], "bin": bins,
                     "n": n, "on_edge": edge, "dmax": top}
                )
            )

    def run(batches):
        for pdf in batches:
            out: list[pd.DataFrame] = []
            for row in pdf.itertuples(index=False):
                names = sorted({r["species"] for r in row.a} | {r["species"] for r in row.b})
                code = {s: k for k, s in enumerate(names)}

                def side(rows):
                    return (
                        np.array([r["atom_idx"] for r in rows]),
                        np.array([code[r["species"]] for r in rows]),
                        np.array([[r["x"], r["y"], r["z"]] for r in rows], dtype=float),
                    )

                lattice = getattr(row, "lattice", None)
                count(side(row.a), side(row.b), row.ta == row.tb, lattice, getattr(row, "pbc", None), names, out)
            if out:
                yield pd.concat(out).groupby(["si", "sj", "bin"], as_index=False).agg(
                    {"n": "sum", "on_edge": "sum", "dmax": "max"}
                )

    return run


def _tiled_histogram(atoms: DataFrame, dr: float, frame: Sequence[str], tile: int) -> DataFrame:
    """Histogram over all distances of large frames, from pairs of atom tiles."""
    cellcols = [c for c in ("lattice", "pbc") if c in atoms.columns]
    tiles = F.ceil(F.col("natoms") / tile).cast("int")
    t = F.pmod(F.xxhash64("atom_idx"), tiles).cast("int")
    packed = (
        atoms.withColumns({"nt": tiles, "t": t})
        .groupBy(*frame, "nt", "t")
        .agg(
            F.collect_list(F.struct("atom_idx", "species", "x", "y", "z")).alias("rows"),
            *[F.any_value(c).alias(c) for c in cellcols],
        )
    )
    a = packed.select(
        *frame, *cellcols, F.col("t").alias("ta"), F.col("rows").alias("a"),
        F.explode(F.sequence("t", F.col("nt") - 1)).alias("tb"),
    )
    b = packed.select(*frame, F.col("t").alias("tb"), F.col("rows").alias("b"))
    return (
        a.join(b, [*frame, "tb"])
        .select("ta", "tb", *cellcols, "a", "b")
        .mapInPandas(_tile_histogram(dr), _HIST)
    )


def distance_histogram(
    atoms: DataFrame,
    dr: float,
    rmax: float | None = None,
    frame: Sequence[str] = FRAME,
    small: int = PACKED_FRAME,
    tile: int = TILE,
    frames: DataFrame | None = None,
) -> DataFrame:
    """Counts of pair distances per species pair and bin of width ``dr``: ``sa, sb, bin, n, on_edge, dmax``.

    With ``rmax`` only pairs up to it are looked for; without it every distance counts. ``frames`` are the atoms'
    packed frames where they are already written.
    """
    atoms = with_size(atoms, frame)
    if frames is None:
        frames = cut(kernel.packed(atoms, frame, small), "packed")

    def binned(pairs: DataFrame) -> DataFrame:
        b = _bin_index(F.col("d"), dr)
        return pairs.select(
            F.least("si", "sj").alias("si"),
            F.greatest("si", "sj").alias("sj"),
            b.alias("bin"),
            F.lit(1).cast("long").alias("n"),
            (F.col("d") == b * dr).cast("long").alias("on_edge"),
            F.col("d").alias("dmax"),
        )

    parts = kernel.histogram(frames.where(F.col("natoms") <= small), dr, rmax)
    if not frames.where(F.col("natoms") > small).isEmpty():
        big = atoms.filter(F.col("natoms") > small)
        if rmax is None:
            parts = parts.unionByName(_tiled_histogram(big, dr, frame, tile))
        else:
            parts = parts.unionByName(binned(close_pairs(big, rmax, frame, small=min(small, SMALL_FRAME))))
    a, b = _ordered_pair(F.col("si"), F.col("sj"))
    return parts.groupBy(a.alias("sa"), b.alias("sb"), "bin").agg(
        F.sum("n").alias("n"), F.sum("on_edge").alias("on_edge"), F.max("dmax").alias("dmax")
    )


def rdf_all(
    atoms: DataFrame,
    dr: float = 0.05,
    volume: float | None = None,
    rmax: float | None = None,
    frame: Sequence[str] = FRAME,
    only: Sequence[str] | None = None,
    small: int = PACKED_FRAME,
    **kw,
) -> DataFrame:
    """g(r) of every pair of different species: ``sa, sb, bin, r, n, g``.

    Shells are evaluated at their right edge; the last bin is closed and
    distances beyond it are dropped. The mean cell volume is used unless given.
    All frames count for the mean, whatever species they hold; ``only`` names the species that are paired.
    """
    atoms = with_size(atoms, frame)
    packed = cut(kernel.packed(atoms, frame, small, only), "packed")
    v = F.lit(float(volume)) if volume is not None else cell.cell_volume(F.col("lattice")) if "lattice" in atoms.columns else F.lit(None)
    frames, total_volume, largest = packed.agg(F.count(F.lit(1)), F.sum(v.cast("double")), F.max("natoms")).first()
    mean_volume = (total_volume or 0.0) / max(frames, 1)
    if only is not None:
        atoms = atoms.filter(F.col("species").isin(*only))
    counts = packed.select(F.explode("rows").alias("r")).groupBy(F.col("r.species").alias("species")).agg(F.count(F.lit(1)).alias("atoms"))
    if largest is not None and largest > small:
        counts = counts.union(atoms.where(F.col("natoms") > small).groupBy("species").count())
    totals = counts.groupBy("species").agg(F.sum("atoms").alias("atoms")).collect()  # one row per species
    kw |= {"frames": packed, "small": small}
    # a few rows per species pair and bin, used twice below: written once
    hist = cut(distance_histogram(atoms, dr, rmax, frame, **kw).filter(F.col("sa") != F.col("sb")), "histogram")
    pair = Window.partitionBy("sa", "sb")  # bins of one species pair: bounded by r/dr
    last = F.floor(F.max("dmax").over(pair) / dr)
    edge_extra = F.sum(F.when(F.col("bin") == last, F.col("on_edge"))).over(pair)
    seen = hist.select("sa", "sb", "bin", "n", last.alias("last"), edge_extra.alias("extra"))
    dense = (
        seen.groupBy("sa", "sb")
        .agg(F.max("last").alias("last"), F.max("extra").alias("extra"))
        .filter("last > 0")
        .select("sa", "sb", "last", "extra", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last") - 1)).alias("bin"))
    )
    filled = dense.join(seen.select("sa", "sb", "bin", "n"), ["sa", "sb", "bin"], "left").select(
        "sa", "sb", "bin",
        (F.coalesce("n", F.lit(0)) + F.when(F.col("bin") == F.col("last") - 1, F.coalesce("extra", F.lit(0))).otherwise(0)).alias("n"),
    )
    table = atoms.sparkSession.createDataFrame(
        [(r["species"], r["atoms"]) for r in totals], "species string, atoms long"
    )
    r = (F.col("bin") + 1) * F.lit(dr)
    return (
        filled.join(table.select(F.col("species").alias("sa"), F.col("atoms").alias("na")), "sa")
        .join(table.select(F.col("species").alias("sb"), F.col("atoms").alias("nb")), "sb")
        .select(
            "sa", "sb", "bin", r.alias("r"), "n",
            (
                F.col("n")
                / (4 * np.pi * r * r * F.lit(dr) * (F.col("nb") / F.lit(float(frames)) / F.lit(mean_volume)) * F.col("na"))
            ).alias("g"),
            F.lit(frames).alias("frames"),
            "na",
        )
    )


def rdf(atoms: DataFrame, a: str, b: str, dr: float = 0.05, frames=None, **kw) -> DataFrame:
    """g(r) of one species pair, optionally over frames ``[lo, hi)``; frames without the pair count too."""
    picked = atoms
    if frames is not None:
        lo, hi = frames
        picked = picked.filter((F.col("frame_idx") >= lo) & (F.col("frame_idx") < hi))
    return rdf_all(picked, dr, only=(a, b), **kw)


def first_minimum(g: DataFrame, window: int = 2) -> DataFrame:
    """Radius where g(r), smoothed by a centred moving average, first rises after its peak."""
    pair = Window.partitionBy("sa", "sb").orderBy("bin")  # bins of one pair: bounded by r/dr
    whole = Window.partitionBy("sa", "sb")
    smooth = g.withColumn("s", F.avg("g").over(pair.rowsBetween(-window, window)))
    peak = F.min(F.when(F.col("s") == F.col("top"), F.col("bin"))).over(whole)
    ranked = smooth.withColumn("top", F.max("s").over(whole)).withColumn("peak", peak)
    rising = ranked.withColumn("up", F.lead("s").over(pair) > F.col("s"))
    return (
        rising.filter(F.col("up") & (F.col("bin") > F.col("peak")))
        .groupBy("sa", "sb")
        .agg(F.min("r").alias("rcut"))
    )


def coordination_from_rdf(g: DataFrame, rcut: float) -> DataFrame:
    """Mean coordination from the histogram (bins whose right edge is within ``rcut``)."""
    return g.filter(F.col("r") <= rcut).groupBy("sa", "sb").agg(
        (F.sum("n") / F.max("frames") / (F.max("na") / F.max("frames"))).alias("cn")
    )


def bond_length_from_rdf(g: DataFrame, rcut: float, dr: float = 0.05) -> DataFrame:
    """G-weighted mean of bin centres, up to and with the bin that holds ``rcut``."""
    used = F.col("r") - F.lit(dr) < rcut
    return g.filter(used).groupBy("sa", "sb").agg(
        (F.sum((F.col("r") - F.lit(dr / 2)) * F.col("g")) / F.sum("g")).alias("length")
    )


def coordination(
    atoms: DataFrame, a: str, b: str, rcut: float, frame: Sequence[str] = FRAME, **kw
) -> DataFrame:
    """E15/E16 per frame: neighbours b per atom a, and mean bond length, for ``d < rcut``.

    Frames without a bond have coordination 0 and no bond length.
    """
    centres = (
        atoms.filter(F.col("species") == a).groupBy(*frame).agg(F.count(F.lit(1)).alias("na"))
    )
    bonds = (
        neighbours(atoms, a, b, rcut, frame, **kw)
        .groupBy(*frame)
        .agg(F.count(F.lit(1)).alias("bonds"), F.avg("d").alias("length"))
    )
    return centres.join(bonds, list(frame), "left").select(
        *frame, (F.coalesce("bonds", F.lit(0)) / F.col("na")).alias("cn"), "length"
    )
