"""Derived structures: replication, decoration, perturbed copies. All work stays in the frame row."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cell
from ..functions.binding import let

# Tolerance of the factor search and of the site grid.
DIFF_TOLERANCE = 2.0
MIN_DIFF_RATIO = 0.03
SPREAD_SHARE = 0.1
GRID_TOL = 1e-3


def _numbered(atoms: Column) -> Column:
    return F.transform(atoms, lambda a, i: a.withField("atom_idx", i.cast("int")))


def replicate(frames: DataFrame, a: int | Column, b: int | Column, c: int | Column) -> DataFrame:
    """A x b x c copies of the cell; atoms of a copy stay together."""
    n = [F.lit(v) if isinstance(v, int) else v for v in (a, b, c)]
    m = [F.get("lattice", F.lit(k)) for k in range(9)]

    def steps(k: int) -> Column:
        return F.sequence(F.lit(0), n[k] - 1)

    def shift(i: Column, j: Column, k: Column) -> Column:
        return F.struct(*[(i * m[q] + j * m[3 + q] + k * m[6 + q]).alias(x) for q, x in enumerate("xyz")])

    shifts = F.flatten(
        F.transform(
            steps(0),
            lambda i: F.flatten(F.transform(steps(1), lambda j: F.transform(steps(2), lambda k: shift(i, j, k)))),
        )
    )

    def copied(atoms: Column) -> Column:
        count = F.size(atoms)

        def one(p: Column, s: Column, c: Column) -> Column:
            moved = p.withField("atom_idx", (c * count + p["atom_idx"]).cast("int"))
            for x in "xyz":
                moved = moved.withField(x, p[x] + s[x])
            return moved

        return F.flatten(F.transform(shifts, lambda s, c: F.transform(atoms, lambda p: one(p, s, c))))

    # two steps: a column replaced in the same projection must not be read by the shifts
    return frames.withColumn("atoms", let(F.col("atoms"), copied)).withColumns(
        {
            "natoms": (F.col("natoms") * n[0] * n[1] * n[2]).cast("int"),
            "lattice": F.transform("lattice", lambda v, q: v * F.when(q < 3, n[0]).when(q < 6, n[1]).otherwise(n[2])),
        }
    )


def factors_for_target(frames: DataFrame, target: int, mode: str = "shape") -> DataFrame:
    """Replication factors ``fa, fb, fc`` near a target atom count.

    ``shape``: among counts within the tolerance of the best one, the most cubic
    cell, then the closest count. ``spread``: among counts within 10 % of the
    target, the least deviation of edge lengths; without any, the closest count.
    Factors of equal merit keep the smallest (a, b, c).
    """
    sized = frames.withColumns(dict(zip(("__la", "__lb", "__lc"), cell.cell_lengths(F.col("lattice")))))
    key = ["natoms", "__la", "__lb", "__lc"]
    n = F.col("natoms")
    most = F.greatest(F.lit(1), F.ceil(F.pow(F.lit(float(target)) / n, F.lit(1 / 3)) * 5).cast("int"))
    # frames of equal size and shape share their answer; candidates are folded map-side
    shapes = sized.select(*key).distinct()
    tried = shapes
    for x in "abc":
        tried = tried.withColumn(x, F.explode(F.sequence(F.lit(1), most)))
    edge = [F.col(f"__l{x}") * F.col(x) for x in "abc"]
    if mode == "shape":
        merit = F.greatest(*edge) / F.least(*edge)
    else:
        mean = (edge[0] + edge[1] + edge[2]) / 3
        spread = [(e - mean) * (e - mean) for e in edge]
        # rounded so that equal merits are not told apart by their last bits
        merit = F.round(F.sqrt((spread[0] + spread[1] + spread[2]) / 3), 10)
    tried = tried.select(
        *key, merit.alias("merit"), F.abs(n * F.col("a") * F.col("b") * F.col("c") - target).cast("double").alias("diff"),
        "a", "b", "c",
    )
    closest = tried.groupBy(*key).agg(F.min("diff").alias("closest"))
    judged = tried.join(closest, key)
    if mode == "shape":
        bound = F.greatest(F.col("closest") * DIFF_TOLERANCE, F.lit(target * MIN_DIFF_RATIO))
        rank = F.struct("merit", "diff", "a", "b", "c")
    else:
        bound = F.greatest(F.lit(SPREAD_SHARE * target), F.col("closest"))
        rank = F.struct("merit", "a", "b", "c")
    best = judged.filter(F.col("diff") <= bound).groupBy(*key).agg(F.min(rank).alias("best"))
    small = F.lit(target) < n
    return sized.join(best, key).withColumns(
        {f"f{x}": F.when(small, 1).otherwise(F.col("best")[x]) for x in "abc"}
    ).drop("best", "__la", "__lb", "__lc")


def factors_under_cap(frames: DataFrame, cap: int) -> DataFrame:
    """In-plane factors ``fa, fb`` (``fc`` = 1) of the largest copy count under an atom cap.

    Among divisors the most balanced plane wins; ``note`` tells why nothing is copied.
    """
    n = F.col("natoms")
    k = F.floor(F.lit(cap) / n).cast("int")
    la, lb, _ = cell.cell_lengths(F.col("lattice"))
    divisors = F.filter(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda x: k % x == 0)
    best = F.array_min(
        F.transform(
            divisors,
            lambda x: F.struct(F.abs(F.log((la * x) / (lb * (k / x)))).alias("score"), x.alias("nx")),
        )
    )["nx"]
    single = k <= 1
    return frames.withColumns(
        {
            "fa": F.when(single, 1).otherwise(best),
            "fb": F.when(single, 1).otherwise((k / best).cast("int")),
            "fc": F.lit(1),
            "note": F.when(n >= cap, "at_cap").when(single, "double_exceeds_cap").otherwise(""),
        }
    )


def _uniform(seed: int, *parts: Column) -> Column:
    """Reproducible number in [0, 1) from row keys, independent of partitioning: 52 bits of the MD5 of seed and keys."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def decorate(
    frames: DataFrame,
    element: str,
    substrate: str,
    height: float,
    mode: str = "random",
    coverage: float = 0.5,
    n: int = 0,
    seed: int = 0,
    key: Sequence[str] = ("file_ord", "frame_idx"),
) -> DataFrame:
    """I4: new atoms ``height`` above substrate sites; ``status`` is ok, skip or the reason it failed.

    ``random`` picks ceil(sites * coverage) sites; ``checker`` picks every other
    site of an n x n grid. Frames that already hold the element are skipped.
    """
    sites = F.filter("atoms", lambda a: a["species"] == substrate)
    n_sub = F.size(sites)
    n_add = F.ceil(n_sub * F.lit(float(coverage))).cast("int")
    base = frames.withColumn("inv", cell.cell_inverse(F.col("lattice"))).withColumn("__sites", sites)
    if mode == "random":
        ranked = F.array_sort(
            F.transform(
                "__sites",
                lambda a: F.struct(_uniform(seed, *[F.col(c) for c in key], a["atom_idx"]).alias("u"), a["atom_idx"].alias("i")),
            )
        )
        chosen_idx = F.transform(F.slice(ranked, F.lit(1), F.greatest(n_add, F.lit(0))), lambda e: e["i"])
        chosen = F.filter("__sites", lambda a: F.array_contains(F.col("__idx"), a["atom_idx"]))
        base = base.withColumn("__idx", chosen_idx).withColumn("__pick", chosen).drop("__idx")
        failed = F.lit(None).cast("string")
    elif mode == "checker":

        def slot(a: Column) -> Column:
            f = cell.to_frac([a["x"], a["y"], a["z"]], F.col("inv"))
            g = [cell.wrap(f[q]) * n for q in range(2)]
            r = [F.rint(x) for x in g]
            off = F.greatest(F.abs(g[0] - r[0]), F.abs(g[1] - r[1])) > GRID_TOL
            return F.struct(
                F.pmod(r[0].cast("int"), F.lit(n)).alias("u"), F.pmod(r[1].cast("int"), F.lit(n)).alias("v"),
                off.alias("off"), a.alias("a"),
            )

        base = base.withColumn("__slots", F.transform("__sites", slot))
        uv = F.transform("__slots", lambda s: s["u"] * n + s["v"])
        even = F.filter("__slots", lambda s: (s["u"] + s["v"]) % 2 == 0)
        failed = (
            F.when(n_sub != n * n, "not_square")
            .when(F.exists("__slots", lambda s: s["off"]), "off_grid")
            .when(F.size(F.array_distinct(uv)) < F.size(uv), "shared_site")
            .when(F.size(even) != n_add, "wrong_count")
        )
        base = base.withColumn("__fail", failed).withColumn("__pick", F.transform(even, lambda s: s["a"])).drop("__slots")
        failed = F.col("__fail")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    has = F.exists("atoms", lambda a: a["species"] == element)
    low = F.array_min(F.transform("__pick", lambda a: a["z"]))
    top = F.array_max(F.transform("__sites", lambda a: a["z"]))
    status = (
        F.when(has, "skip")
        .when(F.col("inv").isNull(), "no_cell")
        .when(F.size("__sites") == 0, "no_substrate")
        .when(failed.isNotNull(), failed)
        .when(low + F.lit(float(height)) <= top, "too_low")
        .otherwise("ok")
    )
    null = F.lit(None).cast("double")
    added = F.transform(
        "__pick",
        lambda a: a.withField("species", F.lit(element))
        .withField("z", a["z"] + F.lit(float(height)))
        .withField("fx", null).withField("fy", null).withField("fz", null),
    )
    out = base.withColumn("status", status)
    grown = F.when(F.col("status") == "ok", _numbered(F.concat("atoms", added))).otherwise(F.col("atoms"))
    n_new = F.when(F.col("status") == "ok", F.size("__pick")).otherwise(0)
    return out.withColumns({"added": n_new, "atoms": grown}).withColumn("natoms", F.size("atoms")).drop(
        "inv", "__sites", "__pick", "__fail"
    )


def perturb(
    frames: DataFrame,
    copies: int,
    cell_fraction: float = 0.03,
    distance: float = 0.2,
    style: str = "normal",
    seed: int = 0,
    key: Sequence[str] = ("file_ord", "frame_idx"),
) -> DataFrame:
    """Perturbed copies 1..n with column ``copy``.

    The cell is multiplied by 1 plus a symmetric strain with components uniform
    in +-cell_fraction (off-diagonal halved) and atoms follow it; each atom is
    then moved: ``normal`` with deviation distance per axis / sqrt(3), ``uniform``
    inside a ball of radius distance, ``const`` by exactly distance.
    """
    keys = [F.col(c) for c in key]
    out = frames.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))

    def u(*salt) -> Column:
        return _uniform(seed, *keys, F.col("copy"), *[s if isinstance(s, Column) else F.lit(s) for s in salt])

    e = [(u("strain", q) * 2 - 1) * cell_fraction for q in range(6)]
    strain = F.array(1 + e[0], e[5] / 2, e[4] / 2, e[5] / 2, 1 + e[1], e[3] / 2, e[4] / 2, e[3] / 2, 1 + e[2])
    out = out.withColumn("__t", strain)
    m = [F.get("lattice", F.lit(q)) for q in range(9)]
    lattice = F.array(*[v for r in range(3) for v in cell.row_times(m[3 * r : 3 * r + 3], F.col("__t"))])

    def one(a: Column) -> Column:
        pos = cell.row_times([a["x"], a["y"], a["z"]], F.col("__t"))
        idx = a["atom_idx"]

        def gauss(q: int) -> Column:
            r = F.sqrt(-2 * F.log(1 - u("r", q, idx)))
            return r * F.cos(2 * math.pi * u("phi", q, idx))

        if style == "normal":
            shift = [gauss(q) * (distance / math.sqrt(3)) for q in range(3)]
        elif style in ("uniform", "const"):
            z = u("z", idx) * 2 - 1
            phi = u("phi", idx) * (2 * math.pi)
            radius = F.lit(float(distance))
            if style == "uniform":
                radius = radius * F.pow(u("rad", idx), F.lit(1 / 3))
            flat = F.sqrt(1 - z * z)
            shift = [radius * flat * F.cos(phi), radius * flat * F.sin(phi), radius * z]
        else:
            raise ValueError(f"unknown style {style!r}")
        moved = a
        for c, p, s in zip("xyz", pos, shift):
            moved = moved.withField(c, p + s)
        return moved

    return out.withColumns({"atoms": F.transform("atoms", one), "lattice": lattice}).drop("__t")
