"""Composition filters, routing, validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cell, text as tx
from .pairs import too_close

FRAME = ("file_ord", "frame_idx")


def elements_of(atoms: Column) -> Column:
    """Sorted distinct species of a frame."""
    return F.array_sort(F.array_distinct(F.transform(atoms, lambda a: a["species"])))


def element_sets(atoms: DataFrame, frame: Sequence[str] = FRAME) -> DataFrame:
    """``natoms`` and ``elements`` per frame from long form (the set is bounded by the species)."""
    return atoms.groupBy(*frame).agg(
        F.count(F.lit(1)).alias("natoms"), F.array_sort(F.collect_set("species")).alias("elements")
    )


def _lits(names: Sequence[str]) -> Column:
    return F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")


def only(elements: Column, target: Sequence[str]) -> Column:
    """Exactly the target elements (``elements`` sorted and distinct)."""
    return elements == _lits(sorted(set(target)))


def at_least(elements: Column, target: Sequence[str]) -> Column:
    """All target elements, perhaps more."""
    return F.size(F.array_except(_lits(list(target)), elements)) == 0


def filter_elements(frames: DataFrame, target: Sequence[str], mode: str = "only") -> DataFrame:
    """C1/C2 on frame rows or on :func:`element_sets`."""
    els = F.col("elements") if "elements" in frames.columns else elements_of(F.col("atoms"))
    return frames.filter({"only": only, "at_least": at_least}[mode](els, target))


def match_group(elements: Column, groups: Sequence[Sequence[str]], mode: str | Sequence[str] = "only") -> Column:
    """Name of the first matching group, else NULL; an empty group is named ``any`` and takes all."""
    modes = [mode] * len(groups) if isinstance(mode, str) else list(mode)
    chain = None
    for g, m in zip(groups, modes, strict=True):
        test = {"only": only, "at_least": at_least}[m]
        cond, name = (test(elements, g), F.lit("".join(g))) if g else (F.lit(True), F.lit("any"))
        chain = F.when(cond, name) if chain is None else chain.when(cond, name)
    return chain


def drop_reason(elements: Column, groups: Sequence[Sequence[str]], mode: str = "only") -> Column:
    """C4: ``extra:X,Y`` for foreign elements, else ``missing:X`` (sorted names)."""
    union = sorted({e for g in groups for e in g})
    missing = F.concat(F.lit("missing:"), F.array_join(F.array_sort(F.array_except(_lits(union), elements)), ","))
    if mode == "at_least" and len(groups) == 1:
        return missing
    extra = F.array_sort(F.array_except(elements, _lits(union)))
    return F.when(F.size(extra) > 0, F.concat(F.lit("extra:"), F.array_join(extra, ","))).otherwise(missing)


def route(
    frames: DataFrame,
    groups: Sequence[Sequence[str]],
    mode: str | Sequence[str] = "only",
    max_atoms: int = 0,
    min_distance: float = 0.0,
) -> DataFrame:
    """``grp`` of each frame or the ``reason`` it is dropped.

    ``mode`` holds for all groups or names one for each; an empty group takes every frame,
    so geometry alone decides. The atom limit comes before geometry. With ``min_distance``
    frames with closer atoms are ``too_close``, and ``too_close`` is NULL where a frame has no cell to tell.
    """
    els = F.col("elements") if "elements" in frames.columns else elements_of(F.col("atoms"))
    grp = match_group(els, groups, mode)
    over = F.lit(max_atoms > 0) & (F.col("natoms") > max_atoms)
    foreign = drop_reason(els, groups, mode if isinstance(mode, str) else "only")
    reason = F.when(grp.isNull(), foreign).when(over, "too_many_atoms")
    if not min_distance:
        return frames.withColumns({"grp": F.when(~over, grp), "reason": reason})
    judged = frames.withColumns({"grp": grp, "reason": reason})
    passed = with_closeness(judged.filter(F.col("reason").isNull()), min_distance)
    rest = judged.filter(F.col("reason").isNotNull()).withColumn("too_close", F.lit(None).cast("boolean"))
    near = F.coalesce(F.col("too_close"), F.lit(False))
    out = passed.withColumn("reason", F.when(near, "too_close")).unionByName(rest)
    return out.withColumn("grp", F.when(F.col("reason").isNull(), F.col("grp")))


def filter_natoms(frames: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` atoms; 0 switches the check off."""
    return frames.filter(F.col("natoms") <= limit) if limit > 0 else frames


_IN_ROW = 100_000  # up to this many atoms a frame is measured where it lies, without a shuffle


def with_closeness(frames: DataFrame, limit: float) -> DataFrame:
    """``too_close`` of each frame: two atoms nearer than ``limit``; NULL for frames without a cell.

    A frame is measured up to the limit only, by a cell list inside its row.
    """
    from ..sources.frames import atoms_view
    from .kernel import with_closest
    from .pairs import DISTANCE_SLACK

    small = F.col("natoms") <= _IN_ROW
    measured = with_closest(frames.filter(small & F.col("lattice").isNotNull()), limit, "__d")
    fine = measured.withColumn("too_close", F.coalesce(F.col("__d") < limit - DISTANCE_SLACK, F.lit(False))).drop("__d")
    unknown = frames.filter(F.col("lattice").isNull()).withColumn("too_close", F.lit(None).cast("boolean"))
    big = frames.filter(~small & F.col("lattice").isNotNull())
    bad = too_close(atoms_view(big), limit).select(*FRAME).distinct().withColumn("too_close", F.lit(True))
    far = big.join(bad, list(FRAME), "left").withColumn("too_close", F.coalesce("too_close", F.lit(False)))
    return fine.unionByName(unknown).unionByName(far.select(*fine.columns))


def filter_min_distance(frames: DataFrame, limit: float) -> DataFrame:
    """Frames whose shortest distance is at least ``limit``; frames without a cell are kept."""
    return with_closeness(frames, limit).filter(~F.coalesce("too_close", F.lit(False))).drop("too_close")


def reason_counts(df: DataFrame, col: str = "reason") -> DataFrame:
    """Frames per reason or status."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("frames"))


def require_cell(frames: DataFrame) -> DataFrame:
    """C11: frames with a lattice of non-zero volume."""
    return frames.filter(cell.cell_volume(F.col("lattice")) > cell.SINGULAR)


def drop_sentinel(df: DataFrame, values: str = "values", width: int = 12) -> DataFrame:
    """Rows where none of the first ``width`` values marks missing data."""
    from ..functions.units import SENTINEL

    return df.filter(~F.exists(F.slice(values, 1, width), lambda v: F.abs(v) >= SENTINEL))


def search(
    table: DataFrame,
    contains: Sequence[str] = (),
    n_elements: int | None = None,
    ranges: dict[str, tuple[float, float]] | None = None,
    blacklist: Sequence[str] = (),
    elements: str = "elements",
) -> DataFrame:
    """Contains all, exact number of elements, closed ranges, none of the blacklist."""
    e = F.col(elements)
    cond = at_least(e, contains) if contains else F.lit(True)
    if n_elements is not None:
        cond = cond & (F.size(F.array_distinct(e)) == n_elements)
    for col, (lo, hi) in (ranges or {}).items():
        cond = cond & F.col(col).between(lo, hi)
    if blacklist:
        cond = cond & ~F.arrays_overlap(e, _lits(list(blacklist)))
    return table.filter(cond)


def field_count_reason(lines: Column, properties: Column) -> Column:
    """C14: reason of the first atom line whose field count differs from the layout, else NULL."""
    want = tx.n_fields(properties)
    sizes = F.transform(lines, lambda t: F.size(F.split(F.trim(t), r"\s+")))
    wrong = F.get(F.filter(sizes, lambda n: n != want), F.lit(0))
    return F.when(
        wrong.isNotNull(), F.concat(F.lit("fields:"), wrong.cast("string"), F.lit("!="), want.cast("string"))
    )


def check_species(atoms: DataFrame, allowed: Sequence[str], frame: Sequence[str] = FRAME) -> DataFrame:
    """Species outside the allowed list, with the atoms and frames they occur in (all frames)."""
    outside = atoms.filter(~F.col("species").isin(list(allowed)))
    per_frame = outside.groupBy("species", *frame).agg(F.count(F.lit(1)).alias("n"))
    return per_frame.groupBy("species").agg(F.sum("n").alias("atoms"), F.count(F.lit(1)).alias("frames"))


def aligned_counts(**tables: DataFrame) -> DataFrame:
    """Rows of each named table and whether all tables have as many: ``name, rows, agrees``."""
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    span = counts.agg(F.min("rows").alias("lo"), F.max("rows").alias("hi"))  # one row
    return counts.join(F.broadcast(span)).select("name", "rows", (F.col("lo") == F.col("hi")).alias("agrees"))


def assert_aligned(**counts: int) -> None:
    """Named row counts must agree."""
    if len(set(counts.values())) > 1:
        raise ValueError(f"row counts differ: {counts}")


def path_images(df: DataFrame, col: str = "index") -> DataFrame:
    """C17: rows whose index is an integer within rounding."""
    x = F.col(col)
    return df.filter(F.abs(x - F.rint(x)) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(F.rint(x)))
