"""Labels and metadata of frames, and positional joins with prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cell, text as tx, units
from ..functions.binding import let
from ..functions.elements import atomic_rank
from .running import prefix_offsets

# Comment keys kept when a dump is cleaned.
KEEP_KEYS = ("Time", "pbc", "Lattice", "Properties")
# Comment keys dropped and their written order when metadata is harmonised.
DROP_KEYS = ("probability", "umlip", "free_energy")
KEY_ORDER = ("Lattice", "Properties", "config_type", "virial", "volume", "energy", "pbc")


def keep_info(frames: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """B1: only whitelisted comment keys."""
    keys = [*KEEP_KEYS, *extra]
    return frames.withColumns(
        {
            "info": F.map_filter("info", lambda k, _: k.isin(keys)),
            "info_keys": F.filter("info_keys", lambda k: k.isin(keys)),
        }
    )


def drop_labels(frames: DataFrame) -> DataFrame:
    """B2: without stress and virial (any key holding either word) and forces; energy stays.

    ``removed_keys`` counts the dropped keys, ``removed_forces`` tells whether forces were there.
    """

    def tensor(k: Column) -> Column:
        return F.lower(k).contains("stress") | F.lower(k).contains("virial")

    gone = F.size(F.filter(F.map_keys("info"), tensor))
    had = F.exists("atoms", lambda a: a["fx"].isNotNull())
    null = F.lit(None).cast("double")
    bare = F.transform(
        "atoms", lambda a: a.withField("fx", null).withField("fy", null).withField("fz", null)
    )
    none = F.lit(None).cast("array<double>")
    return frames.withColumns({"removed_keys": gone, "removed_forces": had}).withColumns(
        {
            "info": F.map_filter("info", lambda k, _: ~tensor(k)),
            "info_keys": F.filter("info_keys", lambda k: ~tensor(k)),
            "virial": none,
            "stress": none,
            "atoms": bare,
        }
    )


def to_basic(frames: DataFrame) -> DataFrame:
    """Geometry only."""
    keep = [c for c in ("file", "file_ord", "source", "frame_idx", "natoms", "lattice", "pbc") if c in frames.columns]
    return frames.select(
        *keep,
        F.transform(
            "atoms", lambda a: F.struct(*[a[c].alias(c) for c in ("atom_idx", "species", "x", "y", "z")])
        ).alias("atoms"),
    )


def with_weight(frames: DataFrame, weight: float) -> DataFrame:
    """B4."""
    return frames.withColumn("weight", F.lit(float(weight)))


def with_groups(frames: DataFrame, elements: Sequence[str]) -> DataFrame:
    """``group`` of each atom is the position of its species in the list; a species not listed is an error."""
    table = F.array(*[F.lit(e) for e in elements])

    def one(a: Column) -> Column:
        pos = F.array_position(table, a["species"])
        code = F.when(pos > 0, (pos - 1).cast("int")).otherwise(
            F.raise_error(F.concat(F.lit("species not in the element list: "), a["species"])).cast("int")
        )
        return a.withField("group", code)

    return frames.withColumn("atoms", F.transform("atoms", one))


def with_source(df: DataFrame, path: str = "file", level: int = 1) -> DataFrame:
    """Name of the folder ``level`` above the file."""
    return df.withColumn("source", F.element_at(F.split(path, "/"), -1 - level))


def harmonise(frames: DataFrame, config_type: str = "converted", digits: int = 7) -> DataFrame:
    """Forces column named force, dropped keys, config_type, volume, fixed key order.

    ``reason`` tells why a frame cannot be converted; its info is left alone.
    """
    info = F.col("info")

    def val(key: str) -> Column:
        return F.when(F.map_contains_key(info, key), F.element_at(info, key))

    lattice = tx.floats(val("Lattice"))
    props = val("Properties")
    parts = F.split(props, ":")
    renamed = F.array_join(F.transform(parts, lambda p: F.when(p == "forces", "force").otherwise(p)), ":")
    bad_layout = (F.size(parts) % 3 != 0) | F.exists(
        F.filter(parts, lambda _, i: i % 3 == 2), lambda c: c.try_cast("int").isNull()
    )
    reason = (
        F.when(F.size(F.map_keys(info)) == 0, "no_metadata")
        .when(F.coalesce(val("Lattice"), F.lit("")) == "", "no_lattice")
        .when(lattice.isNull() | (F.size(lattice) != 9), "bad_lattice")
        .when(F.coalesce(props, F.lit("")) == "", "no_properties")
        .when(bad_layout, "bad_properties")
        .when(val("energy").isNull(), "no_energy")
    )
    volume = F.format_string(f"%.{digits}f", cell.cell_volume(lattice))
    fresh = F.create_map(
        F.lit("Properties"), renamed, F.lit("config_type"), F.lit(config_type), F.lit("volume"), volume
    )
    replaced = ("Properties", "config_type", "volume")
    merged = F.map_concat(
        F.map_filter(info, lambda k, _: ~k.isin(*DROP_KEYS, *replaced)), fresh
    )
    out = frames.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    order = F.array(*[F.lit(k) for k in KEY_ORDER])
    keys = F.array_distinct(F.concat(order, "info_keys"))
    return out.withColumn("__m", F.when(ok, merged).otherwise(info)).withColumns(
        {
            "info": F.col("__m"),
            "info_keys": F.when(ok, F.filter(keys, lambda k: F.map_contains_key(F.col("__m"), k))).otherwise(F.col("info_keys")),
            "config_type": F.when(ok, F.lit(config_type)).otherwise(F.col("config_type")),
        }
    ).drop("__m")


def coerce_tensor(text: Column) -> Column:
    """Text of numbers -> array; NULL where it cannot be parsed (keep the text then)."""
    return tx.floats(text)


def shift_energy(frames: DataFrame, e0: float) -> DataFrame:
    """``E - N e0``."""
    return frames.withColumn("energy", F.col("energy") - F.col("natoms") * F.lit(float(e0)))


def composition(atoms: DataFrame, frame: Sequence[str] = ("file_ord", "frame_idx")) -> DataFrame:
    """Counts per species and formula by atomic number (then name), from long form."""
    counts = atoms.groupBy(*frame, "species").agg(F.count(F.lit(1)).alias("c"))
    # at most one entry per element
    entries = F.array_sort(
        F.collect_list(F.struct(atomic_rank(F.col("species")).alias("z"), F.col("species").alias("s"), F.col("c").alias("c")))
    )
    return (
        counts.groupBy(*frame)
        .agg(F.sum("c").alias("natoms"), entries.alias("e"))
        .select(
            *frame,
            "natoms",
            F.array_join(F.transform("e", lambda x: F.concat(x["s"], x["c"].cast("string"))), "").alias("formula"),
            F.map_from_entries(F.transform("e", lambda x: F.struct(x["s"], x["c"]))).alias("counts"),
        )
    )


def reorder_atoms(frames: DataFrame, mode: str = "alphabetical", preferred: Sequence[str] = ()) -> DataFrame:
    """Atoms grouped by species, stable inside a species.

    ``alphabetical``, ``atomic_number``, ``preferred`` (listed first, the rest keep
    their order) or ``input`` (order of first appearance).
    """

    def rank(a: Column, species: Column) -> Column:
        if mode == "alphabetical":
            return F.struct(F.lit(0).alias("n"), a["species"].alias("t"))
        if mode == "atomic_number":
            return F.struct(atomic_rank(a["species"]).alias("n"), a["species"].alias("t"))
        if mode == "preferred":
            pos = F.array_position(F.array(*[F.lit(p) for p in preferred]), a["species"])
            return F.struct(
                F.when(pos > 0, pos.cast("int")).otherwise(len(preferred) + 1).alias("n"), F.lit("").alias("t")
            )
        if mode == "input":
            return F.struct(F.array_position(species, a["species"]).cast("int").alias("n"), F.lit("").alias("t"))
        raise ValueError(f"unknown mode {mode!r}")

    def keyed(species: Column) -> Column:
        return F.array_sort(
            F.transform("atoms", lambda a: F.struct(rank(a, species).alias("r"), a["atom_idx"].alias("i"), a.alias("a")))
        )

    return frames.withColumn(
        "atoms",
        F.transform(
            let(F.transform("atoms", lambda a: a["species"]), keyed),
            lambda e, i: e["a"].withField("atom_idx", i.cast("int")),
        ),
    )


def strip_species(frames: DataFrame, element: str) -> DataFrame:
    """Without one species; atoms are numbered again."""
    left = F.filter("atoms", lambda a: a["species"] != element)
    return frames.withColumn(
        "atoms", F.transform(left, lambda a, i: a.withField("atom_idx", i.cast("int")))
    ).withColumn("natoms", F.size("atoms"))


# -- positional joins --------------------------------------------------------------


def join_by_row(a: DataFrame, b: DataFrame, on: str = "row_no", whole: bool = True) -> DataFrame:
    """D3: rows of two tables by position; a row without its partner is an error.

    ``whole=False`` looks up rows that were picked from one of the tables.
    """
    return _aligned(a, b, [on], "rows") if whole else a.join(b, on)


def with_atom_base(frames: DataFrame, frame_no: str = "frame_no") -> DataFrame:
    """Number of atoms in all frames before this one."""
    sizes = frames.select(frame_no, F.col("natoms").cast("long").alias("__n"))
    return frames.join(prefix_offsets(sizes, frame_no, "__n", "atom_base").drop("__n"), frame_no)


def relabel_frames(
    frames: DataFrame, energy: DataFrame, virial: DataFrame | None = None, with_stress: bool = False
) -> DataFrame:
    """Per-atom predictions by position -> total energy and virial (and stress = -virial/V).

    ``frames`` carry ``frame_no``; prediction rows carry ``row_no`` and ``values``.
    Row counts must agree.
    """
    e = energy.select(F.col("row_no").alias("frame_no"), F.get("values", F.lit(0)).alias("__e"))
    out = _aligned(frames, e, ["frame_no"], "energy rows").withColumn(
        "energy", units.total(F.col("__e"), F.col("natoms"))
    ).drop("__e")
    if virial is None:
        return out
    v = virial.select(F.col("row_no").alias("frame_no"), F.slice("values", 1, 6).alias("__v"))
    out = _aligned(out, v, ["frame_no"], "virial rows").withColumn(
        "virial", F.transform(units.voigt_to_9(F.col("__v")), lambda x: x * F.col("natoms"))
    )
    stress = units.virial_to_stress(F.col("virial"), cell.cell_volume(F.col("lattice")))
    return out.drop("__v").withColumn("stress", stress if with_stress else F.lit(None).cast("array<double>"))


def _aligned(left: DataFrame, right: DataFrame, on: Sequence[str], what: str) -> DataFrame:
    """Join by position where every row must have its partner; checked in the join itself."""
    marked = left.withColumn("__left", F.lit(True)).join(right.withColumn("__right", F.lit(True)), list(on), "full_outer")
    ok = F.col("__left") & F.col("__right")
    at = F.concat_ws(", ", *[F.col(c).cast("string") for c in on])
    fail = F.raise_error(F.format_string(f"row counts differ: %s is missing in the frames or in the {what}", at))
    return marked.filter(F.when(ok, True).otherwise(fail.cast("boolean"))).drop("__left", "__right")


_FORCE_BLOCK = 512  # force rows that travel together


def relabel_forces(frames: DataFrame, force: DataFrame) -> DataFrame:
    """Force rows by position over all atoms of the corpus; row counts must agree.

    Force rows are packed into blocks of consecutive rows; a frame takes its slice of the blocks that hold it, so atoms
    stay in their row and nothing is joined atom by atom.
    """
    based = frames if "atom_base" in frames.columns else with_atom_base(frames)
    base, n, size = F.col("atom_base"), F.col("natoms"), F.lit(_FORCE_BLOCK)
    row = F.struct("row_no", *[F.get("values", F.lit(k)).alias(c) for k, c in enumerate(("fx", "fy", "fz"))])
    blocks = force.groupBy(F.floor(F.col("row_no") / size).alias("block")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    held = F.sequence(F.floor(base / size), F.floor((base + F.greatest(n, F.lit(1)) - 1) / size))
    asked = based.select("frame_no", "atom_base", "natoms", F.explode(held).alias("block"))
    start = F.col("block") * size
    first, last = F.greatest(base, start) - start, F.least(base + n, start + size) - start
    piece = F.slice("rows", (first + 1).cast("int"), F.greatest(last - first, F.lit(0)).cast("int"))
    own = asked.join(blocks, "block", "left").groupBy("frame_no").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", F.coalesce(piece, F.array().cast("array<struct<row_no:bigint,fx:double,fy:double,fz:double>>")).alias("p")))), lambda p: p["p"])).alias("__f")
    )
    atoms, rows = based.agg(F.coalesce(F.sum("natoms"), F.lit(0))).first()[0], force.count()
    if atoms != rows:
        raise ValueError(f"row counts differ: {atoms} atoms in the frames, {rows} force rows")
    met = based.join(own, "frame_no")
    dense = (F.size("__f") == n) & F.forall(F.transform("__f", lambda r, i: r["row_no"] == base + i), lambda x: x)
    fail = F.raise_error(F.format_string("row counts differ: force rows of frame %d are missing or repeated", F.col("frame_no")))

    def one(a: Column) -> Column:
        f = F.get("__f", a["atom_idx"])
        return a.withField("fx", f["fx"]).withField("fy", f["fy"]).withField("fz", f["fz"])

    labelled = F.when(dense, F.transform("atoms", one)).otherwise(fail.cast(based.schema["atoms"].dataType))
    return met.select(*[c for c in based.columns if c not in ("atoms", "atom_base")], labelled.alias("atoms"))


def map_types(atoms: DataFrame, symbols: Sequence[str], code: str = "type", base: int = 0) -> DataFrame:
    """Type code -> symbol from a list; a code outside the list is an error."""
    table = F.array(*[F.lit(s) for s in symbols])
    symbol = F.get(table, (F.col(code) - base).cast("int"))
    checked = F.coalesce(
        symbol, F.raise_error(F.concat(F.lit("type code without a symbol: "), F.col(code).cast("string"))).cast("string")
    )
    return atoms.withColumn("species", checked)


def join_cp2k(pos: DataFrame, frc: DataFrame, cells: DataFrame, config_type: str = "cp2k") -> DataFrame:
    """Positions, forces with energy, and cells of one run, by frame position.

    Force rows are matched to atoms by their row, so an unreadable row leaves a
    NULL force instead of shifting the atoms after it. A frame that one of the
    three lacks is an error.
    """
    key = ["file_ord", "frame_idx"]
    forced = _aligned(pos, frc.select(*key, F.col("energy").alias("__e"), F.col("atoms").alias("__f")), key, "forces")
    forced = _aligned(forced, cells.select(*key, F.col("lattice").alias("__l")), key, "cells")

    def force(i: Column, axis: str) -> Column:
        return units.to_ev(F.get("__f", i)[axis], "hartree/bohr")

    atoms = F.transform(
        "atoms",
        lambda a, i: a.withField("fx", force(i, "x")).withField("fy", force(i, "y")).withField("fz", force(i, "z")),
    )
    return forced.withColumns(
        {
            "atoms": atoms,
            "energy": units.to_ev(F.col("__e"), "hartree"),
            "lattice": F.col("__l"),
            "config_type": F.lit(config_type),
        }
    ).drop("__e", "__f", "__l")
