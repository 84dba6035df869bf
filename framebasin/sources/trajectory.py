"""Block-structured trajectories: direct-coordinate blocks, configuration blocks, CP2K text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cell, text as tx
from ..session import cut
from .frames import read_frames
from .lines import list_files, read_lines

_TOKENS = r"\s+"


def _tokens(line: Column) -> Column:
    return F.split(F.trim(line), _TOKENS)


def read_xdatcar(spark: SparkSession, paths, **options) -> DataFrame:
    """Fractional positions in long form: ``file, file_ord, frame_idx, atom_idx, species, fx, fy, fz``
    with the ``lattice`` of the file; coordinates are wrapped into [0, 1).

    Frames are the blocks after ``Direct configuration=`` lines; a block with more or fewer
    rows than the header has atoms is an error.
    """
    mark = F.lower(F.ltrim("line")).startswith("direct configuration")
    lines = read_lines(spark, paths, {"__f": mark}, **options)
    head = lines.filter(F.col("line_no") < 7).groupBy("file").agg(
        *[F.max(F.when(F.col("line_no") == k, F.col("line"))).alias(f"h{k}") for k in range(1, 7)]
    )
    scale = F.trim("h1").cast("double")
    vectors = F.concat(*[tx.floats(F.col(f"h{k}")) for k in (2, 3, 4)])
    names, counts = _tokens(F.col("h5")), F.transform(_tokens(F.col("h6")), lambda c: c.cast("int"))
    species = F.flatten(F.transform(F.arrays_zip(names.alias("s"), counts.alias("n")), lambda e: F.array_repeat(e["s"], e["n"])))
    headers = cut(
        head.select("file", F.transform(vectors, lambda v: v * scale).alias("lattice"), species.alias("names")), "headers"
    )
    body = lines.filter((F.col("__f") > 0) & ~mark & (F.length("line") > 0))
    # the marker line is the only line between frames, so positions follow from line numbers
    found = body.groupBy("file", "__f").agg(F.count(F.lit(1)).alias("__n"))
    starts = lines.filter(mark).select("file", F.col("__f"), F.col("line_no").alias("__at"))
    starts = starts.join(found, ["file", "__f"], "left").join(headers.select("file", F.size("names").alias("__w")), "file")
    wrong = F.raise_error(F.format_string("%s: block %d has %d rows, not %d", "file", "__f", F.coalesce("__n", F.lit(0)), "__w"))
    whole = F.when(F.col("__n").eqNullSafe(F.col("__w")), True).otherwise(wrong.cast("boolean"))
    starts = starts.filter(whole).drop("__n", "__w")
    rows = body.join(starts, ["file", "__f"]).withColumn("atom_idx", (F.col("line_no") - F.col("__at") - 1).cast("int"))
    t = tx.floats(F.col("line"))
    files = list_files(spark, paths, **options).select("file", "file_ord")
    return rows.join(headers, "file").join(files, "file").select(
        "file", "file_ord", (F.col("__f") - 1).alias("frame_idx"), "atom_idx",
        F.get("names", F.col("atom_idx")).alias("species"),
        *[cell.wrap(F.get(t, F.lit(k))).alias(c) for k, c in enumerate(("fx", "fy", "fz"))],
        "lattice",
    )


def to_cartesian(positions: DataFrame) -> DataFrame:
    """Positions with Cartesian ``x, y, z``."""
    xyz = cell.to_cart([F.col(c) for c in ("fx", "fy", "fz")], F.col("lattice"))
    return positions.withColumns(dict(zip("xyz", xyz)))


def read_cfg(spark: SparkSession, paths, symbols: Sequence[str], **options) -> DataFrame:
    """``BEGIN_CFG ... END_CFG`` blocks: one row per configuration, atoms ordered by id.

    Type codes index ``symbols``; a code without a symbol is an error.
    """
    begin = F.col("line").contains("BEGIN_CFG")
    lines = read_lines(spark, paths, {"__f": begin}, **options).filter((F.col("__f") > 0) & (F.length("line") > 0))
    block = lines.groupBy("file", F.col("__f")).agg(
        F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls")
    )
    ls = F.transform("ls", lambda e: F.trim(e["line"]))
    b = block.select("file", (F.col("__f") - 1).alias("frame_idx"), ls.alias("ls"))

    def at(word: str, avoid: str | None = None) -> Column:
        """1-based place of the first line with a word, NULL without one."""
        hits = F.filter(
            F.transform("ls", lambda t, i: F.struct(t.alias("t"), (i + 1).alias("i"))),
            lambda e: e["t"].contains(word) & (~e["t"].contains(avoid) if avoid else F.lit(True)),
        )
        return F.get(hits, F.lit(0))["i"]

    b = b.withColumns(
        {
            "a_size": at("Size"), "a_cell": at("Supercell"), "a_atoms": at("AtomData"),
            "a_energy": at("Energy", "Weight"), "a_stress": at("PlusStress"), "a_weight": at("EnergyWeight"),
        }
    )

    def after(place: str, k: int = 1) -> Column:
        return F.get("ls", F.col(place) - 1 + k)

    b = b.withColumn("natoms", F.get(_tokens(after("a_size")), F.lit(0)).cast("int"))
    header = F.filter(_tokens(F.get("ls", F.col("a_atoms") - 1)), lambda t: ~t.contains("AtomData"))
    b = b.withColumn("cols", header)
    table = F.array(*[F.lit(s) for s in symbols])

    def field(tokens: Column, name: str) -> Column:
        place = F.array_position(F.col("cols"), name)
        return F.when(place > 0, F.get(tokens, (place - 1).cast("int")))

    def one(line: Column) -> Column:
        t = _tokens(line)
        code = field(t, "type").cast("int")
        symbol = F.coalesce(
            F.get(table, code),
            F.raise_error(F.concat(F.lit("type code without a symbol: "), code.cast("string"))).cast("string"),
        )
        return F.struct(
            (field(t, "id").cast("int") - 1).alias("atom_idx"),
            symbol.alias("species"),
            *[field(t, f"cartes_{c}").cast("double").alias(c) for c in "xyz"],
            *[field(t, f"f{c}").cast("double").alias(f"f{c}") for c in "xyz"],
        )

    rows = F.slice("ls", F.col("a_atoms") + 1, F.col("natoms"))
    files = list_files(spark, paths, **options).select("file", "file_ord")
    return b.join(files, "file").select(
        "file", "file_ord", "frame_idx", "natoms",
        F.concat(*[tx.floats(after("a_cell", k)) for k in (1, 2, 3)]).alias("lattice"),
        F.array(F.lit(True), F.lit(True), F.lit(True)).alias("pbc"),
        F.get(_tokens(after("a_energy")), F.lit(0)).cast("double").alias("energy"),
        tx.floats(after("a_stress")).alias("virial"),
        F.get(_tokens(after("a_weight")), F.lit(0)).cast("double").alias("weight"),
        F.lit("cfg").alias("config_type"),
        F.array_sort(F.transform(rows, one)).alias("atoms"),
    )


def read_cp2k_cell(spark: SparkSession, paths, **options) -> DataFrame:
    """D4 input: cell rows after one header line: step, time, nine components, volume."""
    lines = read_lines(spark, paths, **options).filter((F.col("line_no") > 0) & (F.length("line") > 0))
    files = list_files(spark, paths, **options).select("file", "file_ord")
    v = tx.floats(F.col("line"))
    return lines.join(files, "file").select(
        "file_ord", (F.col("line_no") - 1).alias("frame_idx"), F.slice(v, 3, 9).alias("lattice")
    )


def read_cp2k_frames(spark: SparkSession, paths, **options) -> DataFrame:
    """D4 input: position or force frames; ``energy`` in hartree from ``E = <value>`` in the comment."""
    return read_frames(spark, paths, comment_energy=r"E\s*=\s*([-+0-9.eEdD]+)", **options)
