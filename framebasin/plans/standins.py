"""The supplied tables seen as atoms, frames, trajectories and logs.

``lineitem`` stands in for atoms in long form (a frame is an order), ``embeddings``
for frame rows (63 numbers are 21 positions, the last is the energy), ``events``
for a trajectory of labelled frames, ``documents`` for texts with copies. Every
view keeps all rows of its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binding import let
from ..operators.running import Ordered
from ..session import scratch_path

SPECIES = ("Mo", "Te", "Li")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rnd(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# -- atoms in long form ----------------------------------------------------------

LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
FRAME = ("frame_idx",)

ATOMS_SQL = """
atoms AS (
  SELECT l_orderkey AS frame_idx,
         row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS atom_idx,
         CASE l_returnflag WHEN 'A' THEN 'Mo' WHEN 'N' THEN 'Te' ELSE 'Li' END AS species,
         l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z
  FROM lineitem)"""

RANK_SQL = "CASE {s} WHEN 'Li' THEN 3 WHEN 'Mo' THEN 42 WHEN 'Te' THEN 52 END"


def flag_species(flag: str = "l_returnflag") -> Column:
    return F.when(F.col(flag) == "A", "Mo").when(F.col(flag) == "N", "Te").otherwise("Li")


def atoms(spark: SparkSession, sf: str) -> DataFrame:
    """``frame_idx, atom_idx, natoms, species, x, y, z`` from lineitem."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("frame_idx"),
        *LINE_ORDER,
        flag_species().alias("species"),
        F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 1000).alias("y"),
        (F.col("l_discount") * 100).alias("z"),
    )
    o = Ordered(li, FRAME, LINE_ORDER).rank("atom_idx").group_size("natoms")
    return o.result().select("frame_idx", "atom_idx", "natoms", "species", "x", "y", "z")


def species_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Species per atom only, for composition work that needs no atom numbers."""
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("frame_idx"), flag_species().alias("species"))


SPECIES_SQL = """
rows AS (
  SELECT l_orderkey AS frame_idx,
         CASE l_returnflag WHEN 'A' THEN 'Mo' WHEN 'N' THEN 'Te' ELSE 'Li' END AS species
  FROM lineitem)"""


# -- frame rows ------------------------------------------------------------------

N_ATOMS = 21

FRAMES_SQL = """
fr AS (
  SELECT vec_id AS frame_idx, label, CAST(embedding AS DOUBLE[]) AS e, 10.0 + label AS la FROM embeddings),
fatoms AS (
  SELECT frame_idx, label, la, e, i AS atom_idx,
         CASE i % 3 WHEN 0 THEN 'Mo' WHEN 1 THEN 'Te' ELSE 'Li' END AS species,
         10 * e[3*i+1] AS x, 10 * e[3*i+2] AS y, 10 * e[3*i+3] AS z,
         e[63-3*i] AS fx, e[62-3*i] AS fy, e[61-3*i] AS fz
  FROM fr, (SELECT CAST(range AS INTEGER) AS i FROM range(21)) t)"""


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """One frame per embedding: 21 atoms, a skewed cell periodic in x and y, energy, virial."""
    src = table(spark, sf, "embeddings")
    numbers = F.transform("embedding", lambda v: v.cast("double"))
    names = F.array(*[F.lit(s) for s in SPECIES])

    def one(i: Column, e: Column) -> Column:
        return F.struct(
            i.alias("atom_idx"),
            F.get(names, i % 3).alias("species"),
            *[(10 * F.get(e, 3 * i + k)).alias(c) for k, c in enumerate("xyz")],
            *[F.get(e, 62 - 3 * i - k).alias(f"f{c}") for k, c in enumerate("xyz")],
        )

    atoms = let(numbers, lambda e: F.transform(F.sequence(F.lit(0), F.lit(N_ATOMS - 1)), lambda i: one(i, e)))
    first = F.get("embedding", F.lit(0)).cast("double")
    zero = F.lit(0.0)
    return src.select(
        F.lit("embeddings").alias("file"),
        F.lit(0).alias("file_ord"),
        F.concat(F.lit("md"), F.col("label")).alias("source"),
        F.col("vec_id").alias("frame_idx"),
        F.lit(N_ATOMS).alias("natoms"),
        F.array(10.0 + F.col("label"), zero, zero, F.lit(1.0), F.lit(10.0), zero, zero, zero, F.lit(12.0)).alias("lattice"),
        F.array(F.lit(True), F.lit(True), F.lit(False)).alias("pbc"),
        F.lit("species:S:1:pos:R:3:forces:R:3").alias("properties"),
        F.create_map(F.lit("vec"), F.col("vec_id").cast("string"), F.lit("Time"), (F.col("vec_id") * 5).cast("string")).alias("info"),
        F.array(F.lit("Time"), F.lit("Lattice"), F.lit("vec")).alias("info_keys"),
        F.get("embedding", F.lit(63)).cast("double").alias("energy"),
        F.transform(F.slice("embedding", 1, 9), lambda v: v.cast("double")).alias("virial"),
        F.lit(None).cast("array<double>").alias("stress"),
        F.abs(first).alias("uncertainty"),
        F.lit(None).cast("double").alias("weight"),
        F.lit(None).cast("string").alias("config_type"),
        atoms.alias("atoms"),
    )


# -- labelled frames of a trajectory ------------------------------------------------


def events(spark: SparkSession, sf: str) -> DataFrame:
    """``source, frame_idx, uncertainty, kind`` from events."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("source"), F.col("event_id").alias("frame_idx"),
        F.col("value").alias("uncertainty"), F.col("event_type").alias("kind"),
    )


# -- derived text files --------------------------------------------------------------


def derive_text(rows: DataFrame, name: str, order: str = "ord") -> str:
    """Write text rows (``ord, value``) as consecutive part files; returns the folder."""
    path = scratch_path(rows.sparkSession, name)
    rows.repartitionByRange(order).sortWithinPartitions(order).select("value").write.text(path)
    return path


def derive_files(rows: DataFrame, name: str, *order: str, folder: str = "bucket") -> str:
    """Write text rows (``bucket, ..., value``) as one file per bucket; buckets are bounded in size."""
    path = scratch_path(rows.sparkSession, name)
    (
        rows.repartition(folder)
        .sortWithinPartitions(folder, *order)
        .select(folder, "value")
        .write.partitionBy(folder)
        .text(path)
    )
    return path


def frames_per_file(frames: DataFrame, least: int = 512, most: int = 65_536, files: int = 16) -> int:
    """Consecutive ids in a file, so that files grow with the table before their number does.

    About ``files`` files of ``least`` ids or more; beyond that files of about ``most`` frames.
    """
    n, low, high = frames.agg(F.count(F.lit(1)), F.min("frame_idx"), F.max("frame_idx")).first()
    span = high - low + 1 if high is not None else 1
    return max(least, -(-span // max(files, n // most)))
