"""Numeric text tables: prediction matrices, profiles, blocks, bands, losses, levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.running import group_rank, prefix_offsets
from .lines import list_files, read_lines


def _blank():
    return F.length(F.trim("line")) == 0


def read_matrix(spark: SparkSession, paths, **options) -> DataFrame:
    """``file, row, row_no, values`` of headerless numeric rows; blank lines do not count.

    ``row`` counts in the file, ``row_no`` over all files in natural path order.
    """
    lines = read_lines(spark, paths, {"__k": ~_blank()}, **options).filter(~_blank())
    rows = lines.select("file", (F.col("__k") - 1).alias("row"), tx.floats(F.col("line")).alias("values"))
    files = list_files(spark, paths, **options).select("file", "file_ord")
    sizes = rows.groupBy("file").agg(F.count(F.lit(1)).alias("__n")).join(files, "file")
    # files without rows still hold their place in the order
    dense = files.join(sizes.select("file", "__n"), "file", "left").fillna(0, ["__n"])
    bases = prefix_offsets(dense, "file_ord", "__n", "__base").select("file", "__base")
    return rows.join(bases, "file").select("file", "row", (F.col("row") + F.col("__base")).alias("row_no"), "values")


def read_profile(
    spark: SparkSession, paths, skip: int = 0, encoding: str | Sequence[str] | None = None, **options
) -> DataFrame:
    """A10: first two columns ``z, value`` of each file after ``skip`` lines; blank lines are ignored.

    ``encoding`` is one codec or several that are tried in turn (``lines.ENCODINGS``).
    """
    lines = read_lines(spark, paths, encoding=encoding, **options)
    used = lines.filter((F.col("line_no") >= skip) & ~_blank())
    tokens = F.split(F.trim("line"), r"\s+")
    return used.select(
        "file", "line_no",
        F.get(tokens, F.lit(0)).cast("double").alias("z"),
        F.get(tokens, F.lit(1)).cast("double").alias("value"),
    )


def read_blocks(spark: SparkSession, paths, skip: int = 2, **options) -> DataFrame:
    """Blocks separated by blank lines: ``file, block, line_no, values``; runs of blanks separate once."""
    lines = read_lines(spark, paths, {"__b": _blank()}, **options)
    rows = lines.filter((F.col("line_no") >= skip) & ~_blank())
    raw = rows.select("file", "line_no", F.col("__b"), tx.floats(F.col("line")).alias("values"))
    ids = raw.select("file", "__b").distinct()
    ranked = group_rank(ids, ["file"], ["__b"], "block")
    return raw.join(ranked, ["file", "__b"]).select("file", "block", "line_no", "values")


def read_bands(spark: SparkSession, paths, skip: int = 1, **options) -> DataFrame:
    """``k`` and M bands per line -> ``file, row, k, band, energy``."""
    lines = read_lines(spark, paths, **options)
    used = lines.filter((F.col("line_no") >= skip) & ~_blank())
    v = tx.floats(F.col("line"))
    return used.select("file", (F.col("line_no") - skip).alias("row"), v.alias("v")).select(
        "file", "row", F.get("v", F.lit(0)).alias("k"),
        F.posexplode(F.slice("v", F.lit(2), F.size("v") - 1)).alias("band", "energy"),
    )


# Meaning of the loss columns after the step, by table width and step size.
LOSS_LABELS = {
    "narrow": ["Loss", "Energy-train", "Force-train", "Virial-train"],
    "step_100": ["Total", "L1-Reg", "L2-Reg", "Energy-train", "Force-train", "Virial-train"],
    "step_1": ["Total", "Energy-train", "Force-train", "Virial-train"],
}


def read_loss(spark: SparkSession, paths, **options) -> DataFrame:
    """Loss table -> ``row_no, step, metric, value``; 6 columns, or 9 and more with step 100 or 1."""
    return loss_metrics(read_matrix(spark, paths, **options))


def loss_metrics(matrix: DataFrame) -> DataFrame:
    """Long form of loss rows (``row_no, values``); an unknown layout is an error."""
    head = {r["row_no"]: r["values"] for r in matrix.filter(F.col("row_no") < 2).collect()}
    width = len(head[0])
    if width == 6:
        labels = LOSS_LABELS["narrow"]
    elif width >= 9:
        labels = LOSS_LABELS.get(f"step_{head[1][0] - head[0][0]:g}")
        if labels is None:
            raise ValueError(f"unsupported step size {head[1][0] - head[0][0]:g}")
    else:
        raise ValueError(f"unsupported loss table with {width} columns")
    pairs = F.array(
        *[F.struct(F.lit(n).alias("metric"), F.get("values", F.lit(i + 1)).alias("value")) for i, n in enumerate(labels)]
    )
    return matrix.select("row_no", F.get("values", F.lit(0)).alias("step"), F.inline(pairs))


# Alternative headers of a level table.
LEVEL_ALIASES = {"vbm_ev": "vbm", "cbm_ev": "cbm", "ef_ev": "ef"}
LEVEL_COLUMNS = ("system", "vbm", "cbm", "ef")


def read_levels(spark: SparkSession, paths, **options) -> DataFrame:
    """Level table from CSV; alias headers are accepted, a missing column is an error."""
    raw = spark.read.options(header="true", ignoreLeadingWhiteSpace="true", **options).csv(paths)
    names = [c.lstrip("#").strip() for c in raw.columns]
    raw = raw.toDF(*names)
    raw = raw.withColumnsRenamed({a: n for a, n in LEVEL_ALIASES.items() if a in names and n not in names})
    missing = sorted(set(LEVEL_COLUMNS) - set(raw.columns))
    if missing:
        raise ValueError(f"level table lacks columns: {', '.join(missing)}")
    return raw.select("system", *[F.col(c).cast("double").alias(c) for c in LEVEL_COLUMNS[1:]])


# Columns of a projected density-of-states file, in file order.
PDOS_COLUMNS = ("energy", "s", "py", "pz", "px")


def read_pdos(spark: SparkSession, paths, skip: int = 1, **options) -> DataFrame:
    """Projected density of states with named orbitals."""
    lines = read_lines(spark, paths, **options).filter((F.col("line_no") >= skip) & ~_blank())
    v = tx.floats(F.col("line"))
    return lines.select("file", "line_no", v.alias("v")).select(
        "file", "line_no", *[F.get("v", F.lit(i)).alias(c) for i, c in enumerate(PDOS_COLUMNS)]
    )


def relabel_columns(matrix: DataFrame, names: Sequence[str], values: str = "values") -> DataFrame:
    """Named columns from a values array."""
    keep = [c for c in matrix.columns if c != values]
    return matrix.select(*keep, *[F.get(values, F.lit(i)).alias(n) for i, n in enumerate(names)])
