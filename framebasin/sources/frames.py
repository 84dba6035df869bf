"""Extended-XYZ corpora: strict and tolerant frame readers, and the sink.

Frames are cut out of the splits of a file by the scanning tasks (``blocks``); a frame is one row with its lines, and
everything after that happens inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.binding import let
from ..operators.running import group_rank, prefix_offsets
from .blocks import ATOM_ROW, COUNT_LINE, LONE_COUNT, frame_blocks
from .lines import list_files, read_lines

__all__ = ["ATOM_ROW", "frame_blocks", "frame_lines", "read_frames", "validate_blocks", "validate_frames", "write_frames"]


# -- readers -----------------------------------------------------------------


def frame_lines(spark: SparkSession, paths, **options) -> DataFrame:
    """Lines with the tolerant frame they belong to: ``file, frame_idx, line_no, line``.

    A lone positive integer opens a frame and everything up to the next one is its body; lines before the first
    header have ``frame_idx`` NULL.
    """
    lines = read_lines(spark, paths, {"__f": F.col("line").rlike(LONE_COUNT)}, **options)
    return lines.select("file", F.when(F.col("__f") > 0, F.col("__f") - 1).alias("frame_idx"), "line_no", "line")


def read_frames(
    spark: SparkSession, paths, strict: bool = True, comment_energy: str | None = None, raw: bool = False, **options
) -> DataFrame:
    """A1/A2: frames of extended-XYZ files, one row per frame, keyed by (file_ord, frame_idx).

    Strict: a frame with fewer lines than announced is an error. Tolerant: only
    good frames are kept, numbered again from 0 in each file. ``comment_energy`` is
    a pattern whose first group is the energy, for comments without key=value pairs.
    ``raw`` keeps the text of each frame, for filters that hand frames through unchanged.
    """
    blocks = frame_blocks(spark, paths, strict=strict, **options)
    files = list_files(spark, paths, **options)
    if not strict:
        good = F.filter("ls", lambda line: F.length(line) > 0)
        blocks = validate_blocks(blocks, "ls").where("status = 'good'").select("file", "frame_idx", good.alias("ls"))
    frames = assemble(blocks, files, comment_energy, raw)
    return frames if strict else renumber(frames)


def assemble(blocks: DataFrame, files: DataFrame | None = None, comment_energy: str | None = None, raw: bool = False) -> DataFrame:
    """A1, A3-A5: the lines of each frame (``ls``) become typed columns, with the order of the file if ``files`` has it."""
    count = F.regexp_extract(F.get("ls", F.lit(0)), COUNT_LINE, 1).cast("int")
    body = blocks.withColumn("natoms", count)
    # a tolerant frame may lack its comment line
    bare = F.size("ls") == F.col("natoms") + 1
    bare = bare & F.get("ls", F.lit(1)).rlike(ATOM_ROW)
    checked = body.withColumn(
        "rows",
        F.when(bare, F.slice("ls", F.lit(2), F.col("natoms")))
        .when(F.size("ls") >= F.col("natoms") + 2, F.slice("ls", F.lit(3), F.col("natoms")))
        .otherwise(
            F.raise_error(F.format_string("%s: frame %d is cut short", F.col("file"), F.col("frame_idx")))
        ),
    ).withColumn("comment", F.when(bare, "").otherwise(F.get("ls", F.lit(1))))
    framed = from_comment(checked.withColumn("raw", F.array_join("ls", "\n")) if raw else checked, comment_energy)
    return framed if files is None else framed.join(files.select("file", "file_ord"), "file")


def from_comment(df: DataFrame, comment_energy: str | None = None) -> DataFrame:
    """A3-A5: promoted columns from ``comment`` and atoms from ``rows``."""
    info = df.withColumn("info", tx.parse_info(F.col("comment"))).withColumn(
        "info_keys", tx.info_keys(F.col("comment"))
    )
    props = F.coalesce(tx.info_value(F.col("info"), "Properties"), F.lit(tx.DEFAULT_LAYOUT))
    laid = info.withColumn("properties", props)

    def number(key: str) -> Column:
        return tx.info_value(F.col("info"), key).try_cast("double")

    energy = number("energy")
    if comment_energy:
        energy = F.regexp_extract("comment", comment_energy, 1).try_cast("double")
    return laid.select(
        "file",
        F.regexp_extract("file", r"([^/]+)/[^/]*$", 1).alias("source"),
        "frame_idx",
        "natoms",
        tx.parse_lattice(tx.info_value(F.col("info"), "Lattice")).alias("lattice"),
        tx.parse_pbc(tx.info_value(F.col("info"), "pbc")).alias("pbc"),
        "properties",
        "info",
        "info_keys",
        energy.alias("energy"),
        tx.floats(tx.info_value(F.col("info"), "virial")).alias("virial"),
        tx.floats(tx.info_value(F.col("info"), "stress")).alias("stress"),
        number("uncertainty").alias("uncertainty"),
        number("weight").alias("weight"),
        tx.info_value(F.col("info"), "config_type").alias("config_type"),
        tx.parse_atoms(F.col("rows"), F.col("properties")).alias("atoms"),
        *[c for c in ("raw",) if c in df.columns],
    )


def _status(bad: Column, found: Column, declared: Column) -> Column:
    return F.when(bad > 0, "invalid").when(found < declared, "missing").when(found > declared, "extra").otherwise("good")


def validate_blocks(blocks: DataFrame, *keep: str) -> DataFrame:
    """Status of each tolerant frame (good, invalid, missing or extra), worked out inside its row.

    The first non-blank line after the header is the comment unless it looks like an atom row; later lines that are
    not atom rows are invalid.
    """
    text = F.filter("ls", lambda line, i: (i > 0) & (F.length(F.trim(line)) > 0))
    judged = blocks.withColumn("__a", F.transform(text, lambda line: line.rlike(ATOM_ROW)))
    found = F.size(F.filter("__a", lambda a: a)).cast("long")
    bad = F.size("__a") - found - F.when(F.get("__a", F.lit(0)) == F.lit(False), 1).otherwise(0)
    declared = F.get("ls", F.lit(0)).try_cast("bigint")
    head = [c for c in ("line_no",) if c in blocks.columns]
    return judged.select(
        "file", "frame_idx", *[F.col(c).alias("header_line") for c in head], declared.alias("declared"), found.alias("found"),
        _status(bad, found, declared).alias("status"), *keep,
    )


def validate_frames(rows: DataFrame) -> DataFrame:
    """Status of each tolerant frame: good, invalid, missing or extra.

    The first non-blank line after the header is the comment unless it looks
    like an atom row; later lines that are not atom rows are invalid.
    """
    body = rows.filter(F.col("frame_idx").isNotNull())
    header = F.col("line").rlike(LONE_COUNT)
    blank = F.length(F.trim("line")) == 0
    is_atom = F.col("line").rlike(ATOM_ROW)
    text = ~header & ~blank
    # the comment is the non-blank line right after the header, found without a window
    first = F.min(F.when(text, F.struct("line_no", is_atom.alias("atom"))))
    stats = body.groupBy("file", "frame_idx").agg(
        F.max(F.when(header, F.col("line").try_cast("bigint"))).alias("declared"),
        F.min(F.when(header, F.col("line_no"))).alias("header_line"),
        F.count_if(text & is_atom).alias("found"),
        F.count_if(text & ~is_atom).alias("other"),
        first.alias("first"),
    )
    bad = F.col("other") - F.when(F.col("first.atom") == F.lit(False), 1).otherwise(0)
    return stats.select(
        "file",
        "frame_idx",
        "header_line",
        "declared",
        "found",
        _status(bad, F.col("found"), F.col("declared")).alias("status"),
    )


def merge_status(spark: SparkSession, paths, **options) -> DataFrame:
    """H1: what a merge takes from each file: ``file, status, frames, bad``; status is ok, empty or invalid.

    A file without any line of text is empty, one without a good frame invalid; ``bad`` counts frames that are left out.
    """
    files = list_files(spark, paths, **options).select("file")
    found = validate_blocks(frame_blocks(spark, paths, strict=False, **options))
    good = F.col("status") == "good"
    counts = found.groupBy("file").agg(F.count_if(good).alias("frames"), F.count_if(~good).alias("bad"))
    lines = (spark.read.options(**options) if options else spark.read).text(paths)
    written = lines.where(F.length(F.trim("value")) > 0).select(F.col("_metadata.file_path").alias("file")).distinct().withColumn("written", F.lit(True))
    met = files.join(counts, "file", "left").join(written, "file", "left")
    none = F.lit(0).cast("long")
    status = F.when(F.col("written").isNull(), "empty").when(F.coalesce("frames", none) == 0, "invalid").otherwise("ok")
    return met.select("file", status.alias("status"), F.coalesce("frames", none).alias("frames"), F.coalesce("bad", none).alias("bad"))


def renumber(frames: DataFrame) -> DataFrame:
    """frames of each file numbered from 0 again."""
    ranked = group_rank(frames.withColumnRenamed("frame_idx", "__old"), ["file"], ["__old"], "frame_idx")
    return ranked.drop("__old")


def frame_numbers(frames: DataFrame, name: str = "frame_no") -> DataFrame:
    """Global 0-based frame position: frames of earlier files plus the index in the file."""
    sizes = frames.groupBy("file_ord").agg(F.count(F.lit(1)).alias("__n"))
    bases = prefix_offsets(sizes, "file_ord", "__n", "__base").drop("__n")
    return (
        frames.join(bases, "file_ord")
        .withColumn(name, F.col("__base") + F.col("frame_idx"))
        .drop("__base")
    )


def atoms_view(frames: DataFrame) -> DataFrame:
    """Long form: one row per atom, with the cell of its frame."""
    keep = [
        c for c in ("file", "file_ord", "frame_idx", "natoms", "lattice", "pbc") if c in frames.columns
    ]
    return frames.select(*keep, F.inline("atoms"))


# -- sink --------------------------------------------------------------------


def render_frames(frames: DataFrame) -> DataFrame:
    """One text block per frame, ready to be written.

    The layout that was read is written again with all its columns; fields that were added to the atoms follow it.
    """
    atom = {f.name: f.dataType.simpleString() for f in frames.schema["atoms"].dataType.elementType.fields}
    has_forces = F.exists("atoms", lambda a: a["fx"].isNotNull()) if "fx" in atom else F.lit(False)
    read = F.col("properties") if "properties" in frames.columns else F.lit(None).cast("string")
    info = F.coalesce("info", F.create_map().cast("map<string,string>"))
    named = F.coalesce(tx.info_value(info, "Properties"), read)
    keep = [c for c in ("file_ord", "frame_idx") if c in frames.columns]

    def text(written: Column) -> Column:
        fields = {
            "Lattice": tx.join_floats(F.col("lattice")),
            "energy": F.col("energy").cast("string"),
            "virial": tx.join_floats(F.col("virial")),
            "stress": tx.join_floats(F.col("stress")),
            "uncertainty": F.col("uncertainty").cast("string"),
            "weight": F.col("weight").cast("string"),
            "config_type": F.col("config_type"),
            "pbc": F.array_join(F.transform("pbc", lambda p: F.when(p, "T").otherwise("F")), " "),
            "Properties": written,
        }
        entries = [F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in fields.items()]
        known = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["v"].isNotNull()))
        extra = F.map_filter(info, lambda k, _: ~F.lower(k).isin([f.lower() for f in fields]))
        own = F.coalesce("info_keys", F.array().cast("array<string>"))
        comment = let(F.map_concat(known, extra), lambda m: tx.render_info(m, F.concat(own, F.map_keys(m))))
        atoms = tx.render_atoms(F.col("atoms"), read, written, atom)
        return F.concat_ws("\n", F.size("atoms").cast("string"), comment, atoms)

    return frames.select(*keep, let(tx.render_layout(named, atom, has_forces), text).alias("value"))


def write_frames(frames: DataFrame, path: str, mode: str = "error", raw: bool = False) -> None:
    """Extended-XYZ text in frame order; part files are consecutive ranges of frames.

    ``raw`` writes the text that ``read_frames(raw=True)`` kept, character for character.
    """
    key = [c for c in ("file_ord", "frame_idx") if c in frames.columns]
    # range bounds are sampled from the frames, so text is rendered once, after the exchange
    ordered = frames.repartitionByRange(*key).sortWithinPartitions(*key)
    text = ordered.select(F.col("raw").alias("value")) if raw else render_frames(ordered).select("value")
    text.write.mode(mode).text(path)
