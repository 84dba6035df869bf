"""Labelled frames out of calculation logs, read line by line.

Logs are scanned in splits; ``sections`` tells which block a line belongs to. The numbers of a frame meet by the
log and its step, so what is gathered in one row is a frame, never a log.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cell, units
from ..functions import text as tx
from .lines import list_files, scan_lines
from .logs import EDIFF_MARK, scf_status
from .sections import with_sections

_NUM = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_SIX = rf"^\s*{_NUM}(?:\s+{_NUM}){{5}}\s*$"
# Marker texts of OUTCAR files. The energy of an ionic step has two blanks after "free".
LATTICE_MARK = "direct lattice vectors"
POSITION_MARK, FORCE_MARK = "POSITION", "TOTAL-FORCE"
SPECIES_LINE = r"TITEL\s*=\s*\S+\s+([A-Z][a-z]?)"
COUNT_LINE = r"ions per type\s*=\s*((?:\d+\s*)+)$"
ENERGY_LINE = rf"free  energy\s+TOTEN\s*=\s*({_NUM})"
STRESS_LINE = rf"in kB((?:\s+{_NUM}){{6}})"


def _job(path: str = "file") -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def _found(pattern: str) -> Column:
    return F.nullif(F.regexp_extract("line", pattern, 1), F.lit(""))


def _atoms(species: Column, positions: Column, forces: Column) -> Column:
    """Atom structs from species, rows of three coordinates and rows of three forces (shorter: NULL)."""

    def one(s: Column, i: Column) -> Column:
        p, f = F.get(positions, i), F.get(forces, i)
        return F.struct(
            i.cast("int").alias("atom_idx"), s.alias("species"),
            *[F.get(p, F.lit(k)).alias(c) for k, c in enumerate("xyz")],
            *[F.get(f, F.lit(k)).alias(f"f{c}") for k, c in enumerate("xyz")],
        )

    return F.transform(species, one)


def _outcar_lines(spark: SparkSession, root, name: str, **options) -> DataFrame:
    scan = scan_lines(spark, root, recursiveFileLookup="true", pathGlobFilter=name, **options)
    line = F.col("line")
    position = line.contains(POSITION_MARK) & line.contains(FORCE_MARK)
    marks = [line.contains(m) for m in ("TITEL", "ions per type", "TOTEN", "in kB", EDIFF_MARK)]
    keep = line.rlike(_SIX)
    for m in marks:
        keep = keep | m
    return with_sections(scan, {"lattice": line.contains(LATTICE_MARK), "position": position}, keep, {"step": position})


def _steps(lines: DataFrame, newest: bool) -> DataFrame:
    """One row per log and ionic step with its rows, cell, energy and stress."""
    six = tx.floats(F.col("line"))
    in_cell = (F.col("section") == "lattice") & F.col("at").between(1, 3)
    stress = _found(STRESS_LINE)
    # cell and stress of a step are printed before its positions, the energy after them
    step = F.col("step") + F.when((F.col("section") == "lattice") | stress.isNotNull(), 1).otherwise(0)
    rows = lines.withColumns({"step": step, "__six": F.when(F.col("line").rlike(_SIX), six), "__stress": stress, "__energy": _found(ENERGY_LINE)})
    if newest:  # the rows of earlier steps stay behind; a cell may be older than the step
        last = lines.groupBy("file").agg(F.max("step").alias("__top"))
        rows = rows.join(last, "file").where((F.col("step") == F.col("__top")) | (F.col("section") == "lattice")).drop("__top")
    body = (F.col("section") == "position") & (F.col("at") >= 2) & F.col("__six").isNotNull()
    grouped = rows.where("step > 0").groupBy("file", "step").agg(
        F.array_sort(F.collect_list(F.when(body, F.struct("at", F.col("__six").alias("v"))))).alias("rows"),
        F.array_sort(F.collect_list(F.when(in_cell & F.col("__six").isNotNull(), F.struct("opened", "at", F.col("__six").alias("v"))))).alias("cells"),
        F.max_by("__energy", F.when(F.col("__energy").isNotNull(), F.col("line_no"))).try_cast("double").alias("energy"),
        F.max_by("__stress", F.when(F.col("__stress").isNotNull(), F.col("line_no"))).alias("kbar"),
        F.count_if((F.col("section") == "position") & (F.col("at") == 0)).alias("shown"),
    )
    latest = F.filter("cells", lambda c: c["opened"] == F.get("cells", F.size("cells") - 1)["opened"])
    own = F.when(F.size(latest) == 3, F.flatten(F.transform(latest, lambda c: F.slice(c["v"], 1, 3))))
    by_step = Window.partitionBy("file").orderBy("step")
    held = grouped.withColumn("lattice", F.last(own, ignorenulls=True).over(by_step))
    return held.where("shown > 0").drop("cells", "shown")


def outcar_frames(spark: SparkSession, root, name: str = "OUTCAR", newest: bool = False, **options) -> DataFrame:
    """Frames of all OUTCAR files below ``root``: a row per ionic step (or the last one only), keyed by (file, frame_idx).

    ``status`` is ok, or unreadable where rows, cell, energy or stress are missing or do not fit the atom counts of the
    log. Virial is -stress * V (eV), from the step's own stress and cell.
    """
    return _frames(_outcar_lines(spark, root, name, **options), newest)


def _frames(lines: DataFrame, newest: bool) -> DataFrame:
    """``outcar_frames`` from lines with their sections."""
    symbol, counts = _found(SPECIES_LINE), _found(COUNT_LINE)
    heads = lines.groupBy("file").agg(
        F.array_sort(F.collect_list(F.when(symbol.isNotNull(), F.struct("line_no", symbol.alias("s"))))).alias("titles"),
        F.max_by(counts, F.when(counts.isNotNull(), F.col("line_no"))).alias("counts"),
    )
    number = F.transform(F.split(F.trim("counts"), r"\s+"), lambda c: c.try_cast("int"))
    named = F.transform(number, lambda n, i: F.array_repeat(F.get("titles", i)["s"], n))
    heads = heads.select("file", F.flatten(named).alias("species"))
    frames = _steps(lines, newest).join(heads, "file", "left")
    n = F.size("species")
    rows = F.filter("rows", lambda r: r["at"] < n + 2)
    stress = units.voigt_to_9(tx.floats(F.col("kbar")), "xx,yy,zz,xy,yz,zx")
    virial = units.stress_to_virial(stress, cell.cell_volume(F.col("lattice")), "kbar")
    ok = (n > 0) & (F.size(rows) == n) & F.col("lattice").isNotNull() & F.col("energy").isNotNull() & stress.isNotNull()
    ok = ok & ~F.exists("species", lambda s: s.isNull())
    part = lambda k: F.transform(rows, lambda r: F.slice(r["v"], k, 3))
    yes = F.lit(True)
    return frames.select(
        "file", _job().alias("source"), (F.col("step") - 1).cast("long").alias("frame_idx"),
        F.when(F.coalesce(ok, F.lit(False)), "ok").otherwise("unreadable").alias("status"),
        n.alias("natoms"), "lattice", F.array(yes, yes, yes).alias("pbc"), "energy", virial.alias("virial"),
        F.when(ok, _atoms(F.col("species"), part(1), part(4))).alias("atoms"),
    )


def collect_frames(spark: SparkSession, root, jobs: DataFrame, name: str = "OUTCAR", **options) -> DataFrame:
    """For every job its status and, where that is ok, the newest frame with positions, cell, forces, energy, virial.

    ``jobs`` names the folders (``job``) that were run. Status: ok, missing (no log), not_converged (no marker),
    repeated (several), unreadable (the newest frame is incomplete).
    """
    lines = _outcar_lines(spark, root, name, **options)
    status = scf_status(lines.withColumn("job", _job()), jobs)
    frames = _frames(lines, newest=True).withColumnsRenamed({"source": "job", "status": "__frame"})
    met = status.join(frames, "job", "left")
    good = (F.col("status") == "ok") & (F.col("__frame") == "ok")
    reason = F.when((F.col("status") == "ok") & ~F.coalesce(good, F.lit(False)), "unreadable").otherwise(F.col("status"))
    labels = ("file", "frame_idx", "natoms", "lattice", "pbc", "energy", "virial", "atoms")
    return met.select("job", reason.alias("status"), "marks", *[F.when(good, F.col(c)).alias(c) for c in labels])


# -- CP2K ------------------------------------------------------------------------------

# Marker texts of CP2K logs in new and old layout.
CP2K_ENERGY = (rf"ENERGY\| Total FORCE_EVAL \(.*?\) energy \[hartree\]\s+({_NUM})", rf"ENERGY\| Total FORCE_EVAL.*:\s+({_NUM})")
CP2K_FORCES = ("FORCES| Atomic forces [hartree/bohr]", "ATOMIC FORCES in [a.u.]", "SUM OF ATOMIC FORCES")
CP2K_STRESS_UNIT = r"STRESS\|\s+Analytical stress tensor\s+\[(GPa|bar)\]"
CP2K_STRESS_ROW = rf"(?i)STRESS\|\s+[xyz]\s+({_NUM}\s+{_NUM}\s+{_NUM})"


# Endings of the log, the coordinate and the input file of a job, and the folder of a job.
CP2K_KINDS = {"log": r"\.log$", "xyz": r"\.xyz$", "inp": r"\.inp$"}
CP2K_FOLDER = r"^(.*)/[^/]+$"


def _chosen(spark: SparkSession, root, kinds: Mapping[str, str], folder: str, **options) -> DataFrame:
    """The log, coordinate and input file used in each folder that has a log (``file, folder, kind``)."""
    files = list_files(spark, root, **options).where("bytes > 0")
    kind = F.coalesce(*[F.when(F.col("file").rlike(p), F.lit(k)) for k, p in kinds.items()])
    named = files.select("file", F.regexp_extract("file", folder, 1).alias("folder"), kind.alias("kind"), "file_ord").where("kind IS NOT NULL")
    rank = F.struct(F.when(F.col("file").endswith("/cp2k.log"), 0).otherwise(1).alias("other"), "file_ord")
    one = named.groupBy("folder", "kind").agg(F.min_by("file", rank).alias("file"))
    return one.withColumn("__log", F.count_if(F.col("kind") == "log").over(Window.partitionBy("folder"))).where("__log > 0").drop("__log")


def _rows(section: str, first: int, least: int) -> Column:
    """Sorted rows of the first section of a kind: number, first token, three numbers from token ``first`` on."""
    tokens = F.split(F.trim("line"), r"\s+")
    used = (F.col("section") == section) & (F.size(tokens) >= least) & (F.col("at") > 0)
    numbers = F.transform(F.slice(tokens, first + 1, 3), lambda t: t.try_cast("double"))
    row = F.struct("opened", "line_no", tokens.alias("t"), numbers.alias("v"))
    return F.array_sort(F.collect_list(F.when(used, row)))


def _first_section(rows: Column) -> Column:
    return F.filter(rows, lambda r: r["opened"] == F.get(rows, F.lit(0))["opened"])


def _whole(rows: Column) -> Column:
    """Whether every row has three numbers."""
    return ~F.exists(rows, lambda r: F.exists(r["v"], lambda x: x.isNull()))


def collect_frames_cp2k(
    spark: SparkSession, root, legacy: bool = False, kinds: Mapping[str, str] = CP2K_KINDS, folder: str = CP2K_FOLDER
) -> DataFrame:
    """A row per folder with a log: ``status`` (ok or why not) and the labelled frame.

    ``kinds`` and ``folder`` are patterns on paths that tell the files of a job apart and name its folder.

    Atoms come from the coordinate file and the cell from the input file; without one of them the other gives both.
    Energy and forces are the first of the log, in new or old layout; without a cell volume and virial are 0. Atoms
    beyond the printed forces have none.
    """
    options = {"recursiveFileLookup": "true"} | ({"pathGlobFilter": "*.{log,xyz,inp}"} if kinds is CP2K_KINDS else {})
    chosen = _chosen(spark, root, kinds, folder, **options)
    scan = scan_lines(spark, root, **options).join(chosen, "file")
    line = F.col("line")
    is_log, is_inp, is_xyz = (F.col("kind") == k for k in ("log", "inp", "xyz"))
    openers = {
        "coord": is_inp & line.rlike(r"(?i)^\s*&COORD\b"),
        "cell": is_inp & line.rlike(r"(?i)^\s*&CELL\b"),
        "other": is_inp & line.rlike(r"^\s*&"),
        "new": is_log & F.ltrim("line").startswith(CP2K_FORCES[0]),
        "old": is_log & line.contains(CP2K_FORCES[1]),
        "end": is_log & line.contains(CP2K_FORCES[2]),
    }
    keep = ~is_log | line.rlike(rf"^\s*(FORCES\||\d+\s+\d+\s+\S+\s+{_NUM})") | line.contains("ENERGY|") | line.contains("STRESS|")
    rows = with_sections(scan, openers, keep).join(chosen, "file")
    stress = _found(CP2K_STRESS_ROW)
    e_new, e_old = (_found(p) for p in CP2K_ENERGY)
    no = F.col("line_no")
    first_of = lambda c: F.min_by(c, F.when(c.isNotNull(), no))
    tokens = F.split(F.trim("line"), r"\s+")
    is_row = is_xyz & (no >= 2) & (F.size(tokens) >= 4)
    in_coord = (F.col("section") == "coord") & (F.col("at") > 0) & ~line.startswith("#") & (F.size(tokens) >= 4)
    axis = (F.col("section") == "cell") & line.rlike(rf"(?i)^\s*[ABC]\s+{_NUM}")
    three = lambda at: F.transform(F.slice(tokens, at, 3), lambda t: t.try_cast("double"))
    lattice_text = _found(r'Lattice="([^"]+)"')
    log = rows.groupBy("folder").agg(
        F.coalesce(first_of(e_new), first_of(e_old)).try_cast("double").alias("hartree"),
        _rows("new", 2, 5).alias("new"),
        _rows("old", 3, 6).alias("old"),
        F.max(_found(CP2K_STRESS_UNIT)).alias("unit"),
        F.array_sort(F.collect_list(F.when(stress.isNotNull(), F.struct(no, tx.floats(stress).alias("v"))))).alias("stress"),
        F.max(F.when(is_xyz & (no == 0), F.trim("line"))).try_cast("int").alias("n_xyz"),
        F.array_sort(F.collect_list(F.when(is_row, F.struct("line_no", tokens.alias("t"), three(2).alias("v"))))).alias("xyz"),
        first_of(lattice_text).alias("lattice_xyz"),
        F.max(is_inp).alias("has_inp"),
        F.array_sort(F.collect_list(F.when(in_coord, F.struct("line_no", tokens.alias("t"), three(2).alias("v"))))).alias("inp"),
        F.array_sort(F.collect_list(F.when(axis, F.struct(F.upper(F.get(tokens, F.lit(0))).alias("a"), three(2).alias("v"))))).alias("axes"),
    )
    zeros = F.array(*[F.lit(0.0)] * 9)
    xyz_rows = F.filter("xyz", lambda r: r["line_no"] < F.col("n_xyz") + 2)
    xyz_cell = F.when(F.col("lattice_xyz").isNull(), zeros).otherwise(tx.floats(F.col("lattice_xyz")))
    xyz_ok = (F.size(xyz_rows) > 0) & _whole(xyz_rows) & xyz_cell.isNotNull()
    inp_cell = F.when(F.size("axes") == 3, F.flatten(F.transform("axes", lambda r: r["v"]))).otherwise(zeros)
    inp_good = F.col("has_inp") & _whole(F.col("inp")) & ~F.exists(inp_cell, lambda x: x.isNull())
    inp_ok = inp_good & (F.size("inp") > 0)
    atoms = F.when(xyz_ok, F.transform(xyz_rows, lambda r: F.struct(r["t"], r["v"]))).when(
        inp_ok, F.transform("inp", lambda r: F.struct(r["t"], r["v"]))
    )
    lattice = F.when(xyz_ok & inp_good, inp_cell).when(xyz_ok, xyz_cell).when(inp_ok, inp_cell)
    new_rows = F.filter(_first_section(F.col("new")), lambda r: F.get(r["t"], F.lit(1)).rlike(r"^\d+$") & F.get(r["t"], F.lit(0)).startswith("FORCES|"))
    old_rows = F.filter(_first_section(F.col("old")), lambda r: F.get(r["t"], F.lit(0)).rlike(r"^\d+$"))
    suffix = "_legacy" if legacy else ""
    factor = units._FORCE[f"hartree/bohr{suffix}"]
    forces = F.when(F.size(new_rows) > 0, new_rows).otherwise(old_rows)
    flat = F.flatten(F.transform(F.slice("stress", 1, 3), lambda r: r["v"]))
    gpa = F.when(F.col("unit") == "GPa", flat).when(F.col("unit") == "bar", F.transform(flat, lambda v: v * units.BAR_GPA))
    parsed = log.select(
        "folder", atoms.alias("rows"), lattice.alias("lattice"), units.to_ev(F.col("hartree"), f"hartree{suffix}").alias("energy"),
        F.transform(forces, lambda r: F.transform(r["v"], lambda x: x * factor)).alias("forces"),
        F.when(F.size(gpa) == 9, gpa).alias("gpa"),
    )
    no_energy, no_forces = F.col("energy").isNull(), F.size("forces") == 0
    status = (
        F.when(F.col("rows").isNull(), "no_structure")
        .when(F.col("gpa").isNull(), "no_stress")
        .when(no_energy & no_forces, "no_energy_and_forces")
        .when(no_energy, "no_energy")
        .when(no_forces, "no_forces")
        .otherwise("ok")
    )
    yes, ok = F.lit(True), F.col("status") == "ok"
    volume = cell.cell_volume(F.col("lattice"))
    virial = F.when(volume > 0, units.stress_to_virial(F.col("gpa"), volume, "gpa")).otherwise(zeros)
    species = F.transform("rows", lambda r: F.get(r["t"], F.lit(0)))
    framed = _atoms(species, F.transform("rows", lambda r: r["v"]), F.col("forces"))
    fields = {
        "natoms": F.size("rows"), "lattice": F.col("lattice"), "pbc": F.array(yes, yes, yes), "energy": F.col("energy"),
        "virial": virial, "atoms": framed,
    }
    return parsed.withColumn("status", status).select(
        "folder", F.regexp_extract("folder", r"([^/]+)$", 1).alias("job"), "status", *[F.when(ok, c).alias(n) for n, c in fields.items()]
    )
