"""Calculation logs: line corpora, convergence rules, collected results, JSON results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cell, text as tx, units
from .lines import read_lines

# Marker texts in the logs.
EDIFF_MARK = "aborting loop because EDIFF is reached"
NSW_MARK = "number of steps for IOM"
NELM_MARK = "of ELM steps"
ITERATION_MARK = "Iteration"
ABACUS_STEP = "ALGORITHM"
ABACUS_DONE = "Total  Time"
ABACUS_NMAX = 100


def read_logs(spark: SparkSession, root, name: str = "OUTCAR") -> DataFrame:
    """``path, job, line_no, line`` of all files of one name below ``root``; the job is the folder."""
    lines = read_lines(spark, root, recursiveFileLookup="true", pathGlobFilter=name)
    return lines.select(
        F.col("file").alias("path"), F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("job"), "line_no", "line"
    )


def read_log_texts(spark: SparkSession, root, name: str) -> DataFrame:
    """``path, job, text``, one whole log per row (a log is one job's output)."""
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=name)
    path = F.col("_metadata.file_path")
    return rows.select(
        path.alias("path"), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("job"), F.col("value").alias("text")
    )


def scf_status(logs: DataFrame, jobs: DataFrame | None = None, mark: str = EDIFF_MARK, by: str = "job") -> DataFrame:
    """A job is ok when the marker shows on exactly one line; jobs without a log are listed as missing."""
    marks = logs.groupBy(by).agg(F.count_if(F.col("line").contains(mark)).alias("marks"))
    if jobs is not None:
        marks = jobs.select(by).distinct().join(marks, by, "left")
    m = F.col("marks")
    status = F.when(m.isNull(), "missing").when(m == 1, "ok").when(m == 0, "not_converged").otherwise("repeated")
    return marks.select(by, "marks", status.alias("status"))


def outcar_status(logs: DataFrame, by: str = "job") -> DataFrame:
    """Unreadable NSW or NELM -> no; NSW not 0 -> yes; else marker present and iterations < NELM."""
    line = F.col("line")

    def setting(found: Column, pattern: str) -> Column:
        value = F.regexp_extract(line, pattern, 1).try_cast("int")
        return F.max_by(value, F.when(found & value.isNotNull(), F.col("line_no")))

    stats = logs.groupBy(by).agg(
        setting(line.contains(NSW_MARK), r"=\s*(-?\d+)(?:\s|$)").alias("nsw"),
        setting(line.contains("NELM") & line.contains(NELM_MARK), r"^[^=]*=\s*(-?\d+)\s*(?:;|$)").alias("nelm"),
        F.count_if(line.contains(ITERATION_MARK)).alias("steps"),
        (F.count_if(line.contains(EDIFF_MARK)) > 0).alias("marked"),
    )
    ok = (
        F.when(F.col("nsw").isNull() | F.col("nelm").isNull(), False)
        .when(F.col("nsw") != 0, True)
        .otherwise(F.col("marked") & (F.col("steps") < F.col("nelm")))
    )
    return stats.withColumn("converged", ok)


def _occurrences(line: Column, word: str) -> Column:
    return F.regexp_count(line, F.lit(word))


def abacus_status(logs: DataFrame, inputs: DataFrame | None = None, by: str = "job") -> DataFrame:
    """Not converged when the steps reach nmax or the finish marker is absent.

    ``inputs`` are lines of the job's settings; without ``scf_nmax`` there it is 100.
    """
    stats = logs.groupBy(by).agg(
        F.sum(_occurrences(F.col("line"), ABACUS_STEP)).alias("steps"),
        F.sum(_occurrences(F.col("line"), ABACUS_DONE)).alias("done"),
    )
    if inputs is not None:
        given = F.regexp_extract("line", r"scf_nmax\s+(\d+)", 1).try_cast("int")
        nmax = inputs.filter(F.col("line").contains("scf_nmax")).groupBy(by).agg(F.max_by(given, F.col("line_no")).alias("nmax"))
        stats = stats.join(nmax, by, "left")
    else:
        stats = stats.withColumn("nmax", F.lit(None).cast("int"))
    limit = F.coalesce("nmax", F.lit(ABACUS_NMAX))
    bad = (F.col("steps") == limit) | (F.col("done") == 0)
    return stats.select(by, "steps", "done", limit.alias("nmax"), (~bad).alias("converged"))


# -- results ----------------------------------------------------------------------

_NUMBER = r"([-+]?\d[\d.]*(?:[eE][-+]?\d+)?|[-+]?\.\d+(?:[eE][-+]?\d+)?)"


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def collect_cp2k(texts: DataFrame, volume: Column | None = None, legacy: bool = False) -> DataFrame:
    """Energy (eV), forces (eV/A) and virial (eV) of CP2K logs in old and new layout.

    ``texts`` holds ``job, text`` and, for the virial, ``lattice``.
    """
    t = F.col("text")
    suffix = "_legacy" if legacy else ""
    energy = F.coalesce(
        _first(t, rf"ENERGY\| Total FORCE_EVAL \(.*?\) energy \[hartree\]\s+{_NUMBER}"),
        _first(t, rf"ENERGY\| Total FORCE_EVAL[^\n]*?:\s+{_NUMBER}"),
    ).try_cast("double")
    new_rows = F.regexp_extract_all(t, F.lit(rf"(?m)^\s*FORCES\|\s+\d+\s+{_NUMBER}\s+{_NUMBER}\s+{_NUMBER}"), F.lit(0))
    old_block = F.regexp_extract(t, r"(?s)ATOMIC FORCES in \[a\.u\.\](.*?)SUM OF ATOMIC FORCES", 1)
    old_rows = F.regexp_extract_all(old_block, F.lit(rf"(?m)^\s*\d+\s+\d+\s+\S+\s+{_NUMBER}\s+{_NUMBER}\s+{_NUMBER}"), F.lit(0))

    def forces(rows: Column, start: int) -> Column:
        factor = units._FORCE[f"hartree/bohr{suffix}"]

        def one(line: Column) -> Column:
            tok = F.split(F.trim(line), r"\s+")
            return F.struct(*[(F.get(tok, F.lit(start + k)).try_cast("double") * factor).alias(c) for k, c in enumerate(("fx", "fy", "fz"))])

        return F.transform(rows, one)

    srows = F.regexp_extract_all(t, F.lit(rf"(?i)STRESS\|\s+[xyz]\s+{_NUMBER}\s+{_NUMBER}\s+{_NUMBER}"), F.lit(0))
    nums = F.flatten(
        F.transform(F.slice(srows, 1, 3), lambda r: F.transform(F.slice(F.split(F.trim(r), r"\s+"), 3, 3), lambda v: v.try_cast("double")))
    )
    unit = _first(t, r"STRESS\|\s+Analytical stress tensor\s+\[(GPa|bar)\]")
    gpa = F.when(unit == "GPa", nums).when(unit == "bar", F.transform(nums, lambda v: v * units.BAR_GPA))
    out = texts.select(
        *[c for c in texts.columns if c != "text"],
        units.to_ev(energy, f"hartree{suffix}").alias("energy"),
        F.when(F.size(new_rows) > 0, forces(new_rows, 2)).otherwise(forces(old_rows, 3)).alias("forces"),
        F.when(F.size(gpa) == 9, gpa).alias("stress_gpa"),
    )
    if "lattice" in texts.columns:
        out = out.withColumn("virial", units.stress_to_virial(F.col("stress_gpa"), cell.cell_volume(F.col("lattice")), "gpa"))
    return out


def collect_results(logs: DataFrame, jobs: DataFrame, by: str = "job") -> DataFrame:
    """Converged jobs with their last free energy and virial, the others with the reason.

    Virial is -stress * V, from the last stress line (kB, order xx yy zz xy yz zx)
    and the last volume.
    """
    line, no = F.col("line"), F.col("line_no")

    def last(pattern: str) -> Column:
        hit = _first(line, pattern)
        return F.max_by(hit, F.when(hit.isNotNull(), no))

    found = logs.groupBy(by).agg(
        last(rf"free\s+energy\s+TOTEN\s*=\s*{_NUMBER}").try_cast("double").alias("energy"),
        last(rf"volume of cell\s*:\s*{_NUMBER}").try_cast("double").alias("volume"),
        last(r"in kB((?:\s+[-+]?\d+\.?\d*(?:[eE][-+]?\d+)?){6})").alias("__s"),
    )
    status = scf_status(logs, jobs, by=by)
    stress = units.voigt_to_9(tx.floats(F.col("__s")), "xx,yy,zz,xy,yz,zx")
    # the log prints pressure-like stress, positive under compression, so the signs cancel
    virial = units.stress_to_virial(stress, F.col("volume"), "kbar")
    ok = F.col("status") == "ok"
    return status.join(found, by, "left").select(
        by, "status", "marks", F.when(ok, F.col("energy")).alias("energy"), F.when(ok, virial).alias("virial")
    )


ABACUS_SCHEMA = (
    "init struct<natom:int,label:array<string>>,"
    "output array<struct<energy:double,cell:array<array<double>>,coordinate:array<array<double>>,"
    "force:array<array<double>>,stress:array<array<double>>,scf:array<struct<energy:double>>>>"
)


def read_abacus_json(spark: SparkSession, paths, nmax: int = ABACUS_NMAX, **options) -> DataFrame:
    """Frames of ABACUS JSON results (one document per file); virial from kbar stress.

    ``converged`` is false when the number of SCF steps equals ``nmax``.
    """
    docs = spark.read.options(multiLine="true", **options).schema(ABACUS_SCHEMA).json(paths)
    o = F.get("output", F.lit(0))
    rows = docs.select(F.col("_metadata.file_path").alias("file"), "init", o.alias("o"))
    lattice = F.flatten("o.cell")
    atoms = F.transform(
        "o.coordinate",
        lambda p, i: F.struct(
            i.cast("int").alias("atom_idx"), F.get("init.label", i).alias("species"),
            *[F.get(p, F.lit(k)).alias(c) for k, c in enumerate("xyz")],
            *[F.get(F.get("o.force", i), F.lit(k)).alias(f"f{c}") for k, c in enumerate("xyz")],
        ),
    )
    framed = rows.select("file", F.col("init.natom").alias("natoms"), F.col("o.energy").alias("energy"),
                         lattice.alias("lattice"), F.flatten("o.stress").alias("kbar"), atoms.alias("atoms"),
                         (F.size("o.scf") != nmax).alias("converged"))
    return framed.withColumn(
        "virial", units.stress_to_virial(F.col("kbar"), cell.cell_volume(F.col("lattice")), "kbar")
    ).drop("kbar")
