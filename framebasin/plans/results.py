"""Frames out of logs: each query writes logs from the embeddings, 21 atoms a step, and reads them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import logs as lg
from ..sources import results as rs
from . import standins as si
from .registry import query
from .standins import rnd, table

_PER_LOG = 64


def _vectors(spark, sf) -> DataFrame:
    e = F.transform("embedding", lambda v: v.cast("double"))
    rows = table(spark, sf, "embeddings").select("vec_id", "label", e.alias("e"))
    return rows.withColumn("bucket", F.floor(F.col("vec_id") / _PER_LOG).cast("int"))


def _s(c: Column) -> Column:
    return c.cast("string")


def _steps(spark, sf, bad: Column) -> DataFrame:
    """One ionic step per vector: stress, cell, positions with forces, energy; ``bad`` steps have an unreadable force."""
    row = lambda i: [_s(10 * F.get("e", 3 * i + k)) for k in range(3)] + [_s(F.get("e", 62 - 3 * i - k)) for k in range(3)]
    body = F.transform(
        F.sequence(F.lit(0), F.lit(20)),
        lambda i: F.concat_ws("  ", F.when(bad & (i == 5), F.lit("1.0  2.0  3.0  ****** 0.5 0.5")).otherwise(F.concat_ws("  ", *row(i)))),
    )
    cell = F.concat_ws("\n", F.concat_ws("  ", _s(10.0 + F.get("e", F.lit(0))), F.lit("0.0 0.0 0.1 0.0 0.0")), F.lit(" 1.0 10.0 0.0 0.0 0.1 0.0\n 0.0 0.0 12.0 0.0 0.0 0.1"))
    return _vectors(spark, sf).withColumn(
        "value",
        F.concat_ws(
            "\n", F.concat(F.lit("  free energy    TOTEN  =  "), _s(F.get("e", F.lit(1))), F.lit(" eV")),
            F.concat(F.lit("  in kB  "), F.concat_ws(" ", *[_s(F.get("e", F.lit(j))) for j in range(6)])),
            F.lit("      direct lattice vectors                 reciprocal lattice vectors"), cell,
            F.lit(" POSITION                                       TOTAL-FORCE (eV/Angst)\n -----------"), F.array_join(body, "\n"),
            F.lit(" -----------\n    total drift:   0.0 0.0 0.0"),
            F.concat(F.lit("  free  energy   TOTEN  =  "), _s(F.get("e", F.lit(63))), F.lit(" eV")),
        ),
    )


_HEAD = "   TITEL  = PAW_PBE Mo_sv 02Feb2006\n   TITEL  = PAW_PBE Te 08Apr2002\n   TITEL  = PAW_PBE Li_sv 10Sep2004\n   ions per type =   4   8   9"


def _logs(steps: DataFrame, name: str, *marks: Column) -> str:
    """A log per bucket; ``marks`` tells where the marker of convergence shows."""
    first = F.when(F.col("vec_id") % _PER_LOG == 0, F.lit(_HEAD))
    shown = [F.when(m, F.lit(lg.EDIFF_MARK)) for m in marks]
    rows = steps.select("bucket", "vec_id", F.concat_ws("\n", first, "value", *shown).alias("value"))
    return si.derive_files(rows, name, "vec_id")


_ATOMS_SQL = """
f AS (SELECT vec_id, vec_id // 64 AS b, i.range AS atom_idx, CAST(embedding AS DOUBLE[]) AS e FROM embeddings, range(21) i),
a AS (SELECT vec_id, b, CAST(atom_idx AS INTEGER) AS atom_idx, CASE WHEN atom_idx < 4 THEN 'Mo' WHEN atom_idx < 12 THEN 'Te' ELSE 'Li' END AS species,
        round(10 * e[3*atom_idx+1], 8) AS x, round(10 * e[3*atom_idx+2], 8) AS y, round(10 * e[3*atom_idx+3], 8) AS z,
        round(e[63-3*atom_idx], 8) AS fx, round(e[62-3*atom_idx], 8) AS fy, round(e[61-3*atom_idx], 8) AS fz,
        round(e[64], 8) AS energy, round(e[4] * (10.0::DOUBLE + e[1]) * 120 / 1602.1766208, 8) AS v_xy, round(10.0::DOUBLE + e[1], 8) AS a_x FROM f)"""
_FRAME = ("energy", "v_xy", "a_x")
_ATOM = ("x", "y", "z", "fx", "fy", "fz")


def _long(frames: DataFrame, *keys: str, coarse: tuple[str, ...] = ()) -> DataFrame:
    v, a = F.get("virial", F.lit(1)), F.get("lattice", F.lit(0))
    rows = frames.select(*keys, "energy", v.alias("v_xy"), a.alias("a_x"), F.inline_outer("atoms"))
    return rows.select(*keys, "atom_idx", "species", *[rnd(c, 6 if c in coarse else 8).alias(c) for c in (*_ATOM, *_FRAME)])


@query(
    "log_frames",
    f"""WITH {_ATOMS_SQL}
        SELECT vec_id, 'ok' AS status, atom_idx, species, x, y, z, fx, fy, fz, energy, v_xy, a_x FROM a WHERE vec_id % 10 <> 7
        UNION ALL SELECT DISTINCT vec_id, 'unreadable', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, energy, v_xy, a_x FROM a WHERE vec_id % 10 = 7""",
)
def log_frames(spark, sf):
    path = _logs(_steps(spark, sf, F.col("vec_id") % 10 == 7), "log-frames", F.lit(True))
    got = rs.outcar_frames(spark, path, "part-*")
    bucket = F.regexp_extract("source", r"(\d+)$", 1).cast("long")
    return _long(got.withColumn("vec_id", bucket * _PER_LOG + F.col("frame_idx")), "vec_id", "status")


@query(
    "collect_frames",
    f"""WITH {_ATOMS_SQL},
        j AS (SELECT b, max(vec_id) AS top, count(DISTINCT vec_id) AS n FROM a GROUP BY 1),
        s AS (SELECT b, top, CASE WHEN b % 4 = 1 THEN 0 WHEN b % 4 = 2 THEN n ELSE 1 END AS marks FROM j),
        t AS (SELECT *, CASE WHEN marks = 0 THEN 'not_converged' WHEN marks > 1 THEN 'repeated' WHEN b % 4 = 3 THEN 'unreadable' ELSE 'ok' END AS status FROM s)
        SELECT 'bucket=' || t.b AS job, status, marks, atom_idx, species, x, y, z, fx, fy, fz, energy, v_xy, a_x
        FROM t LEFT JOIN a ON a.vec_id = t.top AND t.status = 'ok'
        UNION ALL SELECT 'lost=' || b, 'missing', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM t""",
)
def collect_frames(spark, sf):
    b = F.col("bucket") % 4
    steps = _steps(spark, sf, b == 3)
    path = _logs(steps, "collect", (b == 2) | ((b != 1) & (F.col("vec_id") % _PER_LOG == 0)))
    named = steps.select("bucket").distinct()
    jobs = named.select(F.concat(F.lit("bucket="), F.col("bucket")).alias("job")).union(named.select(F.concat(F.lit("lost="), F.col("bucket"))))
    return _long(rs.collect_frames(spark, path, jobs, "part-*"), "job", "status", "marks")


@query(
    "collect_frames_cp2k",
    """WITH f AS (SELECT vec_id, vec_id // 64 AS b, i.range AS i, CAST(embedding AS DOUBLE[]) AS e FROM embeddings, range(21) i),
       r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY vec_id, i) - 1 AS k, first_value(e) OVER (PARTITION BY b ORDER BY vec_id, i) AS h FROM f),
       s AS (SELECT *, CASE b % 7 WHEN 3 THEN 'no_structure' WHEN 4 THEN 'no_stress' WHEN 5 THEN 'no_energy' WHEN 6 THEN 'no_forces' ELSE 'ok' END AS status FROM r)
       SELECT 'bucket=' || b AS job, status, CAST(k AS INTEGER) AS atom_idx, CASE i % 3 WHEN 0 THEN 'Mo' WHEN 1 THEN 'Te' ELSE 'Li' END AS species,
         round(10 * e[3*i+1], 8) AS x, round(10 * e[3*i+2], 8) AS y, round(10 * e[3*i+3], 8) AS z,
         round(e[63-3*i] * 51.4220674763259, 6) AS fx, round(e[62-3*i] * 51.4220674763259, 6) AS fy, round(e[61-3*i] * 51.4220674763259, 6) AS fz,
         round(h[64] * 27.211386245988, 6) AS energy,
         round(h[2] * CASE WHEN b % 2 = 0 THEN 0.0001::DOUBLE ELSE 1 END * CASE b % 7 WHEN 1 THEN 7 * 120 ELSE (8.0::DOUBLE + h[1]) * 72 END / 160.2176634, 8) AS v_xy,
         round(CASE b % 7 WHEN 1 THEN 7 ELSE 8.0::DOUBLE + h[1] END, 8) AS a_x
       FROM s WHERE status = 'ok'
       UNION ALL SELECT DISTINCT 'bucket=' || b, status, NULL::INTEGER, NULL, NULL::DOUBLE, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM s WHERE status <> 'ok'""",
)
def collect_frames_cp2k(spark, sf):
    v, b = _vectors(spark, sf), F.col("bucket") % 7
    names = F.array(*[F.lit(s) for s in si.SPECIES])
    atoms = v.select("bucket", "vec_id", "e", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i"))
    no = (F.col("vec_id") % _PER_LOG) * 21 + F.col("i")
    xyz = F.concat_ws(" ", F.get(names, F.col("i") % 3), *[_s(10 * F.get("e", 3 * F.col("i") + k)) for k in range(3)])
    force = [_s(F.get("e", 62 - 3 * F.col("i") - k)) for k in range(3)]
    # every other bucket prints the old layout
    new_row = F.concat_ws("  ", F.lit(" FORCES|"), _s(no + 1), *force, F.lit("0.5"))
    old_row = F.concat_ws("  ", F.lit("     "), _s(no + 1), F.lit("1   Mo"), *force)
    log_rows = atoms.select("bucket", (no + 10).alias("ord"), F.when(F.col("bucket") % 2 == 0, new_row).otherwise(old_row).alias("value"))
    heads = v.where(F.col("vec_id") % _PER_LOG == 0)
    size = v.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    energy = F.when(b != 5, F.when(F.col("bucket") % 2 == 0, F.concat(F.lit(" ENERGY| Total FORCE_EVAL ( QS ) energy [hartree]  "), _s(F.get("e", F.lit(63))))).otherwise(
        F.concat(F.lit(" ENERGY| Total FORCE_EVAL ( QS ) energy (a.u.):  "), _s(F.get("e", F.lit(63))))))
    opener = F.when(F.col("bucket") % 2 == 0, F.lit(" FORCES| Atomic forces [hartree/bohr]\n FORCES| Atom x y z |f|")).otherwise(
        F.lit(" ATOMIC FORCES in [a.u.]\n\n # Atom   Kind   Element          X              Y              Z")
    )
    unit = F.when(F.col("bucket") % 2 == 0, F.lit("bar")).otherwise(F.lit("GPa"))
    stress = F.concat_ws("\n", F.concat(F.lit(" STRESS| Analytical stress tensor ["), unit, F.lit("]")), *[
        F.concat_ws("  ", F.lit(f" STRESS|  {c}"), *[_s(F.get("e", F.lit(3 * q + k))) for k in range(3)]) for q, c in enumerate("xyz")])
    top = F.concat_ws("\n", energy, F.when(b != 6, opener))
    tail = F.concat_ws("\n", F.lit(" SUM OF ATOMIC FORCES  0 0 0 0"), F.when(b != 4, stress))
    log = log_rows.where(F.col("bucket") % 7 != 6).union(heads.select("bucket", F.lit(0).alias("ord"), top)).union(
        heads.select("bucket", F.lit(1 << 40).alias("ord"), tail)
    )
    xyz_head = heads.join(size, "bucket").select("bucket", F.lit(-1).cast("long").alias("ord"), F.concat_ws("\n", _s(F.col("n") * 21), F.lit('Lattice="7 0 0 0 10 0 0 0 12"')))
    coords = xyz_head.union(atoms.select("bucket", no.cast("long"), xyz))
    cell = F.concat_ws("\n", F.lit("&SUBSYS\n &CELL"), F.concat_ws(" ", F.lit("  A"), _s(8.0 + F.get("e", F.lit(0))), F.lit("0 0")), F.lit("  B 0 8 0\n  C 1 0 9\n &END CELL"))
    deck = heads.select("bucket", F.lit(0).alias("ord"), F.concat_ws("\n", cell, F.when(b == 2, F.lit(" &COORD"))).alias("value"))
    deck = deck.union(atoms.where(F.col("bucket") % 7 == 2).select("bucket", (no + 1).cast("long"), xyz))
    files = log.withColumn("kind", F.lit("log")).union(coords.where(~(F.col("bucket") % 7).isin(2, 3)).withColumn("kind", F.lit("xyz")))
    files = files.union(deck.where(~(F.col("bucket") % 7).isin(1, 3)).withColumn("kind", F.lit("inp"))).toDF("bucket", "ord", "value", "kind")
    path = scratch_path(spark, "cp2k")
    ordered = files.repartition("bucket", "kind").sortWithinPartitions("bucket", "kind", "ord")
    ordered.select("bucket", "kind", "value").write.partitionBy("bucket", "kind").text(path)
    got = rs.collect_frames_cp2k(spark, path, kinds={k: f"/kind={k}/" for k in ("log", "xyz", "inp")}, folder=r"^(.*)/kind=")
    return _long(got, "job", "status", coarse=("fx", "fy", "fz", "energy"))
