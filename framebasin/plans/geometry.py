"""Distances, RDF, bonds, trajectories, structures, descriptors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cell
from ..operators import descriptors as ds
from ..operators import filters as fl
from ..operators import labels as lb
from ..operators import motion as mo
from ..operators import pairs as pr
from ..operators import smoothing as sm
from ..operators import structures as st
from ..sources.frames import atoms_view
from . import standins as si
from .registry import query
from .standins import ATOMS_SQL, FRAME, FRAMES_SQL, rnd, table

_DIST = "sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z))"
_RA, _RB = si.RANK_SQL.format(s="a.species"), si.RANK_SQL.format(s="b.species")
_PAIRS_SQL = f"""
p AS (SELECT a.frame_idx, a.atom_idx AS i, b.atom_idx AS j,
        CASE WHEN {_RA} <= {_RB} THEN a.species ELSE b.species END AS sa,
        CASE WHEN {_RA} <= {_RB} THEN b.species ELSE a.species END AS sb, {_DIST} AS d
      FROM atoms a JOIN atoms b ON a.frame_idx = b.frame_idx AND a.atom_idx < b.atom_idx)"""


# -- D5, E4, E5, C6 --------------------------------------------------------------


@query(
    "pair_min_distance",
    f"""WITH {ATOMS_SQL}, {_PAIRS_SQL}, r AS (
          SELECT sa, sb, d, frame_idx, row_number() OVER (PARTITION BY sa, sb ORDER BY d, frame_idx) AS rn FROM p)
        SELECT sa, sb, round(d, 6) AS d, frame_idx FROM r WHERE rn = 1""",
)
def pair_min_distance(spark: SparkSession, sf: str) -> DataFrame:
    return pr.pair_min_distance(si.atoms(spark, sf), FRAME).withColumn("d", rnd("d"))


@query(
    "pair_grid",
    f"""WITH {ATOMS_SQL}, {_PAIRS_SQL}, s AS (SELECT DISTINCT species FROM atoms),
        g AS (SELECT a.species AS sa, b.species AS sb FROM s a JOIN s b ON {_RA} <= {_RB}),
        m AS (SELECT sa, sb, min(d) AS d FROM p GROUP BY 1, 2)
        SELECT g.sa, g.sb, round(m.d, 6) AS d FROM g LEFT JOIN m USING (sa, sb)""",
)
def pair_grid(spark, sf):
    return pr.pair_grid(si.atoms(spark, sf), FRAME).select("sa", "sb", rnd("d").alias("d"))


@query(
    "close_pairs",
    f"""WITH {ATOMS_SQL}, {_PAIRS_SQL} SELECT frame_idx, i, j, sa, sb, round(d, 6) AS d FROM p WHERE d <= 5.0""",
)
def close_pairs(spark, sf):
    a, b = pr._ordered_pair(F.col("si"), F.col("sj"))
    return pr.close_pairs(si.atoms(spark, sf), 5.0, FRAME).select(
        "frame_idx", "i", "j", a.alias("sa"), b.alias("sb"), rnd("d").alias("d")
    )


@query(
    "too_close_frames",
    f"""WITH {ATOMS_SQL}, {_PAIRS_SQL} SELECT frame_idx, round(min(d), 6) AS dmin FROM p WHERE d < 2.0 - 1e-9 GROUP BY 1""",
)
def too_close_frames(spark, sf):
    return pr.too_close(si.atoms(spark, sf), 2.0, FRAME).withColumn("dmin", rnd("dmin"))


# periodic in x and y: rounding to the nearest image in a cell (la,0,0 | 1,10,0 | 0,0,12)
_PERIODIC = """
pp AS (SELECT a.frame_idx, a.atom_idx AS i, b.atom_idx AS j, a.la,
         b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz
       FROM fatoms a JOIN fatoms b ON a.frame_idx = b.frame_idx AND a.atom_idx < b.atom_idx),
pf AS (SELECT *, dy / 10.0 AS f1, (dx - dy / 10.0) / la AS f0 FROM pp),
pd AS (SELECT frame_idx, i, j,
         sqrt(power((f0 - round_even(f0, 0)) * la + (f1 - round_even(f1, 0)), 2)
              + power((f1 - round_even(f1, 0)) * 10, 2) + dz * dz) AS d FROM pf)"""


@query(
    "min_distance_filter",
    f"""WITH {FRAMES_SQL}, {_PERIODIC}, m AS (SELECT frame_idx, min(d) AS d FROM pd GROUP BY 1)
        SELECT frame_idx FROM m WHERE d >= 0.35 - 1e-9""",
)
def min_distance_filter(spark, sf):
    return fl.filter_min_distance(si.frames(spark, sf), 0.35).select("frame_idx")


@query(
    "route_distance",
    f"""WITH {FRAMES_SQL}, {_PERIODIC}, m AS (SELECT frame_idx, min(d) AS d FROM pd GROUP BY 1)
        SELECT frame_idx, CASE WHEN d >= 0.35 - 1e-9 THEN 'any' END AS grp,
               CASE WHEN d < 0.35 - 1e-9 THEN 'too_close' END AS reason FROM m""",
)
def route_distance(spark, sf):
    # no frame holds one species only, so the open group takes all and the distance decides
    out = fl.route(si.frames(spark, sf), [["Mo"], []], ["only", "at_least"], max_atoms=100, min_distance=0.35)
    return out.select("frame_idx", "grp", "reason")


@query(
    "periodic_close_pairs",
    f"""WITH {FRAMES_SQL}, {_PERIODIC} SELECT frame_idx, i, j, round(d, 6) AS d FROM pd WHERE d <= 0.8""",
)
def periodic_close_pairs(spark, sf):
    pairs = pr.close_pairs(atoms_view(si.frames(spark, sf)), 0.8)
    return pairs.select("frame_idx", "i", "j", rnd("d").alias("d"))


@query(
    "images_27",
    f"""WITH {FRAMES_SQL}, im AS (SELECT i.range - 1 AS i, j.range - 1 AS j, k.range - 1 AS k FROM range(3) i, range(3) j, range(3) k)
        SELECT a.frame_idx, a.atom_idx AS i, b.atom_idx AS j, round(min(sqrt(power(b.x - a.x - (im.i * a.la + im.j), 2) + power(b.y - a.y - 10 * im.j, 2)
               + power(b.z - a.z - 12 * im.k, 2))), 6) AS d
        FROM fatoms a JOIN fatoms b ON a.frame_idx = b.frame_idx AND a.atom_idx < b.atom_idx, im GROUP BY 1, 2, 3""",
)
def images_27(spark, sf):
    every = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.transform(F.sequence(i + 1, F.lit(20)), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    fr = si.frames(spark, sf).select("frame_idx", "lattice", "atoms", F.inline(every))
    p, q = F.get("atoms", F.col("i")), F.get("atoms", F.col("j"))
    d = cell.min_image_27([q[c] - p[c] for c in "xyz"], F.col("lattice"))
    return fr.select("frame_idx", "i", "j", rnd(d).alias("d"))


# -- D6, D7, E17 -------------------------------------------------------------------

def _nbr_sql(name: str, c: str, o: str, rcut: float) -> str:
    return (
        f"{name} AS (SELECT * FROM (SELECT a.frame_idx, a.atom_idx AS i, b.atom_idx AS j, b.x - a.x AS vx, b.y - a.y AS vy, "
        f"b.z - a.z AS vz, {_DIST} AS d FROM atoms a JOIN atoms b ON a.frame_idx = b.frame_idx "
        f"AND a.species = '{c}' AND b.species = '{o}' AND a.atom_idx <> b.atom_idx) WHERE d < {rcut})"
    )


def _ang_sql(name: str, nbr: str) -> str:
    return (
        f"{name} AS (SELECT a.frame_idx, a.i, a.j AS ja, b.j AS jb, degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, "
        f"(a.vx*b.vx + a.vy*b.vy + a.vz*b.vz) / (a.d * b.d))))) AS angle "
        f"FROM {nbr} a JOIN {nbr} b ON a.frame_idx = b.frame_idx AND a.i = b.i AND a.j < b.j)"
    )


@query(
    "neighbour_angles",
    f"""WITH {ATOMS_SQL}, {_nbr_sql('nb', 'Li', 'Mo', 20.0)}, {_ang_sql('an', 'nb')}
        SELECT frame_idx, i, ja, jb, round(angle, 4) AS angle FROM an""",
)
def neighbour_angles(spark, sf):
    nbr = pr.neighbours(si.atoms(spark, sf), "Li", "Mo", 20.0, FRAME)
    return pr.angles(nbr, FRAME).withColumn("angle", rnd("angle", 4))


@query(
    "bond_angle_stats",
    f"""WITH {ATOMS_SQL}, {_nbr_sql('b2', 'Te', 'Mo', 20.0)}, {_nbr_sql('b1', 'Mo', 'Te', 20.0)},
        {_ang_sql('a2', 'b2')}, {_ang_sql('a1', 'b1')}
        SELECT 'Mo-Te' AS kind, count(*) AS n, round(avg(d), 5) AS mean, round(stddev_samp(d), 5) AS std FROM b2
        UNION ALL SELECT 'Mo-Te-Mo', count(*), round(avg(angle), 5), round(stddev_samp(angle), 5) FROM a2
        UNION ALL SELECT 'Te-Mo-Te', count(*), round(avg(angle), 5), round(stddev_samp(angle), 5) FROM a1""",
)
def bond_angle_stats(spark, sf):
    out = pr.bond_angle_stats(si.atoms(spark, sf), "Mo", "Te", 20.0, FRAME)
    return out.withColumns({"mean": rnd("mean", 5), "std": rnd("std", 5)})


# -- E11-E16 --------------------------------------------------------------------------

_V, _DR = 50000.0, 0.5


def _rdf_sql(where: str = "true", name: str = "g") -> str:
    """CTEs of g(r) over the frames that meet a condition; its name also tells them apart."""
    t = {k: f"{name}_{k}" for k in ("h0", "h", "tops", "bins", "placed", "cnt", "tot", "nf")}
    return f"""
{t['h0']} AS (SELECT sa, sb, d, floor(d / {_DR}) AS b FROM p WHERE sa <> sb AND {where}),
{t['h']} AS (SELECT sa, sb, CAST(CASE WHEN d < b * {_DR} THEN b - 1 WHEN d >= (b + 1) * {_DR} THEN b + 1 ELSE b END AS BIGINT) AS bin, d FROM {t['h0']}),
{t['tops']} AS (SELECT sa, sb, CAST(floor(max(d) / {_DR}) AS BIGINT) AS last FROM {t['h']} GROUP BY 1, 2),
{t['bins']} AS (SELECT sa, sb, last, unnest(range(last)) AS bin FROM {t['tops']}),
{t['placed']} AS (SELECT h.sa, h.sb, CASE WHEN h.bin = t.last AND h.d = h.bin * {_DR} THEN h.bin - 1 ELSE h.bin END AS bin FROM {t['h']} h JOIN {t['tops']} t USING (sa, sb)),
{t['cnt']} AS (SELECT sa, sb, bin, count(*) AS n FROM {t['placed']} GROUP BY 1, 2, 3),
{t['tot']} AS (SELECT species, count(*) AS c FROM atoms WHERE {where} GROUP BY 1),
{t['nf']} AS (SELECT count(DISTINCT frame_idx) AS f FROM atoms WHERE {where}),
{name} AS (SELECT b.sa, b.sb, b.bin, (b.bin + 1) * {_DR}::DOUBLE AS r, coalesce(c.n, 0) AS n,
        coalesce(c.n, 0) / (4 * pi() * power((b.bin + 1) * {_DR}, 2) * {_DR} * (tb.c / f / {_V}) * ta.c) AS g, ta.c AS na, f
      FROM {t['bins']} b LEFT JOIN {t['cnt']} c USING (sa, sb, bin) JOIN {t['tot']} ta ON ta.species = b.sa JOIN {t['tot']} tb ON tb.species = b.sb, {t['nf']})"""


_RDF = _rdf_sql()


def _rdf(spark, sf):
    return pr.rdf_all(si.atoms(spark, sf), _DR, volume=_V, frame=FRAME)


@query("rdf_all", f"WITH {ATOMS_SQL}, {_PAIRS_SQL}, {_RDF} SELECT sa, sb, bin, r, n, round(g, 6) AS g FROM g")
def rdf_all(spark, sf):
    return _rdf(spark, sf).select("sa", "sb", "bin", "r", "n", rnd("g").alias("g"))


@query(
    "rdf_pair",
    f"WITH {ATOMS_SQL}, {_PAIRS_SQL}, {_RDF} SELECT sa, sb, bin, n, round(g, 6) AS g FROM g WHERE sa = 'Mo' AND sb = 'Te'",
)
def rdf_pair(spark, sf):
    g = pr.rdf(si.atoms(spark, sf), "Te", "Mo", _DR, volume=_V, frame=FRAME)
    return g.select("sa", "sb", "bin", "n", rnd("g").alias("g"))


@query(
    "rdf_frame_ranges",
    f"""WITH {ATOMS_SQL}, {_PAIRS_SQL}, {_rdf_sql("frame_idx < 2000", "g1")}, {_rdf_sql("frame_idx >= 2000", "g2")}
        SELECT 'first' AS part, sa, sb, bin, n, round(g, 6) AS g FROM g1 WHERE sa = 'Li' AND sb = 'Mo'
        UNION ALL SELECT 'rest', sa, sb, bin, n, round(g, 6) FROM g2 WHERE sa = 'Li' AND sb = 'Mo'""",
)
def rdf_frame_ranges(spark, sf):
    at = si.atoms(spark, sf)
    parts = []
    for name, lo, hi in (("first", 0, 2000), ("rest", 2000, 1 << 60)):
        g = pr.rdf(at, "Li", "Mo", _DR, frames=(lo, hi), volume=_V, frame=FRAME)
        parts.append(g.select(F.lit(name).alias("part"), "sa", "sb", "bin", "n", rnd("g").alias("g")))
    return parts[0].unionByName(parts[1])


@query(
    "rdf_coordination",
    f"""WITH {ATOMS_SQL}, {_PAIRS_SQL}, {_RDF} SELECT sa, sb, round(sum(n) / max(f) / (max(na) / max(f)), 6) AS cn
        FROM g WHERE r <= 20.0 GROUP BY 1, 2""",
)
def rdf_coordination(spark, sf):
    return pr.coordination_from_rdf(_rdf(spark, sf), 20.0).withColumn("cn", rnd("cn"))


@query(
    "rdf_bond_length",
    f"""WITH {ATOMS_SQL}, {_PAIRS_SQL}, {_RDF} SELECT sa, sb, round(sum((r - {_DR} / 2) * g) / sum(g), 6) AS length
        FROM g WHERE r - {_DR} < 20.0 GROUP BY 1, 2""",
)
def rdf_bond_length(spark, sf):
    return pr.bond_length_from_rdf(_rdf(spark, sf), 20.0, _DR).withColumn("length", rnd("length"))


@query(
    "rdf_first_minimum",
    f"""WITH {ATOMS_SQL}, {_PAIRS_SQL}, {_RDF},
        s AS (SELECT sa, sb, bin, r, avg(g) OVER (PARTITION BY sa, sb ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM g),
        t AS (SELECT *, max(s) OVER (PARTITION BY sa, sb) AS top, lead(s) OVER (PARTITION BY sa, sb ORDER BY bin) > s AS up FROM s),
        u AS (SELECT *, min(CASE WHEN s = top THEN bin END) OVER (PARTITION BY sa, sb) AS peak FROM t)
        SELECT sa, sb, round(min(r), 6) AS rcut FROM u WHERE up AND bin > peak GROUP BY 1, 2""",
)
def rdf_first_minimum(spark, sf):
    return pr.first_minimum(_rdf(spark, sf)).withColumn("rcut", rnd("rcut"))


@query("rdf_spline_minimum")
def rdf_spline_minimum(spark, sf):
    return sm.spline_minimum(_rdf(spark, sf)).withColumn("rcut", rnd("rcut"))


@query(
    "coordination",
    f"""WITH {ATOMS_SQL}, {_nbr_sql('nb', 'Mo', 'Te', 20.0)},
        c AS (SELECT frame_idx, count(*) AS na FROM atoms WHERE species = 'Mo' GROUP BY 1),
        b AS (SELECT frame_idx, count(*) AS n, avg(d) AS length FROM nb GROUP BY 1)
        SELECT frame_idx, round(coalesce(n, 0) / na, 6) AS cn, round(length, 6) AS length FROM c LEFT JOIN b USING (frame_idx)""",
)
def coordination(spark, sf):
    out = pr.coordination(si.atoms(spark, sf), "Mo", "Te", 20.0, FRAME)
    return out.withColumns({"cn": rnd("cn"), "length": rnd("length")})


# -- F4, E18, E19, D8, B20, C10 ---------------------------------------------------------

_POS_SQL = """
pos AS (SELECT user_id AS atom_idx, event_id AS frame_idx, value / 490.03 AS fx,
          CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.7 AS fy, value / 7.13 - floor(value / 7.13) AS fz,
          CASE user_id % 3 WHEN 0 THEN 'Mo' WHEN 1 THEN 'Te' ELSE 'Li' END AS species FROM events),
lagged AS (SELECT *, fx - lag(fx) OVER w AS dx, fy - lag(fy) OVER w AS dy, fz - lag(fz) OVER w AS dz,
             row_number() OVER w - 1 AS step FROM pos WINDOW w AS (PARTITION BY atom_idx ORDER BY frame_idx)),
folded AS (SELECT atom_idx, frame_idx, species, step,
             coalesce(CASE WHEN abs(dx) > 0.5 THEN dx - sign(dx) ELSE dx END, 0) AS ux,
             coalesce(CASE WHEN abs(dy) > 0.5 THEN dy - sign(dy) ELSE dy END, 0) AS uy,
             coalesce(CASE WHEN abs(dz) > 0.5 THEN dz - sign(dz) ELSE dz END, 0) AS uz FROM lagged),
unw AS (SELECT atom_idx, frame_idx, species, step, sum(ux) OVER w AS ux, sum(uy) OVER w AS uy, sum(uz) OVER w AS uz
        FROM folded WINDOW w AS (PARTITION BY atom_idx ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def positions(spark, sf) -> DataFrame:
    """Each user is an atom moving through its events, in fractional coordinates."""
    z = F.col("value") / 7.13
    code = F.col("user_id") % 3
    return table(spark, sf, "events").select(
        F.col("user_id").alias("atom_idx"), F.col("event_id").alias("frame_idx"),
        (F.col("value") / 490.03).alias("fx"),
        (F.get_json_object("props", "$.k").cast("double") / 100.7).alias("fy"),
        (z - F.floor(z)).alias("fz"),
        F.when(code == 0, "Mo").when(code == 1, "Te").otherwise("Li").alias("species"),
    )


@query(
    "unwrap",
    f"""WITH {_POS_SQL} SELECT atom_idx, frame_idx, step, round(ux, 8) AS u_fx, round(uy, 8) AS u_fy, round(uz, 8) AS u_fz FROM unw""",
)
def unwrap(spark, sf):
    out = mo.unwrap(positions(spark, sf), by=["atom_idx"])
    return out.select("atom_idx", "frame_idx", "step", *[rnd(f"u_{a}", 8).alias(f"u_{a}") for a in mo.AXES])


@query(
    "unwrap_msd",
    f"""WITH {_POS_SQL}, c AS (SELECT step, species, ux * 5.1 + uy * 1.3 AS cx, uy * 4.9 AS cy, uz * 7.7 AS cz FROM unw WHERE step > 0),
        m AS (SELECT step, species, avg(cx*cx + cy*cy + cz*cz) AS msd, avg(cx*cx) AS mx, avg(cy*cy) AS my, avg(cz*cz) AS mz FROM c GROUP BY 1, 2)
        SELECT step, species, round(msd, 7) AS msd, round(mx, 7) AS msd_x, round(my, 7) AS msd_y, round(mz, 7) AS msd_z,
               round(sqrt(msd), 7) AS rmsd, round(sqrt(mx), 7) AS rmsd_x, round(sqrt(my), 7) AS rmsd_y, round(sqrt(mz), 7) AS rmsd_z FROM m""",
)
def unwrap_msd(spark, sf):
    lattice = F.array(*[F.lit(v) for v in (5.1, 0.0, 0.0, 1.3, 4.9, 0.0, 0.0, 0.0, 7.7)])
    out = mo.msd(positions(spark, sf), lattice, by=["atom_idx"])
    cols = [f"{m}{s}" for m in ("msd", "rmsd") for s in ("", "_x", "_y", "_z")]
    return out.select("step", "species", *[rnd(c, 7).alias(c) for c in cols])


@query(
    "series_stats",
    """SELECT event_type AS kind, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, max(value) AS max, min(value) AS min
       FROM events GROUP BY 1""",
)
def series_stats(spark, sf):
    out = mo.series_stats(si.events(spark, sf), "uncertainty", ["kind"])
    return out.withColumns({"mean": rnd("mean"), "std": rnd("std")})


@query(
    "time_window",
    """SELECT event_id AS step, round(event_id * 2.0::DOUBLE / 1000, 6) AS time, round(value - 10.5, 6) AS energy FROM events
       WHERE event_id * 2.0::DOUBLE / 1000 BETWEEN 3.0 AND least(12.0, (SELECT max(event_id) * 2.0 / 1000 FROM events))""",
)
def time_window(spark, sf):
    ev = table(spark, sf, "events").select(F.col("event_id").alias("step"), F.col("value").alias("energy"))
    out = mo.filter_time(mo.with_time(ev, 2.0, "ps", 10.5), 3.0, 12.0)
    return out.select("step", rnd("time").alias("time"), rnd("energy").alias("energy"))


_LINK = """
{n} AS (SELECT a.frame_idx, a.la, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM fatoms a JOIN fatoms b
        ON a.frame_idx = b.frame_idx AND a.atom_idx = {i} AND b.atom_idx = {j}),
{n}v AS (SELECT frame_idx, ((dx - dy/10.0)/la - round_even((dx - dy/10.0)/la, 0)) * la + (dy/10.0 - round_even(dy/10.0, 0)) AS vx,
          (dy/10.0 - round_even(dy/10.0, 0)) * 10 AS vy, dz AS vz FROM {n})"""


@query(
    "track_bonds",
    f"""WITH {FRAMES_SQL}, {_LINK.format(n='p', i=0, j=4)}, {_LINK.format(n='q', i=2, j=11)}
        SELECT frame_idx, 0 AS tuple, round(sqrt(vx*vx + vy*vy + vz*vz), 6) AS length FROM pv
        UNION ALL SELECT frame_idx, 1, round(sqrt(vx*vx + vy*vy + vz*vz), 6) FROM qv""",
)
def track_bonds(spark, sf):
    out = mo.track(si.frames(spark, sf), [(1, 5), (3, 12)])
    return out.select("frame_idx", "tuple", rnd("length").alias("length"))


@query(
    "track_angles",
    f"""WITH {FRAMES_SQL}, {_LINK.format(n='p', i=4, j=0)}, {_LINK.format(n='q', i=4, j=9)}
        SELECT pv.frame_idx, 0 AS tuple, round(degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (pv.vx*qv.vx + pv.vy*qv.vy + pv.vz*qv.vz)
          / (sqrt(pv.vx*pv.vx + pv.vy*pv.vy + pv.vz*pv.vz) * sqrt(qv.vx*qv.vx + qv.vy*qv.vy + qv.vz*qv.vz)))))), 4) AS angle
        FROM pv JOIN qv USING (frame_idx)""",
)
def track_angles(spark, sf):
    out = mo.track(si.frames(spark, sf), [(1, 5, 10)])
    return out.select("frame_idx", "tuple", rnd("angle", 4).alias("angle"))


@query(
    "cell_algebra",
    f"""WITH {FRAMES_SQL}, a AS (SELECT frame_idx, atom_idx, la, (x - y/10.0)/la AS f0, y/10.0 AS f1, z/12.0 AS f2 FROM fatoms)
        SELECT frame_idx, atom_idx, round(la * 120, 6) AS volume, round(f0 - floor(f0), 6) AS u, round(f1 - floor(f1), 6) AS v, round(f2 - floor(f2), 6) AS w FROM a""",
)
def cell_algebra(spark, sf):
    at = atoms_view(si.frames(spark, sf))
    frac = cell.to_frac([F.col(c) for c in "xyz"], cell.cell_inverse(F.col("lattice")))
    return at.select(
        "frame_idx", "atom_idx", rnd(cell.cell_volume(F.col("lattice"))).alias("volume"),
        *[rnd(cell.wrap(f)).alias(n) for f, n in zip(frac, "uvw")],
    )


# -- I: structures ------------------------------------------------------------------------


@query(
    "replicate",
    f"""WITH {FRAMES_SQL}, r AS (SELECT frame_idx, atom_idx, x + i.range * la + j.range AS x, y + 10 * j.range AS y, z + 12 * k.range AS z
          FROM fatoms, range(2) i, range(3) j, range(2) k)
        SELECT frame_idx, count(*) AS natoms, round(sum(x), 5) AS sx, round(sum(y), 5) AS sy, round(sum(z), 5) AS sz,
               round(sum(x*x + y*z), 4) AS q FROM r GROUP BY 1""",
)
def replicate(spark, sf):
    at = atoms_view(st.replicate(si.frames(spark, sf), 2, 3, 2))
    return at.groupBy("frame_idx").agg(
        F.count(F.lit(1)).alias("natoms"), *[rnd(F.sum(c), 5).alias(f"s{c}") for c in "xyz"],
        rnd(F.sum(F.col("x") * F.col("x") + F.col("y") * F.col("z")), 4).alias("q"),
    )


_CAND = f"""WITH {FRAMES_SQL}, n AS (SELECT frame_idx, la, 1 + frame_idx % 7 + 14 AS na FROM fr),
  c AS (SELECT frame_idx, na, a.range + 1 AS a, b.range + 1 AS b, c.range + 1 AS c, la, CAST(greatest(1, ceil(power(400.0 / na, 1.0/3) * 5)) AS INTEGER) AS m
        FROM n, range(20) a, range(20) b, range(20) c),
  d AS (SELECT frame_idx, a, b, c, abs(na * a * b * c - 400) AS diff, la * a AS la, sqrt(101.0) * b AS lb, 12.0::DOUBLE * c AS lc FROM c WHERE a <= m AND b <= m AND c <= m),
  e AS (SELECT *, greatest(la, lb, lc) / least(la, lb, lc) AS shape, min(diff) OVER (PARTITION BY frame_idx) AS best FROM d)"""


@query(
    "factors_for_target",
    _CAND
    + """, f AS (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY shape, diff, a, b, c) AS rn FROM e WHERE diff <= greatest(best * 2.0, 400 * 0.03))
    SELECT frame_idx, a AS fa, b AS fb, c AS fc FROM f WHERE rn = 1""",
)
def factors_for_target(spark, sf):
    fr = si.frames(spark, sf).withColumn("natoms", (15 + F.col("frame_idx") % 7).cast("int"))
    return st.factors_for_target(fr, 400).select("frame_idx", "fa", "fb", "fc")


@query(
    "factors_under_cap",
    f"""WITH {FRAMES_SQL}, n AS (SELECT frame_idx, la, 15 + frame_idx % 70 AS na FROM fr),
        k AS (SELECT *, CAST(floor(80.0 / na) AS INTEGER) AS k FROM n),
        c AS (SELECT frame_idx, na, k, x, abs(ln((la * x) / (sqrt(101.0) * (k / x)))) AS score
              FROM k, (SELECT range + 1 AS x FROM range(80)) WHERE x <= greatest(k, 1) AND k % x = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY score, x) AS rn FROM c)
        SELECT frame_idx, CASE WHEN k <= 1 THEN 1 ELSE x END AS fa, CASE WHEN k <= 1 THEN 1 ELSE k // x END AS fb, 1 AS fc,
               CASE WHEN na >= 80 THEN 'at_cap' WHEN k <= 1 THEN 'double_exceeds_cap' ELSE '' END AS note
        FROM r WHERE rn = 1""",
)
def factors_under_cap(spark, sf):
    fr = si.frames(spark, sf).withColumn("natoms", (15 + F.col("frame_idx") % 70).cast("int"))
    return st.factors_under_cap(fr, 80).select("frame_idx", "fa", "fb", "fc", "note")


_DRAW = "CAST(('0x' || substr(md5({text}), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE"


@query(
    "decorate_random",
    f"""WITH {FRAMES_SQL}, z AS (SELECT frame_idx, max(z) AS top, min(z) AS low FROM fatoms WHERE species = 'Te' GROUP BY 1),
        r AS (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY {_DRAW.format(text="'5:0:' || frame_idx || ':' || atom_idx")}, atom_idx) AS rn FROM fatoms WHERE species = 'Te'),
        p AS (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY atom_idx) AS k FROM r WHERE rn <= 4)
        SELECT frame_idx, CAST(20 + k AS INTEGER) AS atom_idx, 'Al' AS species, round(x, 6) AS x, round(y, 6) AS y, round(z + 50.0, 6) AS z
        FROM p WHERE frame_idx IN (SELECT frame_idx FROM z WHERE low + 50.0 > top)""",
)
def decorate_random(spark, sf):
    out = st.decorate(si.frames(spark, sf), "Al", "Te", 50.0, "random", 0.5, seed=5).filter("status = 'ok'")
    rows = out.select("frame_idx", F.inline("atoms")).where("atom_idx >= 21")
    return rows.select("frame_idx", "atom_idx", "species", *[rnd(c).alias(c) for c in "xyz"])


@query(
    "decorate_checker",
    """SELECT vec_id AS frame_idx, CASE WHEN label = 3 THEN 'skip' ELSE 'ok' END AS status,
              CASE WHEN label = 3 THEN 0 ELSE 8 END AS added, 16 + CASE WHEN label = 3 THEN 0 ELSE 8 END AS natoms,
              CASE WHEN label = 3 THEN 0.0 ELSE 8 * 3.5 END AS sum_z FROM embeddings""",
)
def decorate_checker(spark, sf):
    # a 4 x 4 layer of substrate in each frame's own cell
    fr = si.frames(spark, sf).withColumn("__m", F.when(F.col("source") == "md3", "Al").otherwise("Mo"))
    grid = F.transform(
        F.sequence(F.lit(0), F.lit(15)),
        lambda i: F.struct(
            i.alias("atom_idx"), F.when(i == 0, F.when(F.col("__m") == "Al", "Al").otherwise("Mo")).otherwise("Mo").alias("species"),
            (F.floor(i / 4) / 4 * F.get("lattice", F.lit(0)) + (i % 4) / 4 * F.get("lattice", F.lit(3))).alias("x"),
            ((i % 4) / 4 * F.get("lattice", F.lit(4))).alias("y"), F.lit(0.0).alias("z"),
            *[F.lit(None).cast("double").alias(f"f{c}") for c in "xyz"],
        ),
    )
    flat = fr.withColumns({"atoms": grid, "natoms": F.lit(16)})
    out = st.decorate(flat, "Al", "Mo", 3.5, "checker", 0.5, n=4)
    total = F.aggregate("atoms", F.lit(0.0), lambda s, a: s + a["z"])
    return out.select("frame_idx", "status", "added", "natoms", rnd(total).alias("sum_z"))


def _salted(*salt: str) -> str:
    return _DRAW.format(text="'9:0:' || frame_idx || ':' || copy || ':" + ":".join(salt) + "'")


_STRAIN = ", ".join(f"({_salted('strain', str(q))} * 2 - 1) * 0.04 AS e{q}" for q in range(6))
_BALL = "'9:0:' || frame_idx || ':' || copy || ':{salt}:' || atom_idx"


@query(
    "perturb",
    f"""WITH {FRAMES_SQL}, c AS (SELECT fatoms.*, CAST(t.range + 1 AS INTEGER) AS copy FROM fatoms, range(3) t),
        u AS (SELECT *, {_STRAIN}, {_DRAW.format(text=_BALL.format(salt='z'))} * 2 - 1 AS uz, {_DRAW.format(text=_BALL.format(salt='phi'))} * (2 * pi()) AS phi FROM c)
        SELECT frame_idx, copy, atom_idx, round(x * (1 + e0) + y * (e5 / 2) + z * (e4 / 2) + 0.2::DOUBLE * sqrt(1 - uz * uz) * cos(phi), 6) AS x,
          round(x * (e5 / 2) + y * (1 + e1) + z * (e3 / 2) + 0.2::DOUBLE * sqrt(1 - uz * uz) * sin(phi), 6) AS y,
          round(x * (e4 / 2) + y * (e3 / 2) + z * (1 + e2) + 0.2::DOUBLE * uz, 6) AS z, round(la * (1 + e0), 6) AS a_x, round(la * (e4 / 2), 6) AS a_z FROM u""",
)
def perturb(spark, sf):
    out = st.perturb(si.frames(spark, sf), 3, 0.04, 0.2, "const", seed=9)
    rows = out.select("frame_idx", "copy", F.get("lattice", F.lit(0)).alias("a_x"), F.get("lattice", F.lit(2)).alias("a_z"), F.inline("atoms"))
    return rows.select("frame_idx", "copy", "atom_idx", *[rnd(c).alias(c) for c in ("x", "y", "z", "a_x", "a_z")])


# -- descriptors ------------------------------------------------------------------------


@query(
    "mean_descriptor",
    """WITH u AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(64)) AS dim FROM embeddings),
       m AS (SELECT label, dim, avg(v) AS v FROM u GROUP BY 1, 2)
       SELECT label, CAST(dim AS INTEGER) AS dim, round(v, 6) AS v FROM m""",
)
def mean_descriptor(spark, sf):
    emb = table(spark, sf, "embeddings").select("label", F.transform("embedding", lambda v: v.cast("double")).alias("vec"))
    out = ds.mean_descriptor(emb, ["label"])
    return out.select("label", F.posexplode("vec").alias("dim", "v")).withColumn("v", rnd("v"))


_NEAR = """SELECT s.vec_id, round(min(list_distance(CAST(s.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[]))), 6) AS dmin
           FROM embeddings s, embeddings r WHERE s.label <> 0 AND r.label = 0 GROUP BY 1"""


def _near(spark, sf, **kw):
    emb = table(spark, sf, "embeddings")
    out = ds.nearest_reference(emb.filter("label <> 0"), emb.filter("label = 0"), ["vec_id"], "embedding", **kw)
    return out.withColumn("dmin", rnd("dmin"))


@query(
    "factors_least_spread",
    f"""WITH {FRAMES_SQL}, n AS (SELECT DISTINCT la, 1 + frame_idx % 7 + 14 AS na FROM fr),
        c AS (SELECT na, la AS l0, a.range + 1 AS a, b.range + 1 AS b, c.range + 1 AS c, CAST(greatest(1, ceil(power(200.0 / na, 1.0/3) * 5)) AS INTEGER) AS m
              FROM n, range(20) a, range(20) b, range(20) c),
        d AS (SELECT na, l0, a, b, c, abs(na * a * b * c - 200) AS diff, l0 * a AS la, sqrt(101.0) * b AS lb, 12.0::DOUBLE * c AS lc FROM c WHERE a <= m AND b <= m AND c <= m),
        e AS (SELECT *, (la + lb + lc) / 3 AS mean, min(diff) OVER (PARTITION BY na, l0) AS best FROM d),
        s AS (SELECT *, round(sqrt((power(la - mean, 2) + power(lb - mean, 2) + power(lc - mean, 2)) / 3), 10) AS spread FROM e WHERE diff <= greatest(20, best)),
        r AS (SELECT *, row_number() OVER (PARTITION BY na, l0 ORDER BY spread, a, b, c) AS rn FROM s)
        SELECT frame_idx, a AS fa, b AS fb, c AS fc FROM fr JOIN r ON fr.la = r.l0 AND 1 + frame_idx % 7 + 14 = r.na WHERE rn = 1""",
)
def factors_least_spread(spark, sf):
    fr = si.frames(spark, sf).withColumn("natoms", (15 + F.col("frame_idx") % 7).cast("int"))
    return st.factors_for_target(fr, 200, "spread").select("frame_idx", "fa", "fb", "fc")


@query("nearest_reference", _NEAR)
def nearest_reference(spark, sf):
    return _near(spark, sf)


@query("nearest_reference_grouped", _NEAR)
def nearest_reference_grouped(spark, sf):
    return _near(spark, sf, broadcast_bytes=1)


_FPS_REF = """WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label <> 0),
  r AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label = 0),
  w AS (
    SELECT 0 AS step, v.id, v.e, min(list_distance(v.e, r.e)) AS d, CAST(NULL AS BIGINT) AS pick, CAST(NULL AS DOUBLE) AS pd FROM v, r GROUP BY v.id, v.e
    UNION ALL
    SELECT w.step + 1, w.id, w.e, CASE WHEN w.id = p.id THEN -1 ELSE least(w.d, list_distance(w.e, p.e)) END, p.id, p.d
    FROM w, (SELECT id, e, d FROM w ORDER BY d DESC, id LIMIT 1) p WHERE w.step < 60)
  SELECT CAST(step - 1 AS INTEGER) AS step, pick AS vec_id, round(max(pd), 6) AS dist FROM w WHERE step > 0 GROUP BY step, pick"""


@query("fps", _FPS_REF)
def fps(spark, sf):
    emb = table(spark, sf, "embeddings")
    out = ds.farthest_points(
        emb.filter("label <> 0"), "embedding", ["vec_id"], count=60, reference=emb.filter("label = 0")
    )
    return out.withColumn("dist", rnd("dist"))


_CORE = """WITH RECURSIVE v AS (SELECT vec_id AS id, vec_id % 8 AS part, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  w AS (
    SELECT 0 AS step, id, part, e, CAST('inf' AS DOUBLE) AS d, CAST(NULL AS BIGINT) AS pick FROM v
    UNION ALL
    SELECT w.step + 1, w.id, w.part, w.e, CASE WHEN w.id = p.id OR w.d < 0 THEN -1 ELSE least(w.d, list_distance(w.e, p.e)) END, p.id
    FROM w JOIN (SELECT DISTINCT ON (part) part, id, e FROM w ORDER BY part, d DESC, id) p ON w.part = p.part WHERE w.step < 40),
  u AS (SELECT id, e FROM v WHERE id IN (SELECT pick FROM w)),
  x AS (
    SELECT 0 AS step, id, e, CAST('inf' AS DOUBLE) AS d, CAST(NULL AS BIGINT) AS pick, CAST(NULL AS DOUBLE) AS pd FROM u
    UNION ALL
    SELECT x.step + 1, x.id, x.e, CASE WHEN x.id = p.id OR x.d < 0 THEN -1 ELSE least(x.d, list_distance(x.e, p.e)) END, p.id, p.d
    FROM x, (SELECT id, e, d FROM x ORDER BY d DESC, id LIMIT 1) p WHERE x.step < 40)
  SELECT CAST(step - 1 AS INTEGER) AS step, pick AS vec_id, CASE WHEN step > 1 THEN round(max(pd), 6) END AS dist FROM x WHERE step > 0 GROUP BY step, pick"""


@query("fps_coreset", _CORE)
def fps_coreset(spark, sf):
    emb = table(spark, sf, "embeddings")
    out = ds.coreset_points(emb, "embedding", ["vec_id"], count=40, part=F.col("vec_id") % 8)
    return out.withColumn("dist", rnd("dist"))


def _pca_sql(squarings: int = 14) -> str:
    """Two axes by squaring the covariance again and again, the second after the first is taken out of it."""
    out = [
        "d AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)",
        "mu AS (SELECT i, avg(v) AS m FROM d GROUP BY 1)",
        "c AS MATERIALIZED (SELECT vec_id, i, v - m AS v FROM d JOIN mu USING (i))",
        "nv AS (SELECT count(DISTINCT vec_id) - 1 AS n FROM d)",
        "c1 AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.v * b.v) / any_value(n) AS x FROM c a JOIN c b USING (vec_id), nv GROUP BY 1, 2)",
    ]
    for axis in (1, 2):
        out.append(f"m{axis}_0 AS MATERIALIZED (SELECT i, j, x / max(abs(x)) OVER () AS x FROM c{axis})")
        for t in range(squarings):
            square = f"SELECT a.i, b.j, sum(a.x * b.x) AS x FROM m{axis}_{t} a JOIN m{axis}_{t} b ON a.j = b.i GROUP BY 1, 2"
            out.append(f"m{axis}_{t + 1} AS MATERIALIZED (SELECT i, j, x / max(abs(x)) OVER () AS x FROM ({square}))")
        last = f"m{axis}_{squarings}"
        out.append(f"w{axis} AS MATERIALIZED (SELECT i, x FROM {last} WHERE j = (SELECT arg_max(i, x) FROM {last} WHERE i = j))")
        out.append(f"v{axis} AS MATERIALIZED (SELECT i, x / sqrt((SELECT sum(x * x) FROM w{axis})) AS x FROM w{axis})")
        out.append(f"l{axis} AS MATERIALIZED (SELECT sum(a.x * c{axis}.x * b.x) AS l FROM c{axis} JOIN v{axis} a ON a.i = c{axis}.i JOIN v{axis} b ON b.i = c{axis}.j)")
        if axis == 1:
            out.append("c2 AS MATERIALIZED (SELECT c1.i, c1.j, c1.x - l * a.x * b.x AS x FROM c1 JOIN v1 a ON a.i = c1.i JOIN v1 b ON b.i = c1.j, l1)")
    out.append("tr AS (SELECT sum(x) AS t FROM c1 WHERE i = j)")
    return f"""WITH {", ".join(out)}
        SELECT vec_id, round(abs(sum(c.v * v1.x)), 6) AS pc1, round(abs(sum(c.v * v2.x)), 6) AS pc2, any_value(round(l1.l / t, 6)) AS ratio1, any_value(round(l2.l / t, 6)) AS ratio2
        FROM c JOIN v1 ON v1.i = c.i JOIN v2 ON v2.i = c.i, l1, l2, tr GROUP BY 1"""


@query("pca", _pca_sql())
def pca(spark, sf):
    emb = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    out, ratio = ds.pca(emb, 2)
    return out.select(
        "vec_id", *[rnd(F.abs(F.get("pc", F.lit(i)))).alias(f"pc{i + 1}") for i in range(2)],
        *[F.lit(round(r, 6)).alias(f"ratio{i + 1}") for i, r in enumerate(ratio)],
    )


@query(
    "user_descriptor",
    f"""WITH {FRAMES_SQL} SELECT frame_idx, round(avg(x), 6) AS v0, round(avg(y), 6) AS v1, round(avg(z), 6) AS v2 FROM fatoms GROUP BY 1""",
)
def user_descriptor(spark, sf):
    def load():
        import numpy as np

        def model(pdf):
            return [np.array([[a["x"], a["y"], a["z"]] for a in rows]).mean(axis=0) for rows in pdf["atoms"]]

        return model

    fr = si.frames(spark, sf).select("frame_idx", "atoms")
    out = ds.with_descriptor(fr, load)
    return out.select("frame_idx", *[rnd(F.get("vec", F.lit(i))).alias(f"v{i}") for i in range(3)])


# -- species order ------------------------------------------------------------------------


def _order_sql(key: str) -> str:
    return (
        f"WITH {FRAMES_SQL} SELECT frame_idx, row_number() OVER (PARTITION BY frame_idx ORDER BY {key}, atom_idx) - 1 AS atom_idx, "
        "species, round(x, 6) AS x FROM fatoms"
    )


def _ordered(spark, sf, mode, **kw):
    out = lb.reorder_atoms(si.frames(spark, sf), mode, **kw)
    return atoms_view(out).select("frame_idx", "atom_idx", "species", rnd("x").alias("x"))


@query("reorder_alphabetical", _order_sql("species"))
def reorder_alphabetical(spark, sf):
    return _ordered(spark, sf, "alphabetical")


@query("reorder_atomic_number", _order_sql(si.RANK_SQL.format(s="species")))
def reorder_atomic_number(spark, sf):
    return _ordered(spark, sf, "atomic_number")


@query("reorder_preferred", _order_sql("CASE species WHEN 'Te' THEN 0 ELSE 1 END"))
def reorder_preferred(spark, sf):
    return _ordered(spark, sf, "preferred", preferred=["Te"])


@query("reorder_input", _order_sql("CASE species WHEN 'Mo' THEN 0 WHEN 'Te' THEN 1 ELSE 2 END"))
def reorder_input(spark, sf):
    return _ordered(spark, sf, "input")


@query(
    "strip_species",
    f"""WITH {FRAMES_SQL} SELECT frame_idx, row_number() OVER (PARTITION BY frame_idx ORDER BY atom_idx) - 1 AS atom_idx, species, 14 AS natoms
        FROM fatoms WHERE species <> 'Te'""",
)
def strip_species(spark, sf):
    return atoms_view(lb.strip_species(si.frames(spark, sf), "Te")).select("frame_idx", "atom_idx", "species", "natoms")
