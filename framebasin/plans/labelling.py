"""Labels, metadata, prediction errors, energies, bands and level tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cell, elements, text as tx, units
from ..operators import energy as en
from ..operators import filters as fl
from ..operators import labels as lb
from ..operators import levels as lv
from ..operators import metrics as mt
from ..sources import tables as tb
from ..sources.frames import atoms_view, frame_numbers
from . import standins as si
from .registry import query
from .standins import FRAMES_SQL, SPECIES_SQL, rnd, table

# -- B: metadata ------------------------------------------------------------------


@query(
    "keep_info",
    """SELECT vec_id AS frame_idx, 'Time=' || (vec_id * 5) AS info, 'Time,Lattice' AS keys FROM embeddings""",
)
def keep_info(spark, sf) -> DataFrame:
    out = lb.keep_info(si.frames(spark, sf))
    pairs = F.array_join(F.transform(F.map_entries("info"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.select("frame_idx", pairs.alias("info"), F.array_join("info_keys", ",").alias("keys"))


@query(
    "drop_labels",
    """SELECT vec_id AS frame_idx, round(CAST(embedding[64] AS DOUBLE), 6) AS energy, 2 AS removed_keys, true AS removed_forces,
              'Time,vec' AS keys, 0 AS forces FROM embeddings""",
)
def drop_labels(spark, sf):
    fr = si.frames(spark, sf)
    extra = F.create_map(F.lit("Virial_old"), F.lit("1 2 3"), F.lit("STRESS"), F.lit("0"))
    out = lb.drop_labels(fr.withColumn("info", F.map_concat("info", extra)))
    return out.select(
        "frame_idx", rnd("energy").alias("energy"), "removed_keys", "removed_forces",
        F.array_join(F.array_sort(F.map_keys("info")), ",").alias("keys"),
        F.size(F.filter("atoms", lambda a: a["fx"].isNotNull())).alias("forces"),
    )


@query(
    "basic_weight_groups",
    f"""WITH {FRAMES_SQL} SELECT frame_idx, atom_idx, 2.5 AS weight,
        CASE species WHEN 'Te' THEN 0 WHEN 'Li' THEN 1 ELSE 2 END AS "group" FROM fatoms""",
)
def basic_weight_groups(spark, sf):
    out = lb.with_groups(lb.with_weight(lb.to_basic(si.frames(spark, sf)), 2.5), ["Te", "Li", "Mo"])
    return out.select("frame_idx", "weight", F.inline("atoms")).select("frame_idx", "atom_idx", "weight", "group")


@query(
    "harmonise",
    """SELECT vec_id AS frame_idx,
         CASE label WHEN 0 THEN 'no_lattice' WHEN 1 THEN 'bad_lattice' WHEN 2 THEN 'no_properties' WHEN 3 THEN 'bad_properties' WHEN 4 THEN 'no_energy' END AS reason,
         CASE WHEN label > 4 THEN 'Lattice,Properties,config_type,volume,energy,step' ELSE
              'probability,' || CASE label WHEN 0 THEN '' ELSE 'Lattice,' END || CASE label WHEN 2 THEN '' ELSE 'Properties,' END
              || CASE label WHEN 4 THEN '' ELSE 'energy,' END || 'step' END AS keys,
         CASE WHEN label > 4 THEN 'species:S:1:pos:R:3:force:R:3' END AS properties,
         CASE WHEN label > 4 THEN format('{:.7f}', 2.0 * 3 * (label + 0.5)) END AS volume
       FROM embeddings""",
)
def harmonise(spark, sf):
    src = table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_idx"), "label")
    n = F.col("label")
    lattice = F.when(n == 1, "2 0 0").otherwise(F.concat(F.lit("2 0 0 0 3 0 0 0 "), (n + 0.5).cast("string")))
    props = F.when(n == 3, "species:S").otherwise("species:S:1:pos:R:3:forces:R:3")
    fields = [
        ("probability", F.lit("0.5"), F.lit(True)), ("Lattice", lattice, n != 0), ("Properties", props, n != 2),
        ("energy", F.lit("-1.5"), n != 4), ("step", F.lit("7"), F.lit(True)),
    ]
    rows = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v"), on.alias("on")) for k, v, on in fields])
    entries = F.filter(rows, lambda e: e["on"])
    fr = src.select(
        "frame_idx", F.map_from_entries(F.transform(entries, lambda e: F.struct(e["k"], e["v"]))).alias("info"),
        F.transform(entries, lambda e: e["k"]).alias("info_keys"), F.lit(None).cast("string").alias("config_type"),
    )
    out = lb.harmonise(fr)
    ok = F.col("reason").isNull()
    return out.select(
        "frame_idx", "reason", F.array_join("info_keys", ",").alias("keys"),
        F.when(ok, F.try_element_at("info", F.lit("Properties"))).alias("properties"),
        F.when(ok, F.try_element_at("info", F.lit("volume"))).alias("volume"),
    )


@query(
    "unit_conversion",
    f"""WITH {FRAMES_SQL} SELECT frame_idx, round(e[64] * 27.211386245988, 6) AS ev, round(e[1] * 51.4220674763259, 6) AS force,
          round(e[1] * la * 120 / 160.2176634, 6) AS gpa_xx, round(-e[2] * la * 120 / 1602.1766208, 6) AS kbar_xy,
          round(e[64] / 21, 8) AS per_atom, round(e[64] - 21 * 1.25, 6) AS shifted FROM fr""",
)
def unit_conversion(spark, sf):
    fr = si.frames(spark, sf)
    vol = cell.cell_volume(F.col("lattice"))
    shifted = lb.shift_energy(fr, 1.25).select("frame_idx", rnd("energy").alias("shifted"))
    gpa = units.stress_to_virial(F.col("virial"), vol, "gpa")
    kbar = units.stress_to_virial(F.col("virial"), vol, "kbar", sign=-1)
    out = fr.select(
        "frame_idx", rnd(units.to_ev(F.col("energy"), "hartree")).alias("ev"),
        rnd(units.to_ev(F.get("virial", F.lit(0)), "hartree/bohr")).alias("force"),
        rnd(F.get(gpa, F.lit(0))).alias("gpa_xx"), rnd(F.get(kbar, F.lit(1))).alias("kbar_xy"),
        rnd(units.per_atom(F.col("energy"), F.col("natoms")), 8).alias("per_atom"),
        rnd(F.col("energy") - F.col("natoms") * 1.25).alias("shifted0"),
    )
    return out.drop("shifted0").join(shifted, "frame_idx")


@query(
    "voigt",
    """SELECT vec_id AS frame_idx, i.range AS k,
         round(CAST(embedding[CASE i.range WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 6 WHEN 3 THEN 4 WHEN 4 THEN 2 WHEN 5 THEN 5 WHEN 6 THEN 6 WHEN 7 THEN 5 ELSE 3 END] AS DOUBLE), 8) AS a,
         round(CAST(embedding[CASE i.range WHEN 0 THEN 1 WHEN 1 THEN 6 WHEN 2 THEN 5 WHEN 3 THEN 6 WHEN 4 THEN 2 WHEN 5 THEN 4 WHEN 6 THEN 5 WHEN 7 THEN 4 ELSE 3 END] AS DOUBLE), 8) AS b
       FROM embeddings, range(9) i""",
)
def voigt(spark, sf):
    six = F.slice(F.transform("embedding", lambda v: v.cast("double")), 1, 6)
    src = table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_idx"), six.alias("s"))
    both = F.arrays_zip(
        units.voigt_to_9(F.col("s")).alias("a"), units.voigt_to_9(F.col("s"), "xx,yy,zz,yz,xz,xy").alias("b")
    )
    out = src.select("frame_idx", F.posexplode(both).alias("k", "e"))
    return out.select("frame_idx", F.col("k").cast("long").alias("k"), rnd("e.a", 8).alias("a"), rnd("e.b", 8).alias("b"))


@query(
    "coerce_tensor",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE round(doc_id * 0.5 + n_chars, 6) END AS total, doc_id % 3 = 0 AS kept_text FROM documents""",
)
def coerce_tensor(spark, sf):
    docs = table(spark, sf, "documents")
    text = F.concat_ws(
        " ", (F.col("doc_id") * 0.5).cast("string"), F.when(F.col("doc_id") % 3 == 0, "abc").otherwise(F.col("n_chars").cast("string"))
    )
    arr = lb.coerce_tensor(F.col("t"))
    out = docs.select("doc_id", text.alias("t")).withColumn("v", arr)
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return out.select("doc_id", rnd(total).alias("total"), F.col("v").isNull().alias("kept_text"))


@query(
    "norm_symbol",
    """SELECT c_custkey, CASE WHEN regexp_matches(s, '^[A-Za-z]{1,2}$') THEN upper(s[1]) || lower(s[2:]) END AS symbol
       FROM (SELECT c_custkey, substr(c_mktsegment, 1, 1 + c_custkey % 3) AS s FROM customer)""",
)
def norm_symbol(spark, sf):
    s = F.substr("c_mktsegment", F.lit(1), (1 + F.col("c_custkey") % 3).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", elements.norm_symbol(s).alias("symbol"))


@query(
    "map_types",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 3 WHEN 0 THEN 'Mo' WHEN 1 THEN 'Te' ELSE 'Li' END AS species FROM lineitem""",
)
def map_types(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_linenumber") % 3).alias("type"))
    return lb.map_types(li, list(si.SPECIES)).drop("type")


@query(
    "field_counts",
    """SELECT vec_id AS frame_idx, CASE WHEN label % 2 = 1 THEN 'fields:4!=7' END AS reason FROM embeddings""",
)
def field_counts(spark, sf):
    n = F.col("label")
    lines = F.array(F.lit("Mo 1 2 3 4 5 6"), F.when(n % 2 == 1, "Te 1 2 3").otherwise("Te 1 2 3 0.1 0.2 0.3"))
    src = table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_idx"), lines.alias("l"))
    props = F.lit("species:S:1:pos:R:3:forces:R:3")
    return src.select("frame_idx", fl.field_count_reason(F.col("l"), props).alias("reason"))


# -- C9, E8-E10 ---------------------------------------------------------------------


def _pairs_table(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("kind"), F.col("l_quantity").alias("true"),
        (F.col("l_quantity") + F.col("l_discount") * 10 - F.col("l_tax") * 7).alias("pred"),
    )


_PARITY = """pt AS (SELECT l_returnflag AS kind, l_quantity AS t, l_quantity + l_discount * 10 - l_tax * 7 AS p FROM lineitem)"""


@query(
    "parity",
    f"""WITH {_PARITY}, m AS (SELECT kind, avg(t) AS mean FROM pt GROUP BY 1)
        SELECT kind, count(*) AS n, round(sqrt(avg((p - t) * (p - t))) * 1000, 4) AS rmse, round(avg(abs(p - t)) * 1000, 4) AS mae,
               round(1 - sum((t - p) * (t - p)) / sum((t - mean) * (t - mean)), 8) AS r2
        FROM pt JOIN m USING (kind) GROUP BY 1""",
)
def parity(spark, sf):
    out = mt.parity(_pairs_table(spark, sf), by=["kind"])
    return out.withColumns({"rmse": rnd("rmse", 4), "mae": rnd("mae", 4), "r2": rnd("r2", 8)})


@query(
    "parity_components",
    """WITH c AS (SELECT unnest(CAST(embedding[1:32] AS DOUBLE[])) AS p, unnest(CAST(embedding[33:64] AS DOUBLE[])) AS t, unnest(CAST(embedding AS DOUBLE[])) AS a, vec_id FROM embeddings),
       v AS (SELECT vec_id, CAST(embedding[1:32] AS DOUBLE[]) AS pp, CAST(embedding[33:64] AS DOUBLE[]) AS tt FROM embeddings WHERE vec_id % 10 <> 3),
       f AS (SELECT unnest(pp) AS p, unnest(tt) AS t FROM v), m AS (SELECT avg(t) AS mean FROM f)
       SELECT count(*) AS n, round(sqrt(avg((p - t) * (p - t))), 8) AS rmse, round(avg(abs(p - t)), 8) AS mae,
              round(1 - sum((t - p) * (t - p)) / sum((t - mean) * (t - mean)), 8) AS r2 FROM f, m""",
)
def parity_components(spark, sf):
    v = F.transform("embedding", lambda x: x.cast("double"))
    gap = F.transform(v, lambda x, i: F.when((F.col("vec_id") % 10 == 3) & (i == 8), -1e6).otherwise(x))
    rows = table(spark, sf, "embeddings").select(gap.alias("values"))
    valid = fl.drop_sentinel(rows).select(F.slice("values", 1, 32).alias("pred"), F.slice("values", 33, 32).alias("true"))
    out = mt.parity(mt.flatten_components(valid, "pred", "true"), scale=1.0)
    return out.withColumns({c: rnd(c, 8) for c in ("rmse", "mae", "r2")})


def _hist_sql(expr: str, bins: int) -> str:
    return f"""WITH v AS (SELECT {expr} AS v FROM lineitem), m AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / {bins} AS w FROM v),
      c AS (SELECT CAST(least(floor((v - lo) / w), {bins - 1}) AS BIGINT) AS bin, count(*) AS n FROM v, m GROUP BY 1)
      SELECT i.range AS bin, round(lo + i.range * w, 6) AS "left", coalesce(n, 0) AS n FROM range({bins}) i CROSS JOIN m LEFT JOIN c ON c.bin = i.range"""


@query("marginal_hist", _hist_sql("l_extendedprice", 35))
def marginal_hist(spark, sf):
    return mt.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 35).withColumn("left", rnd("left"))


@query("residual_hist", _hist_sql("(l_quantity + l_discount * 10 - l_tax * 7) - l_quantity", 28))
def residual_hist(spark, sf):
    res = _pairs_table(spark, sf).select((F.col("pred") - F.col("true")).alias("res"))
    return mt.histogram(res, "res", 28).withColumn("left", rnd("left"))


@query(
    "value_range",
    """WITH m AS (SELECT least(min(l_quantity), min(l_tax)) AS lo, greatest(max(l_quantity), max(l_tax)) AS hi FROM lineitem)
       SELECT round(lo - 0.05 * (hi - lo), 6) AS lo, round(hi + 0.05 * (hi - lo), 6) AS hi,
              (SELECT floor(min(l_extendedprice) / 500) * 500 FROM lineitem) AS tick_lo, (SELECT ceil(max(l_extendedprice) / 500) * 500 FROM lineitem) AS tick_hi FROM m""",
)
def value_range(spark, sf):
    li = table(spark, sf, "lineitem")
    a = mt.value_range(li, ["l_quantity", "l_tax"])
    b = mt.value_range(li, ["l_extendedprice"], tick=500.0)
    return a.select(rnd("lo").alias("lo"), rnd("hi").alias("hi")).withColumns(
        {"tick_lo": b.select("lo").scalar(), "tick_hi": b.select("hi").scalar()}
    )


# -- E24 ------------------------------------------------------------------------------

_FIT = f"""{SPECIES_SQL}, x AS (SELECT frame_idx, CAST(count(*) FILTER (WHERE species = 'Li') AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE species = 'Mo') AS DOUBLE) AS b,
        CAST(count(*) FILTER (WHERE species = 'Te') AS DOUBLE) AS c FROM rows GROUP BY 1),
  d AS (SELECT x.*, o_totalprice / 1000 AS y FROM x JOIN orders ON o_orderkey = frame_idx),
  s AS (SELECT sum(a*a) AS aa, sum(a*b) AS ab, sum(a*c) AS ac, sum(b*b) AS bb, sum(b*c) AS bc, sum(c*c) AS cc, sum(a*y) AS ay, sum(b*y) AS b_y, sum(c*y) AS cy FROM d),
  t AS (SELECT *, aa*(bb*cc - bc*bc) - ab*(ab*cc - bc*ac) + ac*(ab*bc - bb*ac) AS det FROM s),
  e AS (SELECT (ay*(bb*cc - bc*bc) - ab*(b_y*cc - bc*cy) + ac*(b_y*bc - bb*cy)) / det AS ea,
               (aa*(b_y*cc - cy*bc) - ay*(ab*cc - bc*ac) + ac*(ab*cy - b_y*ac)) / det AS eb,
               (aa*(bb*cy - bc*b_y) - ab*(ab*cy - b_y*ac) + ay*(ab*bc - bb*ac)) / det AS ec FROM t)"""


@query(
    "fit_element_energy",
    f"WITH {_FIT} SELECT frame_idx, round(y - a*ea - b*eb - c*ec, 5) AS shifted, round(ea, 5) AS e_li, round(eb, 5) AS e_mo, round(ec, 5) AS e_te FROM d, e",
)
def fit_element_energy(spark, sf):
    species = sorted(si.SPECIES)
    counts = en.species_counts(si.species_rows(spark, sf), species, si.FRAME)
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("frame_idx"), (F.col("o_totalprice") / 1000).alias("energy")
    )
    e, out = en.fit_element_energy(counts.join(orders, "frame_idx"), species)
    return out.select(
        "frame_idx", rnd("shifted", 5).alias("shifted"), *[F.lit(round(e[s], 5)).alias(f"e_{s.lower()}") for s in species]
    )


@query(
    "fit_element_energy_tied",
    """WITH d AS (SELECT CAST(o_orderkey % 5 + 1 AS DOUBLE) AS k, o_totalprice / 1000 AS y FROM orders),
       s AS (SELECT sum(k*k) AS kk, sum(k*y) AS ky FROM d)
       SELECT round(ky / (3 * kk), 6) AS e_li, round(ky / (3 * kk), 6) AS e_mo FROM s""",
)
def fit_element_energy_tied(spark, sf):
    # Mo is always twice Li, so the counts alone do not tell the two energies apart
    k = (F.col("o_orderkey") % 5 + 1).cast("long")
    counts = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("frame_idx"), k.alias("n_Li"), (2 * k).alias("n_Mo"), (F.col("o_totalprice") / 1000).alias("energy")
    )
    e, _ = en.fit_element_energy(counts, ["Li", "Mo"])
    return counts.limit(1).select(*[F.lit(round(e[s], 6)).alias(f"e_{s.lower()}") for s in ("Li", "Mo")])


# -- D1-D4 -----------------------------------------------------------------------------


def _matrix(rows: DataFrame, order: str, values) -> DataFrame:
    """A prediction file written from table rows in order and read back by position."""
    text = rows.select(F.col(order).alias("ord"), tx.join_floats(values).alias("value"))
    return tb.read_matrix(rows.sparkSession, si.derive_text(text, "matrix"))


@query(
    "relabel_frames",
    """WITH f AS (SELECT vec_id, label, 10.0 + label AS la, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
       SELECT vec_id AS frame_idx, round(21 * e[5], 7) AS energy, round(21 * e[10], 7) AS v_xx, round(21 * e[13], 7) AS v_xy, round(21 * e[15], 7) AS v_zx,
              round(-21 * e[11] / (la * 120), 9) AS s_yy FROM f""",
)
def relabel_frames(spark, sf):
    fr = frame_numbers(si.frames(spark, sf))
    emb = table(spark, sf, "embeddings").withColumn("e", F.transform("embedding", lambda v: v.cast("double")))
    energy = _matrix(emb, "vec_id", F.slice("e", 5, 2))
    virial = _matrix(emb, "vec_id", F.slice("e", 10, 12))
    out = lb.relabel_frames(fr, energy, virial, with_stress=True)
    return out.select(
        "frame_idx", rnd("energy", 7).alias("energy"),
        *[rnd(F.get("virial", F.lit(k)), 7).alias(n) for k, n in ((0, "v_xx"), (1, "v_xy"), (2, "v_zx"))],
        rnd(F.get("stress", F.lit(4)), 9).alias("s_yy"),
    )


@query(
    "relabel_forces",
    """WITH f AS (SELECT vec_id, i.range AS i, CAST(embedding AS DOUBLE[]) AS e FROM embeddings, range(21) i)
       SELECT vec_id AS frame_idx, CAST(i AS INTEGER) AS atom_idx, round(e[i+1], 8) AS fx, round(e[i+20], 8) AS fy, round(e[i+40], 8) AS fz FROM f""",
)
def relabel_forces(spark, sf):
    fr = frame_numbers(si.frames(spark, sf))
    emb = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i"))
    rows = emb.withColumn("ord", F.col("vec_id") * 21 + F.col("i"))
    force = _matrix(rows, "ord", F.array(*[F.get("e", F.col("i") + k) for k in (0, 19, 39)]))
    out = atoms_view(lb.relabel_forces(fr, force))
    return out.select("frame_idx", "atom_idx", *[rnd(c, 8).alias(c) for c in ("fx", "fy", "fz")])


@query(
    "aligned_counts",
    """WITH c AS (SELECT 'embeddings' AS name, count(*) AS rows FROM embeddings UNION ALL SELECT 'events', count(*) FROM events
       UNION ALL SELECT 'orders', count(*) FROM orders) SELECT name, rows, (SELECT min(rows) = max(rows) FROM c) AS agrees FROM c""",
)
def aligned_counts(spark, sf):
    return fl.aligned_counts(**{t: table(spark, sf, t) for t in ("embeddings", "events", "orders")})


@query(
    "join_by_row",
    """SELECT event_id AS row_no, user_id, round(o_totalprice, 2) AS deviation FROM events JOIN orders ON event_id = o_orderkey WHERE o_totalprice > 250000""",
)
def join_by_row(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_no"), F.array("o_totalprice").alias("v"))
    active = _matrix(orders, "row_no", F.col("v")).select("row_no", F.get("values", F.lit(0)).alias("deviation"))
    ev = table(spark, sf, "events").select(F.col("event_id").alias("row_no"), "user_id")
    out = lb.join_by_row(ev, active.filter("deviation > 250000"), whole=False)
    return out.select("row_no", "user_id", rnd("deviation", 2).alias("deviation"))


# -- bands, levels, profiles ---------------------------------------------------------------


def _bands(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("row"), F.lit(0).alias("band"), F.col("p_size").alias("k"),
        (F.col("p_retailprice") - 950.05).alias("energy"),
    )


_BANDS = "b AS (SELECT p_partkey AS row, p_size AS k, p_retailprice - 950.05 AS e FROM part)"
_EDGE = f"""{_BANDS}, x AS (SELECT max(e) FILTER (WHERE e < 0) AS vbm, min(e) FILTER (WHERE e > 0) AS cbm FROM b)"""


@query(
    "band_edges",
    f"""WITH {_EDGE} SELECT round(vbm, 6) AS vbm, (SELECT k FROM b WHERE e = vbm ORDER BY row LIMIT 1) AS vbm_k, round(cbm, 6) AS cbm,
        (SELECT k FROM b WHERE e = cbm ORDER BY row LIMIT 1) AS cbm_k, round(cbm - vbm, 6) AS gap FROM x""",
)
def band_edges(spark, sf):
    out = lv.band_edges(_bands(spark, sf))
    return out.withColumns({c: rnd(c) for c in ("vbm", "cbm", "gap")})


@query("align_mid_gap", f"WITH {_EDGE} SELECT row, k, round(e - (vbm + cbm) / 2, 6) AS energy FROM b, x")
def align_mid_gap(spark, sf):
    return lv.align_mid_gap(_bands(spark, sf)).select("row", "k", rnd("energy").alias("energy"))


@query(
    "segment_bands",
    f"""WITH {_BANDS}, s AS (SELECT i, lo, hi FROM (VALUES (0, -1e9, 10.0), (1, 10.0, 25.0), (2, 25.0, 40.0), (3, 40.0, 1e9)) t(i, lo, hi))
        SELECT i AS "window", count(*) AS n, round(sum(e), 4) AS total FROM b JOIN s ON k >= lo AND k <= hi GROUP BY 1""",
)
def segment_bands(spark, sf):
    out = lv.segment_bands(_bands(spark, sf), [25.0, 10.0, 40.0])
    return out.groupBy("window").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("energy"), 4).alias("total"))


@query(
    "segment_bands_one_sided",
    f"""WITH {_BANDS} SELECT CASE WHEN k <= 10 THEN 0 WHEN k <= 25 THEN 1 WHEN k <= 40 THEN 2 ELSE 3 END AS "window", count(*) AS n FROM b GROUP BY 1""",
)
def segment_bands_one_sided(spark, sf):
    out = lv.segment_bands(_bands(spark, sf), [25.0, 10.0, 40.0], both=False)
    return out.groupBy("window").agg(F.count(F.lit(1)).alias("n"))


@query(
    "segment_bands_table",
    f"""WITH b AS (SELECT p_partkey AS row, p_size AS k, p_partkey % 5 AS g, p_retailprice - 950.05 AS e FROM part),
        s AS (SELECT s_nationkey % 5 AS g, s_suppkey % 50 + CASE s_suppkey % 2 WHEN 0 THEN 0.5 ELSE 0 END AS x FROM supplier),
        w AS (SELECT row, e, (SELECT count(*) FROM s WHERE s.g = b.g AND s.x < b.k) AS lo, (SELECT count(*) FROM s WHERE s.g = b.g AND s.x <= b.k) AS hi FROM b),
        u AS (SELECT row, e, unnest(range(lo, hi + 1)) AS "window" FROM w)
        SELECT row, CAST("window" AS INTEGER) AS "window", round(e, 4) AS energy FROM u""",
)
def segment_bands_table(spark, sf):
    bands = _bands(spark, sf).withColumn("g", F.col("row") % 5)
    odd = F.col("s_suppkey") % 2 == 0
    place = F.col("s_suppkey") % 50 + F.when(odd, 0.5).otherwise(0.0)
    splits = table(spark, sf, "supplier").select((F.col("s_nationkey") % 5).cast("long").alias("g"), place.alias("split"))
    return lv.segment_table(bands, splits, by=["g"]).select("row", "window", rnd("energy", 4).alias("energy"))


def _levels(spark, sf):
    gap = 1.0 + F.col("s_nationkey") * 0.015
    return table(spark, sf, "supplier").select(
        F.col("s_name").alias("system"), F.col("s_suppkey").alias("ord"), (-F.col("s_acctbal") / 1000 - 4).alias("vbm"),
        (-F.col("s_acctbal") / 1000 - 4 + gap).alias("cbm"), (-F.col("s_acctbal") / 1000 - 3.5).alias("ef"),
    )


_LEVELS = """l AS (SELECT s_name AS system, s_suppkey AS ord, -s_acctbal / 1000 - 4 AS vbm, -s_acctbal / 1000 - 4 + (1.0::DOUBLE + s_nationkey * 0.015::DOUBLE) AS cbm FROM supplier),
  lg AS (SELECT *, cbm - vbm AS gap FROM l)"""


@query(
    "rigid_shift",
    f"""WITH {_LEVELS} SELECT a.system AS a, b.system AS b, round(b.vbm - a.vbm, 6) AS dv, round(b.gap, 6) AS gap FROM lg a JOIN lg b ON a.ord < b.ord
        AND abs(b.vbm - a.vbm) > 0.3 AND abs((b.vbm - a.vbm) - (b.cbm - a.cbm)) < 0.02 AND abs(b.gap - a.gap) < 0.02""",
)
def rigid_shift(spark, sf):
    return lv.rigid_shift(_levels(spark, sf)).withColumns({"dv": rnd("dv"), "gap": rnd("gap")})


@query(
    "band_offsets",
    f"""WITH {_LEVELS} SELECT a.system AS a, b.system AS b, round(abs(b.cbm - a.cbm), 6) AS cbo, round(abs(b.vbm - a.vbm), 6) AS vbo
        FROM l a JOIN l b ON b.ord = a.ord + 1""",
)
def band_offsets(spark, sf):
    sup = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    nxt = sup.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("s_name").alias("b"))
    pairs = sup.join(nxt, "s_suppkey").select(F.col("s_name").alias("a"), "b")
    return lv.band_offsets(_levels(spark, sf), pairs).withColumns({"cbo": rnd("cbo"), "vbo": rnd("vbo")})


@query(
    "align_energy",
    f"WITH {_LEVELS} SELECT system, round(vbm + 4.2, 6) AS vbm, round(cbm + 4.2, 6) AS cbm, round(gap, 6) AS gap FROM lg",
)
def align_energy(spark, sf):
    out = lv.level_table(lv.align_energy(_levels(spark, sf), -4.2, ["vbm", "cbm"]))
    return out.select("system", *[rnd(c).alias(c) for c in ("vbm", "cbm", "gap")])


@query(
    "interval_mean",
    """SELECT p_brand, round(avg(CASE WHEN p_size BETWEEN 10 AND 12 THEN p_retailprice END), 6) AS mean FROM part GROUP BY 1""",
)
def interval_mean(spark, sf):
    out = lv.interval_mean(table(spark, sf, "part"), 10, 12, "p_size", "p_retailprice", ["p_brand"])
    return out.withColumn("mean", rnd("mean"))


@query(
    "path_images",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE abs(o_totalprice / 4 - round_even(o_totalprice / 4, 0)) <= 1e-8::DOUBLE + 1e-5::DOUBLE * abs(round_even(o_totalprice / 4, 0))""",
)
def path_images(spark, sf):
    rows = table(spark, sf, "orders").withColumn("index", F.col("o_totalprice") / 4)
    return fl.path_images(rows).select("o_orderkey", "o_totalprice")


@query(
    "segments",
    """WITH s AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS segment FROM events)
       SELECT user_id, event_id, CAST(segment AS BIGINT) AS segment FROM s WHERE event_type <> 'signup'""",
)
def segments(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    out = lv.segments(ev, F.col("event_type") == "signup", ["user_id"], ["event_id"])
    return out.select("user_id", "event_id", "segment")
