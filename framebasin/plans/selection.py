"""Selection, sampling, composition and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import natural_key
from ..operators import dedup as dd
from ..operators import filters as fl
from ..operators import labels as lb
from ..operators import sampling as sp
from ..operators import summary as sm
from ..operators.running import group_rank
from . import standins as si
from .registry import query
from .standins import ATOMS_SQL, FRAMES_SQL, SPECIES_SQL, rnd, table

# -- G: picks --------------------------------------------------------------------


@query(
    "top_n_per_source",
    """SELECT source, frame_idx, uncertainty FROM (
         SELECT user_id AS source, event_id AS frame_idx, value AS uncertainty,
                row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn
         FROM events WHERE value >= 0.3) WHERE rn <= 15""",
)
def top_n_per_source(spark: SparkSession, sf: str) -> DataFrame:
    ev = sp.filter_uncertainty(si.events(spark, sf), 0.3).drop("kind")
    return sp.top_n(ev, "uncertainty", sp.TOP_N, per=["source"])


@query(
    "top_n_global",
    """SELECT event_id AS frame_idx, value AS uncertainty FROM events WHERE value > 0.15
       ORDER BY value DESC, event_id LIMIT 200""",
)
def top_n_global(spark, sf):
    ev = sp.filter_deviation(si.events(spark, sf), 0.15, "uncertainty")
    return sp.top_n(ev, "uncertainty", 200).select("frame_idx", "uncertainty")


@query(
    "uncertainty_stats",
    """SELECT user_id AS source, count(*) AS frames, min(value) AS u_min, round(avg(value), 6) AS u_mean,
              max(value) AS u_max
       FROM events GROUP BY ROLLUP(user_id)""",
)
def uncertainty_stats(spark, sf):
    return sp.uncertainty_stats(si.events(spark, sf)).withColumn("u_mean", rnd("u_mean"))


@query(
    "sample_uniform",
    """WITH n AS (SELECT count(*) - 10 AS n FROM events),
       idx AS (SELECT 10 + CASE WHEN i = 99 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / 99.0::DOUBLE)) AS BIGINT) END AS frame_idx
               FROM (SELECT range AS i FROM range(100)), n)
       SELECT event_id AS frame_idx, user_id AS source, value AS uncertainty FROM events JOIN idx ON event_id = frame_idx""",
)
def sample_uniform(spark, sf):
    return sp.sample_uniform(si.events(spark, sf).drop("kind"), 100, skip=10)


@query(
    "frame_range",
    """WITH n AS (SELECT count(*) AS n FROM events)
       SELECT event_id AS frame_idx, value AS uncertainty FROM events, n
       WHERE event_id >= CAST(floor(0.25 * n) AS BIGINT) AND event_id < CAST(floor(0.6 * n) AS BIGINT)""",
)
def frame_range(spark, sf):
    return sp.frame_range(si.events(spark, sf), 0.25, 0.6).select("frame_idx", "uncertainty")


@query(
    "frame_slice",
    "SELECT event_id AS frame_idx, value AS uncertainty FROM events WHERE event_id >= 100 AND event_id < 5000",
)
def frame_slice(spark, sf):
    return sp.frame_slice(si.events(spark, sf), 100, 5000).select("frame_idx", "uncertainty")


@query(
    "pick_many",
    "SELECT event_id AS frame_idx, value AS uncertainty FROM events WHERE event_id IN (0, 6, 41, 99)",
)
def pick_many(spark, sf):
    return sp.pick_many(si.events(spark, sf), [1, 7, 7, 42, 100], base=1).select("frame_idx", "uncertainty")


@query("pick_frame", "SELECT event_id AS frame_idx, value AS uncertainty FROM events WHERE event_id = 16")
def pick_frame(spark, sf):
    return sp.pick(si.events(spark, sf), 17, base=1).select("frame_idx", "uncertainty")


@query(
    "sample_random",
    """SELECT event_id AS frame_idx, value AS uncertainty FROM events
       ORDER BY md5('7:' || event_id), event_id LIMIT 500""",
)
def sample_random(spark, sf):
    return sp.sample_random(si.events(spark, sf), 500, seed=7).select("frame_idx", "uncertainty")


@query(
    "sample_random_scope",
    """SELECT event_id AS frame_idx, value AS uncertainty FROM events
       WHERE event_id BETWEEN 100 AND 999 AND event_type <> 'error'
       ORDER BY md5('3:' || event_id), event_id LIMIT 50""",
)
def sample_random_scope(spark, sf):
    ev = si.events(spark, sf)
    ledger = ev.filter("kind = 'error'").select("frame_idx", F.lit("present").alias("status"))
    out = sp.sample_random(ev, 50, seed=3, scope=(100, 999), ledger=ledger)
    return out.select("frame_idx", "uncertainty")


@query(
    "split_shuffled",
    """WITH n AS (SELECT count(*) AS n FROM events),
       r AS (SELECT event_id AS frame_idx, row_number() OVER (ORDER BY md5('11:' || event_id), event_id) - 1 AS rn FROM events)
       SELECT frame_idx, CASE WHEN rn < round_even(n * 0.8, 0) THEN 'train' ELSE 'test' END AS part FROM r, n""",
)
def split_shuffled(spark, sf):
    return sp.split(si.events(spark, sf), 0.8, seed=11).select("frame_idx", "part")


_TEST_IDX = """WITH n AS (SELECT count(*) AS n FROM events),
   k AS (SELECT n, CAST(greatest(1, floor(n * 0.1 + 0.5)) AS BIGINT) AS k FROM n),
   test AS (SELECT CASE WHEN i = k - 1 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / CAST(k - 1 AS DOUBLE))) AS BIGINT) END AS frame_idx
            FROM (SELECT unnest(range(k)) AS i, n, k FROM k))"""


@query(
    "split_uniform",
    _TEST_IDX
    + """ SELECT event_id AS frame_idx,
            CASE WHEN event_id IN (SELECT frame_idx FROM test) THEN 'test' ELSE 'train' END AS part FROM events""",
)
def split_uniform(spark, sf):
    train, test = sp.split_test(si.events(spark, sf), 0.1, "uniform")
    return (
        train.select("frame_idx", F.lit("train").alias("part"))
        .unionByName(test.select("frame_idx", F.lit("test").alias("part")))
    )


@query(
    "split_fps",
    """WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
       w AS (
         SELECT 1 AS step, id, e, list_distance(e, (SELECT e FROM v ORDER BY id LIMIT 1)) AS d,
                id = (SELECT min(id) FROM v) AS used FROM v
         UNION ALL
         SELECT w.step + 1, w.id, w.e, least(w.d, list_distance(w.e, p.e)), w.used OR w.id = p.id
         FROM w, (SELECT id, e FROM w WHERE NOT used ORDER BY d DESC, id LIMIT 1) p
         WHERE w.step < 40)
       SELECT id AS vec_id, CASE WHEN used THEN 'test' ELSE 'train' END AS part FROM w WHERE step = 40""",
)
def split_fps(spark, sf):
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding")
    train, test = sp.split_test(emb, 40, "fps", vector="embedding", col="vec_id")
    return (
        train.select("vec_id", F.lit("train").alias("part"))
        .unionByName(test.select("vec_id", F.lit("test").alias("part")))
    )


@query(
    "order_natural",
    """SELECT source, doc_id, row_number() OVER (
            ORDER BY CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER), doc_id) - 1 AS pos FROM documents""",
)
def order_natural(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source").withColumn("nk", natural_key(F.col("source")))
    return group_rank(docs, [], ["nk", "doc_id"], "pos").select("source", "doc_id", "pos")


@query(
    "ledger_new",
    """WITH led AS (SELECT l_orderkey AS frame_idx, max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS present
                    FROM lineitem GROUP BY 1)
       SELECT o_orderkey AS frame_idx, CASE WHEN present IS NULL THEN 'new' ELSE 'rebuilt' END AS event
       FROM orders LEFT JOIN led ON o_orderkey = frame_idx WHERE coalesce(present, 0) = 0""",
)
def ledger_new(spark, sf):
    ledger = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("frame_idx"),
        F.when(F.col("l_linestatus") == "O", "present").otherwise("lost").alias("status"),
    )
    fr = table(spark, sf, "orders").select(F.col("o_orderkey").alias("frame_idx"))
    return sp.new_frames(fr, ledger)


@query(
    "ledger_refresh",
    """SELECT o_orderkey AS frame_idx,
              CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) THEN 'new' ELSE 'removed' END AS event,
              CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) THEN 'present' ELSE 'lost' END AS status
       FROM orders""",
)
def ledger_refresh(spark, sf):
    ledger = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("frame_idx"), F.col("o_custkey").cast("string").alias("path"),
        F.lit("new").alias("event"), F.lit("present").alias("status"),
    )
    there = table(spark, sf, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").cast("string").alias("path"))
    return sp.refresh_ledger(ledger, there).drop("path")


# -- C, B17, E1-E3: composition ------------------------------------------------------

_SETS = SPECIES_SQL + """,
sets AS (SELECT frame_idx, count(*) AS natoms, list_sort(list(DISTINCT species)) AS els FROM rows GROUP BY 1)"""


@query(
    "elements_only",
    f"WITH {_SETS} SELECT frame_idx, natoms FROM sets WHERE els = ['Li', 'Mo', 'Te']",
)
def elements_only(spark, sf):
    sets = fl.element_sets(si.species_rows(spark, sf), si.FRAME)
    return fl.filter_elements(sets, ["Mo", "Te", "Li"], "only").select("frame_idx", "natoms")


@query(
    "elements_at_least",
    f"WITH {_SETS} SELECT frame_idx, natoms FROM sets WHERE list_contains(els, 'Mo') AND list_contains(els, 'Li')",
)
def elements_at_least(spark, sf):
    sets = fl.element_sets(si.species_rows(spark, sf), si.FRAME)
    return fl.filter_elements(sets, ["Mo", "Li"], "at_least").select("frame_idx", "natoms")


_ROUTE = _SETS + """,
routed AS (SELECT frame_idx, natoms, els,
   CASE WHEN els = ['Mo', 'Te'] THEN 'MoTe' WHEN els = ['Mo'] THEN 'Mo' END AS g FROM sets),
judged AS (SELECT frame_idx, natoms, CASE WHEN natoms <= 4 THEN g END AS grp,
   CASE WHEN g IS NULL AND list_contains(els, 'Li') THEN 'extra:Li'
        WHEN g IS NULL THEN 'missing:Mo'
        WHEN natoms > 4 THEN 'too_many_atoms' END AS reason FROM routed)"""


@query("route_groups", f"WITH {_ROUTE} SELECT frame_idx, natoms, grp, reason FROM judged")
def route_groups(spark, sf):
    sets = fl.element_sets(si.species_rows(spark, sf), si.FRAME)
    return fl.route(sets, [["Mo", "Te"], ["Mo"]], max_atoms=4).select("frame_idx", "natoms", "grp", "reason")


@query("reason_counts", f"WITH {_ROUTE} SELECT reason, count(*) AS frames FROM judged GROUP BY reason")
def reason_counts(spark, sf):
    return fl.reason_counts(route_groups(spark, sf))


@query("max_atoms", f"WITH {_SETS} SELECT frame_idx, natoms FROM sets WHERE natoms <= 3")
def max_atoms(spark, sf):
    return fl.filter_natoms(fl.element_sets(si.species_rows(spark, sf), si.FRAME), 3).select("frame_idx", "natoms")


@query(
    "composition",
    f"""WITH {SPECIES_SQL}, c AS (SELECT frame_idx, species, count(*) AS n FROM rows GROUP BY 1, 2)
        SELECT frame_idx, CAST(sum(n) AS BIGINT) AS natoms,
               string_agg(species || n, '' ORDER BY {si.RANK_SQL.format(s='species')}) AS formula
        FROM c GROUP BY 1""",
)
def composition(spark, sf):
    return lb.composition(si.species_rows(spark, sf), si.FRAME).select("frame_idx", "natoms", "formula")


@query(
    "dataset_summary",
    f"""WITH {_SETS} SELECT count(*) AS frames, min(natoms) AS min_atoms, max(natoms) AS max_atoms,
        (SELECT string_agg(DISTINCT species, ' ' ORDER BY species) FROM rows) AS species FROM sets""",
)
def dataset_summary(spark, sf):
    return sm.dataset_summary(fl.element_sets(si.species_rows(spark, sf), si.FRAME))


@query(
    "check_species",
    f"""WITH {SPECIES_SQL} SELECT species, count(*) AS atoms, count(DISTINCT frame_idx) AS frames
        FROM rows WHERE species NOT IN ('Mo', 'Te') GROUP BY 1""",
)
def check_species(spark, sf):
    return fl.check_species(si.species_rows(spark, sf), ["Mo", "Te"], si.FRAME)


@query(
    "search_table",
    """SELECT p_partkey FROM part
       WHERE list_contains(string_split(p_name, ' '), 'ring') AND len(list_distinct(string_split(p_name, ' '))) = 2
         AND p_size BETWEEN 5 AND 40 AND p_retailprice BETWEEN 905 AND 990
         AND NOT list_contains(string_split(p_name, ' '), 'red')""",
)
def search_table(spark, sf):
    parts = table(spark, sf, "part").withColumn("elements", F.split("p_name", " "))
    return fl.search(
        parts, contains=["ring"], n_elements=2,
        ranges={"p_size": (5, 40), "p_retailprice": (905, 990)}, blacklist=["red"],
    ).select("p_partkey")


@query(
    "require_cell",
    """SELECT vec_id AS frame_idx FROM embeddings
       WHERE abs((CASE WHEN label = 0 THEN 0 ELSE 10.0 + label END) * 120) > 1e-12""",
)
def require_cell(spark, sf):
    fr = si.frames(spark, sf)
    flat = F.transform("lattice", lambda v: F.when(F.col("source") == "md0", 0.0).otherwise(v))
    return fl.require_cell(fr.withColumn("lattice", flat)).select("frame_idx")


# -- H: duplicates --------------------------------------------------------------------


def _docs(spark, sf):
    """Documents as frames of files (sources in natural order) with a content digest."""
    docs = table(spark, sf, "documents")
    return docs.select(
        F.regexp_extract("source", r"(\d+)", 1).cast("int").alias("file_ord"),
        F.col("doc_id").alias("frame_idx"), F.sha2("text", 256).alias("content"),
    )


_DOCS = """docs AS (SELECT CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) AS file_ord, doc_id AS frame_idx, text FROM documents)"""
_KEY = ("file_ord", "frame_idx")


@query(
    "dedup_exact",
    f"""WITH {_DOCS} SELECT file_ord, frame_idx FROM (
          SELECT *, row_number() OVER (PARTITION BY text ORDER BY file_ord, frame_idx) AS rn FROM docs) WHERE rn = 1""",
)
def dedup_exact(spark, sf):
    docs = _docs(spark, sf)
    gone = dd.copies(docs, "content", _KEY).select(*_KEY)
    return docs.select(*_KEY).join(gone, list(_KEY), "left_anti")


@query(
    "dup_report",
    f"""WITH {_DOCS}, f AS (SELECT *, first_value(frame_idx) OVER (PARTITION BY file_ord, text ORDER BY frame_idx) AS kept FROM docs)
        SELECT file_ord, frame_idx, kept FROM f WHERE kept <> frame_idx""",
)
def dup_report(spark, sf):
    rep = dd.copies(_docs(spark, sf), "content", _KEY, by=["file_ord"])
    return rep.select(*_KEY, F.col("dup_of.frame_idx").alias("kept"))


@query(
    "dup_index_map",
    f"""WITH {_DOCS}, r AS (SELECT file_ord, frame_idx, row_number() OVER (PARTITION BY file_ord, text ORDER BY frame_idx) AS rn FROM docs),
        k AS (SELECT file_ord, frame_idx, row_number() OVER (PARTITION BY file_ord ORDER BY frame_idx) - 1 AS new_idx FROM r WHERE rn = 1)
        SELECT r.file_ord, r.frame_idx, coalesce(k.new_idx, -1) AS new_idx FROM r LEFT JOIN k USING (file_ord, frame_idx)""",
)
def dup_index_map(spark, sf):
    docs = _docs(spark, sf)
    return dd.index_map(docs, dd.copies(docs, "content", _KEY, by=["file_ord"]))


@query(
    "cross_file_dups",
    f"""WITH {_DOCS}, u AS (SELECT file_ord, text, min(frame_idx) AS frame_idx FROM docs GROUP BY 1, 2),
        f AS (SELECT file_ord, frame_idx,
                first_value(file_ord) OVER w AS kept_file, first_value(frame_idx) OVER w AS kept
              FROM u WINDOW w AS (PARTITION BY text ORDER BY file_ord, frame_idx))
        SELECT * FROM f WHERE kept_file <> file_ord""",
)
def cross_file_dups(spark, sf):
    docs = _docs(spark, sf)
    inside = dd.copies(docs, "content", _KEY, by=["file_ord"]).select(*_KEY)
    unique = docs.join(inside, list(_KEY), "left_anti")
    rep = dd.copies(unique, "content", _KEY)
    return rep.select(*_KEY, F.col("dup_of.file_ord").alias("kept_file"), F.col("dup_of.frame_idx").alias("kept"))


@query(
    "merge_report",
    f"""WITH {_DOCS}, r AS (SELECT file_ord, row_number() OVER (PARTITION BY text ORDER BY file_ord, frame_idx) AS rn FROM docs)
        SELECT file_ord, count(*) AS frames, count(*) FILTER (WHERE rn = 1) AS kept, count(*) FILTER (WHERE rn > 1) AS removed
        FROM r GROUP BY ROLLUP(file_ord)""",
)
def merge_report(spark, sf):
    docs = _docs(spark, sf)
    gone = dd.copies(docs, "content", _KEY).select(*_KEY, F.lit(True).alias("gone"))
    marked = docs.select(*_KEY).join(gone, list(_KEY), "left")
    return sm.merge_report(marked, F.col("gone").isNull(), by="file_ord")


@query(
    "merge_union",
    """WITH u AS (SELECT 0 AS o, doc_id AS frame_idx, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
                  UNION ALL SELECT 2, conv_id * 1000 + turn, text FROM conversations)
       SELECT o AS file_ord, frame_idx, md5(text) AS digest FROM u""",
)
def merge_union(spark, sf):
    def part(name, idx):
        return table(spark, sf, name).select(F.lit(0).alias("file_ord"), idx.alias("frame_idx"), F.md5("text").alias("digest"))

    return dd.merge(
        part("documents", F.col("doc_id")), part("benchmark", F.col("item_id")),
        part("conversations", F.col("conv_id") * 1000 + F.col("turn")),
    )


def doubled_frames(spark, sf) -> DataFrame:
    """Frames and, in a second file, altered copies.

    By frame number modulo 4 a copy has its atoms reversed, is moved by lattice
    vectors, has the species of two atoms swapped, or is moved along z.
    """
    fr = si.frames(spark, sf).withColumn("frame_idx", F.col("frame_idx").cast("long"))
    kind = F.col("frame_idx") % 4

    def altered(a, i):
        other = F.get("atoms", F.when(i == 0, 1).when(i == 1, 0).otherwise(i))
        return (
            a.withField("x", a["x"] + F.when(kind == 1, F.get("lattice", F.lit(0))).otherwise(0.0))
            .withField("species", F.when(kind == 2, other["species"]).otherwise(a["species"]))
            .withField("z", a["z"] + F.when(kind == 3, 0.25).otherwise(0.0))
        )

    moved = F.transform("atoms", altered)
    copy = fr.withColumn("file_ord", F.lit(1)).withColumn(
        "atoms", F.when(kind == 0, F.reverse(moved)).otherwise(moved)
    )
    return fr.unionByName(copy)


@query(
    "strict_dedup",
    """SELECT 1 AS file_ord, vec_id AS frame_idx, 0 AS kept_file, vec_id AS kept FROM embeddings WHERE vec_id % 4 IN (0, 1)""",
)
def strict_dedup(spark, sf):
    rep = dd.dup_report(doubled_frames(spark, sf))
    return rep.select(*_KEY, F.col("dup_of.file_ord").alias("kept_file"), F.col("dup_of.frame_idx").alias("kept"))


@query(
    "cross_dups",
    """SELECT 1 AS file_ord, vec_id AS frame_idx, 0 AS kept_file, vec_id AS kept FROM embeddings WHERE vec_id % 4 IN (0, 1)""",
)
def cross_dups(spark, sf):
    rep = dd.cross_dups(doubled_frames(spark, sf))
    return rep.select(*_KEY, F.col("dup_of.file_ord").alias("kept_file"), F.col("dup_of.frame_idx").alias("kept"))


@query(
    "strict_merge_dedup",
    """SELECT 0 AS file_ord, vec_id AS frame_idx FROM embeddings
       UNION ALL SELECT 1, vec_id FROM embeddings WHERE vec_id % 4 IN (2, 3)""",
)
def strict_merge_dedup(spark, sf):
    return dd.merge_dedup(doubled_frames(spark, sf)).select(*_KEY)


@query("strict_dups", "SELECT 1 AS file_ord, vec_id AS frame_idx, 21 AS natoms FROM embeddings WHERE vec_id % 4 IN (0, 1)")
def strict_dups(spark, sf):
    return dd.dups(doubled_frames(spark, sf)).select(*_KEY, "natoms")


@query("same_structure", "SELECT vec_id AS frame_idx, vec_id % 4 = 0 AS same FROM embeddings")
def same_structure(spark, sf):
    both = doubled_frames(spark, sf)
    a, b = both.filter("file_ord = 0"), both.filter("file_ord = 1")
    return dd.same_structure(a, b, ["frame_idx"])
