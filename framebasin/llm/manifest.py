"""Merkle manifest of a dataset: levels of digests built by Spark, and proofs folded by a recursive query.

1. A leaf is the SHA-256 of a row's fields, each ``-`` if null and else its byte count, ``:`` and value. Leaves are
   numbered inside their source by key: range partitions, places inside them, totals before them.
2. Level by level, every ``FAN`` consecutive nodes of a source become a parent, the digest of their digests, until one
   is left, the subroot; the subroots, ordered by source, are the leaves of the top tree and give the root. The levels
   are stored as node rows linked to their parent (``Manifest.nodes``).
3. ``climb`` is a recursive query over these rows. All leaves of one run share their ancestors, so what climbs is a
   run: it carries the fold of each of its leaves and the siblings met so far, appends the siblings of its node in
   each step and folds every leaf through the parent, until no parent is left.

A level holds a sixteenth of the level below, so all levels together cost little more than the leaves; a source that
holds any share of the rows is split by ranges and runs. The climb takes a step for each level.

Defined results: null fields count as ``-``. Null sources form one source, first in order; null keys are first in
their source. Leaves with equal keys stand in the order of their digests; repeated rows are leaves of their own. A
lone leaf is its subroot, a lone subroot the root, and its proof the digest of nothing. A null key has no checksum, so
``tampered`` leaves it alone. An empty table has no leaves and gives no rows. Extra columns are ignored unless they
are named as fields.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .frames import lower_ascii

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_TOP = -1  # the tree over the subroots
_LEVELS = 16  # 16 ** 16 leaves are more than a long counts


class Manifest(NamedTuple):
    leaves: DataFrame  # source, doc_id, leaf, seen, tree, idx, parent, place
    nodes: DataFrame  # node, parent, place, digest, children, subroot

    def save(self, path: str) -> None:
        """Both tables as Parquet under ``path``."""
        self.leaves.write.parquet(f"{path}/leaves")
        self.nodes.write.parquet(f"{path}/nodes")


def digest(fields: Sequence[Column]) -> Column:
    """SHA-256 in hex of all fields, each ``-`` if null and else byte count, colon and value."""
    texts = [c.cast("string") for c in fields]
    sized = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*sized), 256)


def tampered(key: Column, changed: Column, own: Column, every: int = 5) -> Column:
    """``changed`` where ``every`` divides the CRC-32 of the decimal key, else ``own``."""
    return F.when(F.crc32(key.cast("string")) % every == 0, changed).otherwise(own)


def _depth(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return sum(((n > FAN**k).cast("int") for k in range(1, _LEVELS - 1)), (n > 1).cast("int"))


def _name(tree: Column | str, level: Column | int, idx: Column | str) -> Column:
    parts = [F.col(c) if isinstance(c, str) else F.lit(c) if isinstance(c, int) else c for c in (tree, level, idx)]
    return F.concat_ws("/", *[p.cast("string") for p in parts])


def _numbered(leaves: DataFrame, key: str) -> DataFrame:
    """``leaves`` with ``tree``, the number of their source in order, ``idx``, their place in it, and ``n``, its size."""
    order = [F.col("source").asc_nulls_first(), F.col(key).asc_nulls_first(), F.col("leaf").asc()]
    same = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))  # equal for null sources
    ranged = cut(leaves.withColumn("_same", same).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "leaves")
    parts = cut(ranged.groupBy("_same", "source", "_part").agg(F.count(F.lit(1)).alias("_n")), "parts")
    whole = Window.partitionBy("_same").orderBy("_part")
    starts = parts.groupBy("_same", "source").agg(F.min("_part").alias("_first"), F.sum("_n").alias("n"))
    begun = starts.groupBy("_first").agg(F.count(F.lit(1)).alias("_k"))  # a row for each partition at most
    begun = begun.select("_first", (F.sum("_k").over(Window.orderBy("_first")) - F.col("_k")).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_first").orderBy(F.col("source").asc_nulls_first()))
    trees = starts.withColumn("_in", inside).join(F.broadcast(begun), "_first")
    trees = trees.select("_same", "n", (F.col("_base") + F.col("_in") - 1).cast("long").alias("tree"))
    before = parts.select("_same", "_part", (F.sum("_n").over(whole) - F.col("_n")).alias("_before")).join(trees, "_same")
    place = F.row_number().over(Window.partitionBy("_part", "_same").orderBy(F.col(key).asc_nulls_first(), "leaf"))
    placed = ranged.withColumn("_in", place).join(before, ["_part", "_same"])
    return placed.withColumn("idx", (F.col("_before") + F.col("_in") - 1).cast("long")).drop("_same", "_part", "_in", "_before")


def _levels(first: DataFrame, deepest: int, name: str) -> DataFrame:
    """Inner nodes of all trees over ``first`` (tree, idx, digest, depth): tree, level, idx, digest, children, depth."""
    found, below = None, first
    for level in range(1, deepest + 1):
        runs = below.where(F.col("depth") >= level).groupBy("tree", "depth", F.floor(F.col("idx") / FAN).alias("up"))
        sorted_run = F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda c: c["digest"])
        above = runs.agg(sorted_run.alias("children")).select(
            "tree", F.lit(level).alias("level"), F.col("up").alias("idx"),
            F.sha2(F.concat_ws("", "children"), 256).alias("digest"), "children", "depth",
        )
        above = cut(above, name)
        found = above if found is None else found.union(above)
        below = above
    if found is None:
        return first.where("false").select(
            "tree", F.lit(0).alias("level"), "idx", "digest", F.array(F.lit("")).alias("children"), "depth"
        )
    return found


def build(docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", source: str = "source", seen: Column | None = None) -> Manifest:
    """Leaves and nodes of ``docs``; ``seen`` is the digest that a row has when it is audited, its leaf if not given."""
    own = digest([F.col(f"`{c}`") for c in fields])
    rows = docs.select(F.col(f"`{source}`").alias("source"), F.col(f"`{key}`").alias(key), own.alias("leaf"), (own if seen is None else seen).alias("seen"))
    leaves = cut(_numbered(rows, key).withColumn("depth", _depth(F.col("n"))), "leaves")
    roots = leaves.where("idx = 0").select("tree", "depth", "n")
    deepest, trees = roots.agg(F.coalesce(F.max("depth"), F.lit(0)), F.count(F.lit(1))).first()
    inner = _levels(leaves.select("tree", "idx", F.col("leaf").alias("digest"), "depth"), deepest, "level")
    tops = inner.where("level = depth").select("tree", "digest").union(leaves.where("depth = 0").select("tree", F.col("leaf").alias("digest")))
    top_depth = sum(trees > FAN**k for k in range(_LEVELS - 1))
    tops = tops.select(F.lit(_TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest", F.lit(top_depth).alias("depth"))
    every = inner.union(_levels(tops, top_depth, "top"))
    is_subroot = (F.col("tree") != _TOP) & (F.col("level") == F.col("depth"))
    nodes = every.select(
        _name("tree", "level", "idx").alias("node"),
        *_parent(F.col("level"), top_depth),
        "digest", "children", F.when(is_subroot, F.col("digest")).alias("subroot"),
    )
    leaves = leaves.select("source", key, "leaf", "seen", "tree", "idx", *_parent(F.lit(0), top_depth))
    return Manifest(leaves, cut(nodes, "nodes"))


def _parent(level: Column, top_depth: int) -> list[Column]:
    """Name of the parent and place in its run of a node (tree, level, idx, depth); null at the root."""
    rooted = level == F.col("depth")
    in_top = _name(F.lit(_TOP), 1, F.floor(F.col("tree") / FAN)) if top_depth else F.lit(None).cast("string")
    parent = F.when(~rooted, _name("tree", level + 1, F.floor(F.col("idx") / FAN))).when(F.col("tree") != _TOP, in_top)
    place = F.when(rooted & (F.col("tree") != _TOP), F.col("tree")).otherwise(F.col("idx")) % FAN
    return [parent.alias("parent"), place.cast("int").alias("place")]


_CLIMB = """
WITH RECURSIVE climb(run, parent, place, folds, upper, subroot, root) AS (
  SELECT node, parent, place, folds, '', subroot, digest FROM {runs}
  UNION ALL
  SELECT c.run, n.parent, n.place,
         transform(c.folds, f -> sha2(concat_ws('', transform(n.children, (d, i) -> if(i = c.place, f, d))), 256)),
         concat(c.upper, concat_ws('', filter(n.children, (d, i) -> i <> c.place))),
         coalesce(c.subroot, n.subroot), n.digest
  FROM climb c JOIN {nodes} n ON n.node = c.parent)
SELECT run, folds, upper, subroot, root FROM climb WHERE parent IS NULL
"""
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def climb(manifest: Manifest, key: str = "doc_id") -> DataFrame:
    """For each leaf: key, leaf, subroot, root, proof (digest of its siblings up to the root), folded_root, verified."""
    spark = manifest.nodes.sparkSession
    member = F.struct(key, "place", "leaf", "seen")
    runs = manifest.leaves.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.collect_list(member).alias("members"))

    def through(children: Column, place: Column, put: Column) -> Column:
        return F.sha2(F.concat_ws("", F.transform(children, lambda d, i: F.when(i == place, put).otherwise(d))), 256)

    folds = F.transform("members", lambda m: through(F.col("children"), m["place"], m["seen"]))
    runs = cut(runs.join(manifest.nodes, "node").withColumn("folds", folds), "runs")
    state = runs.select("node", "parent", "place", "folds", "subroot", "digest")
    links = manifest.nodes.select("node", "parent", "place", "children", "subroot", "digest")
    before = spark.conf.get(_ROW_LIMIT)
    spark.conf.set(_ROW_LIMIT, "-1")  # the rows of all steps follow the leaves
    try:
        top = cut(spark.sql(_CLIMB, runs=state, nodes=links), "climb")
    finally:
        spark.conf.set(_ROW_LIMIT, before)
    met = runs.select(F.col("node").alias("run"), "members", "children").join(top, "run")
    each = met.select("children", "upper", "subroot", "root", F.explode(F.arrays_zip("members", "folds")).alias("m"))
    m = F.col("m.members")
    own = F.filter("children", lambda d, i: i != m["place"])
    proven = each.select(
        m[key].alias(key), m["leaf"].alias("leaf"), F.coalesce("subroot", m["leaf"]).alias("subroot"), "root",
        F.sha2(F.concat(F.concat_ws("", own), "upper"), 256).alias("proof"), F.col("m.folds").alias("folded_root"),
    )
    alone = manifest.leaves.where("parent is null").select(
        key, "leaf", F.col("leaf").alias("subroot"), F.col("leaf").alias("root"),
        F.sha2(F.lit(""), 256).alias("proof"), F.col("seen").alias("folded_root"),
    )
    return proven.union(alone).withColumn("verified", F.col("folded_root") == F.col("root"))


def audit_lowered(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` proven against the manifest after a fifth of the texts, by checksum of the id, lost its capitals."""
    changed = digest([lower_ascii(F.col("text")) if c == "text" else F.col(c) for c in FIELDS])
    own = digest([F.col(c) for c in FIELDS])
    return climb(build(docs, seen=tampered(F.col("doc_id"), changed, own)))


def sql(levels: int = 5, top_levels: int = 3) -> str:
    """DuckDB SQL of ``audit_lowered`` for up to 16 ** levels documents of a source and 16 ** top_levels sources."""
    names = ", ".join(f"coalesce(octet_length(encode({{{c}}})) || ':' || {{{c}}}, '-')" for c in FIELDS).replace("{text}", "{t}")
    fields = {c: f"CAST({c} AS VARCHAR)" for c in FIELDS}
    leaf = f"sha256(concat({names.format(**fields, t='text')}))"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    changed = f"sha256(concat({names.format(**fields, t=lowered)}))"
    steps = ", ".join(["-1"] * 8)
    crc = (
        "xor(list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: "
        f"[CAST(ord(ch) AS BIGINT), {steps}])), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, "
        "CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"
    )
    out = [
        f"l AS (SELECT doc_id, source, {leaf} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {changed} ELSE {leaf} END AS seen FROM documents)",
        "z AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS n,"
        " row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l)",
        "a0 AS (SELECT tree, n, i, leaf AS d FROM z)",
    ]

    def grow(a: str, count: int) -> None:
        for k in range(count):
            run = "PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN"
            out.append(
                f"{a}s{k} AS (SELECT tree, n, i, coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lo,"
                f" coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS hi FROM {a}{k})"
            )
            node = f"CASE WHEN n <= {FAN**k} THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END"
            out.append(f"{a}{k + 1} AS (SELECT tree, n, i // 16 AS i, {node} AS d FROM {a}{k} GROUP BY tree, n, i // 16)")

    grow("a", levels)
    out.append(f"b0 AS (SELECT 0 AS tree, (SELECT count(*) FROM a{levels}) AS n, tree AS i, d FROM a{levels})")
    grow("b", top_levels)
    out.append("c0 AS (SELECT doc_id, leaf, tree, n, i, seen AS f, '' AS p FROM z)")
    for k in range(levels):
        fold = f"CASE WHEN c.n <= {FAN**k} THEN f ELSE sha256(lo || f || hi) END"
        out.append(
            f"c{k + 1} AS (SELECT doc_id, leaf, c.tree, c.n, c.i // 16 AS i, {fold} AS f, p || lo || hi AS p"
            f" FROM c{k} c JOIN as{k} s ON c.tree = s.tree AND c.i = s.i)"
        )
    out.append(f"e0 AS (SELECT doc_id, leaf, a.d AS subroot, c.tree AS i, f, p FROM c{levels} c JOIN a{levels} a ON c.tree = a.tree)")
    for k in range(top_levels):
        fold = f"CASE WHEN s.n <= {FAN**k} THEN f ELSE sha256(lo || f || hi) END"
        out.append(f"e{k + 1} AS (SELECT doc_id, leaf, subroot, e.i // 16 AS i, {fold} AS f, p || lo || hi AS p FROM e{k} e JOIN bs{k} s ON e.i = s.i)")
    body = ",\n".join(out)
    return (
        f"WITH {body}\nSELECT doc_id, leaf, subroot, b.d AS root, sha256(p) AS proof_sha256, f AS folded_root, f = b.d AS verified"
        f" FROM e{top_levels}, b{top_levels} b"
    )
