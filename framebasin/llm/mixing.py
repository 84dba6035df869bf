"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every document gets a virtual finish time: the words of its source up to and including it, in shuffled order
(an MD5 of id and seed), divided by the target of its source. Sources whose target exceeds their size are read
again, up to ``passes`` times. The queue is range-partitioned by finish time, range totals are summed up, and the
one range in which the budget runs out is ordered row by row; the mix is the queue up to the budget, whole
documents only. So every source is served within one document of its target.

A source may hold any share of the rows: running sums are taken inside 4096 ranges of the shuffle key and the
totals of ranges, one row for each source and range, are added back.

Defined results: null texts and texts without words have size 0 and are never taken; a source of such texts only has
target 0 and no finish times (null). Null sources form one
source, last in order. Rows with equal ids and repeated rows are separate documents; ties in finish time go by
source, pass, key, id and size. An empty table gives an empty mix. Extra columns stay in ``mix`` and
do not matter to ``shares``, which reads three columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .frames import carry, n_words, restore

#: Finish times are binned this finely; 1.0 is where every source has reached its target.
_BINS = 4096
_LAST_BIN = 16 * _BINS


def _numbered(df: DataFrame, order: Column, into: str) -> DataFrame:
    """Rows with their place in a global order: range partitions, places inside them, totals before them."""
    ranged = cut(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = totals.select(  # a row for each partition
        "_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before")
    )
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return (
        ranged.withColumn("_place", place)
        .join(F.broadcast(before), "_part")
        .withColumn(into, F.col("_before") + F.col("_place") - 1)
        .drop("_part", "_place", "_before")
    )


def targets(sizes: DataFrame, weights: tuple[int, ...], passes: int) -> DataFrame:
    """``sizes`` (source, source_size) with the weight and the target of each source.

    The budget is the total size. A target stops at ``passes`` times the source's size; what it leaves goes to
    the other sources by weight until no target is above its stop.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = cut(
        _numbered(sizes, F.col("source").asc_nulls_last(), "_rank").withColumn("weight", weight.cast("long")), "sources"
    )
    stop, level = passes * F.col("source_size"), None
    whole, total = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = whole
    while budget and budget / total != level:
        level = budget / total
        full = stop < F.lit(level) * F.col("weight")
        left, total = ranked.agg(
            F.coalesce(F.sum(F.when(full, stop)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))
        ).first()
        budget = whole - left
    share = F.lit(float(level or 0.0)) * F.col("weight")
    return ranked.select(
        "source", "source_size", "weight", F.when(stop < share, stop.cast("double")).otherwise(share).alias("target")
    )


def shares(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), passes: int = 3, seed: str = "mix"
) -> DataFrame:
    """For every document the words and passes of it that the mix takes.

    ``docs`` has doc_id, text and source. Columns: doc_id, source, size, text_hash, source_size, target, passes,
    taken, finish (of the first pass).
    """
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))  # equal for null sources
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = cut(
        docs.select(
            "doc_id",
            "source",
            n_words(F.col("text")).alias("size"),
            F.xxhash64("text").alias("text_hash"),
            name.alias("_source"),
            key.alias("_key"),
            F.conv(F.substring(key, 1, 3), 16, 10).cast("int").alias("_bin"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "sizes",
    )
    bins = cut(sized.groupBy("_source", "source", "_bin").agg(F.sum("size").alias("_size")), "bins")
    per_source = targets(bins.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, passes)
    before = bins.withColumn(
        "_before", F.sum("_size").over(Window.partitionBy("_source").orderBy("_bin")) - F.col("_size")
    ).join(per_source.withColumn("_source", name).drop("source", "weight"), "_source")
    inside = Window.partitionBy("_source", "_bin").orderBy("_key", "doc_id", "size", "_row").rowsBetween(
        Window.unboundedPreceding, 0
    )
    placed = cut(
        sized.withColumn("_end", F.sum("size").over(inside)).join(
            before.drop("source", "_size"), ["_source", "_bin"]
        ).withColumn("_end", F.col("_end") + F.col("_before")).drop("_before"),
        "places",
    )

    def finish(n: Column) -> Column:
        return (n * F.col("source_size") + F.col("_end")).cast("double") / F.nullif("target", F.lit(0.0))

    def range_of(n: Column) -> Column:
        return F.floor(F.least(finish(n) * _BINS, F.lit(float(_LAST_BIN)))).cast("int")

    every = F.array(*[F.lit(p) for p in range(passes)])
    served = placed.where("size > 0").withColumn("_pass", F.explode(every))
    ranges = served.groupBy(range_of(F.col("_pass")).alias("_range")).agg(F.sum("size").alias("_words"))
    running = ranges.select("_range", F.sum("_words").over(Window.orderBy("_range")).alias("_to"), "_words")
    budget = per_source.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    over = running.where(F.col("_to") > budget).orderBy("_range").select("_range", "_to", "_words").first()
    last, spent = (over[0], over[1] - over[2]) if over else (_LAST_BIN + 1, 0)

    queue = Window.partitionBy("_range").orderBy(
        "_finish", F.col("source").asc_nulls_last(), "_pass", "_key", "doc_id", "size", "_row"
    ).rowsBetween(Window.unboundedPreceding, 0)
    edge = (
        served.withColumn("_range", range_of(F.col("_pass")))
        .where(F.col("_range") == last)
        .withColumn("_finish", finish(F.col("_pass")))
        .withColumn("_to", F.sum("size").over(queue) + spent)
        .where(F.col("_to") <= budget)
        .groupBy("_row")
        .agg(F.count(F.lit(1)).alias("_edge"))
    )
    whole = F.size(F.filter(every, lambda p: range_of(p) < last))
    count = F.when(F.col("size") > 0, whole + F.coalesce(F.col("_edge"), F.lit(0))).otherwise(0).cast("long")
    return placed.join(edge, "_row", "left").select(
        "doc_id",
        "source",
        "size",
        "text_hash",
        "source_size",
        "target",
        count.alias("passes"),
        (count * F.col("size")).alias("taken"),
        finish(F.lit(0)).alias("finish"),
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), passes: int = 3, seed: str = "mix") -> DataFrame:
    """The documents of the mix with ``mix_passes``, how often each is read, and ``mix_finish``, its place.

    Documents are matched to their shares by id, source, size and text; equal rows are numbered on both sides.
    Columns of ``docs`` that have these two names are replaced.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    nth = F.row_number().over(Window.partitionBy("_id").orderBy("_s", "_size", "_hash"))
    chosen = shares(docs, weights, passes, seed).select(
        name.alias("_id"), F.col("source").alias("_s"), F.col("size").alias("_size"),
        F.col("text_hash").alias("_hash"), F.col("passes").alias("mix_passes"), F.col("finish").alias("mix_finish"),
    )
    needed = ("doc_id", "text", "source")
    left = carry(docs, needed).withColumns(
        {"_id": name, "_s": F.col("source"), "_size": n_words(F.col("text")), "_hash": F.xxhash64("text")}
    ).withColumn("_nth", nth)
    taken = F.collect_list(F.struct("_nth", "mix_passes", "mix_finish")).alias("_taken")
    right = chosen.withColumn("_nth", nth).where("mix_passes > 0").groupBy(F.col("_id").alias("_rid")).agg(taken)
    # joined by id alone, so the exchange of the texts for the numbering serves the join too
    mine = F.get(F.filter("_taken", lambda t: t["_nth"] == F.col("_nth")), F.lit(0))
    met = left.join(right, F.col("_id") == F.col("_rid")).withColumn("_mine", mine).where("_mine is not null")
    met = met.withColumns({"mix_passes": F.col("_mine.mix_passes"), "mix_finish": F.col("_mine.mix_finish")})
    return restore(met, docs, needed, ("mix_passes", "mix_finish"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
fill(n, level, prev) AS (
  SELECT 0, (SELECT sum(source_size)::DOUBLE / sum(w)::DOUBLE FROM s), CAST(-1 AS DOUBLE)
  UNION ALL
  SELECT n + 1,
    (SELECT ((SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) FILTER (3 * source_size < level * w), 0))::DOUBLE
            / (sum(w) FILTER (3 * source_size >= level * w))::DOUBLE FROM s), level
  FROM fill WHERE level <> prev),
t AS (SELECT source, source_size,
             CASE WHEN 3 * source_size < level * w THEN (3 * source_size)::DOUBLE ELSE level * w END AS target
      FROM s, (SELECT level FROM fill ORDER BY n DESC LIMIT 1)),
p AS (SELECT d.*, t.source_size, t.target,
             sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size, r ROWS UNBOUNDED PRECEDING) AS e
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT p.r, p.size, sum(size) OVER (ORDER BY (g.n * source_size + e)::DOUBLE / target, source NULLS LAST, g.n, k,
             doc_id, size, p.r ROWS UNBOUNDED PRECEDING) AS upto
      FROM p, (SELECT unnest([0, 1, 2]) AS n) g WHERE size > 0),
c AS (SELECT r, count(*) AS n FROM q WHERE upto <= (SELECT sum(source_size) FROM s) GROUP BY r)
SELECT doc_id, size, source_size, target, (coalesce(c.n, 0) * size)::BIGINT AS taken
FROM p LEFT JOIN c USING (r)
"""
