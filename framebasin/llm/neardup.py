"""Near-duplicate documents from bottom-k sketches of word shingles.

1. One pass over the texts hashes the shingles of each document with one hash function and keeps: the size of the
   set, a 128-bit digest of it, the ``k`` smallest hashes (the sketch), and 64 one-bit minima as a cheap filter.
2. Documents with equal sets fold into one representative, by an aggregate with map-side combine.
3. A representative is listed under the rarest of its ``listed`` smallest values: sets at the threshold share at
   least ``least`` of them but for two pairs in a million, so they share one of the ``listed - least + 1`` that are
   rarest in any fixed order. Rarity comes from counts of all sketch values in a table of fixed size.
4. Members of a list are paired with a hub of the list, never with each other: first the member with most company
   in its own lists, as the original of many copies has, then the first in a random order that changes by round. One-bit minima and the estimate from the union of both sketches filter the pairs, the exact
   Jaccard of full sets confirms them, and confirmed pairs merge components.
5. Rounds end when one merges few components compared with the first. Of the lists that still hold several components
   those of at most ``small`` members keep who has a member of another component near by size and one-bit minima; longer
   ones keep all. Full sets of these documents are ordered, rarest shingle first. If two sets reach the threshold, so
   many shingles follow their first common one in both that it stands among the first fifth of each; sets are listed
   under those, and two of different components meet only where the places and sizes leave the threshold possible.

Only sets of documents in surviving pairs or in the last step are built again from their texts. A group of near copies
costs a pair or two for each member and round, whatever its size. Members that no hub is linked with mostly differ from
it by shingles of their own, which come first in their order, so few pairs of them meet in the last step. A hot list is
split by the skew join. Tables written on the way are removed as soon as the components are known.

Defined results: null texts and texts without words have an empty set and are linked with nothing. A text shorter
than a shingle is one shingle. Equal rows are linked. Null ids never become a component's id unless it has no
other. An empty table gives an empty result. Extra columns are ignored; ``distinct_documents`` keeps them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import passing
from .components import merge_labels, relabel
from .frames import _REST, carry, cut_lean as cut, give_back, lean, restore, slices
from .words import grams, mix, signed, words


_BUCKET_BYTES = 4 << 20  # of full sets that one task compares
_FEW = 1 << 20  # rows of three numbers that may be broadcast


def _few(table: DataFrame) -> DataFrame:
    """A written table of ids, broadcast if counting shows that it is small; joined by a shuffle otherwise."""
    return F.broadcast(table) if table.count() <= _FEW else table


def _named(pairs: DataFrame, column: str) -> DataFrame:
    return _few(cut(pairs.select(F.col(column).alias("id")).distinct(), "ids"))


@dataclass(frozen=True)
class Plan:
    width: int = 5  # words in a shingle
    percent: int = 80  # least similarity
    k: int = 128  # values in a sketch
    listed: int = 64  # smallest values of a sketch that lists are drawn from
    least: int = 36  # of these that sketches at the threshold share; Bin(64, 0.8) is below with 2e-6
    flips: int = 20  # one-bit minima that may differ; Bin(64, 0.1) is above with 1e-6
    sigmas: float = 5.0  # slack of the estimate
    cells: int = 1 << 18  # counters of the rarity table
    rounds: int = 6  # hub rounds at most; what they leave is done pair by pair
    tries: int = 2  # hubs a member is verified with in a round
    small: int = 1024  # members of a list that are compared by one-bit minima before the last step
    parities: int = 8  # longs of parity bits that pairs of the last step are compared by


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z count as lower case."""
    w = words(texts, lower=True)
    every = grams(w.hashes, width)
    for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True):
        if b - a >= width:
            yield np.unique(every[a : b - width + 1])
        elif b > a:
            yield grams(w.hashes[a:b], b - a, seed=1)
        else:
            yield np.zeros(0, np.uint64)


_EDGES = np.arange(65, dtype=object) * (1 << 58)
_EDGES = np.array([int(x) for x in _EDGES[:64]], np.uint64)


def _one_bit_minima(s: np.ndarray) -> int:
    at = np.searchsorted(s, _EDGES)
    inside = np.append(at[1:], len(s)) > at
    bits = np.zeros(64, np.uint64)
    bits[inside] = mix(s[at[inside]]) & np.uint64(1)
    return int(np.bitwise_or.reduce(bits << np.arange(64, dtype=np.uint64)).astype(np.int64))


def sketches(docs: DataFrame, plan: Plan) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_hash, n, d1, d2 (digest of the set), minima, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = list(shingle_sets(batch.column("text"), plan.width))
            mixed = [mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)) for s in sets]
            longs = lambda v: pa.array(np.array(v, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    longs([len(s) for s in sets]),
                    longs([int(s.sum().astype(np.int64)) for s in sets]),
                    longs([int(np.bitwise_xor.reduce(m, initial=0).astype(np.int64)) for m in mixed]),
                    longs([_one_bit_minima(s) for s in sets]),
                    pa.array([s[: plan.k].tobytes() for s in sets], pa.binary()),
                ],
                ["doc_id", "text_hash", "n", "d1", "d2", "minima", "sketch"],
            )

    schema = "doc_id long, text_hash long, n long, d1 long, d2 long, minima long, sketch binary"
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(lean(run), schema)


def _rarity(table: DataFrame, column: str, plan: Plan, first: int | None = None) -> Broadcast[np.ndarray]:
    """How many of the ``first`` values of each row (all without it) fall into each cell; the driver gets ``cells`` rows."""
    end = None if first is None else 8 * first
    cells = np.uint64(plan.cells - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(plan.cells, np.int64)
        for batch in slices(batches, column):
            values = np.frombuffer(b"".join(s[:end] for s in batch.column(column).to_pylist()), np.uint64)
            totals += np.bincount((mix(values) & cells).astype(np.int64), minlength=plan.cells)
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[at])], ["cell", "n"])

    totals = table.select(column).mapInArrow(lean(count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counted = cut(totals, "cells").toPandas()  # at most plan.cells rows
    rarity = np.zeros(plan.cells, np.int64)
    rarity[counted["cell"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    return table.sparkSession.sparkContext.broadcast(rarity)


def _rarest_first(values: np.ndarray, held: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, value and place in its row of ``held`` values of each row, the rarest first."""
    row = np.repeat(np.arange(len(held)), held)
    order = np.lexsort((values, rare[(mix(values) & np.uint64(len(rare) - 1)).astype(np.int64)], row))
    return row, values[order], np.arange(len(row)) - np.repeat(np.cumsum(held) - held, held)


def _listed(reps: DataFrame, plan: Plan) -> DataFrame:
    """The lists a representative stands in: value, id, n, minima."""
    shared = _rarity(reps, "sketch", plan, plan.listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy()
            held = np.minimum(n, plan.listed)
            values = np.frombuffer(b"".join(s[: 8 * plan.listed] for s in batch.column("sketch").to_pylist()), np.uint64)
            row, values, place = _rarest_first(values, held, shared.value)
            # a whole set at the threshold shares percent of its values with any partner that lists all of its own; the
            # largest partner may leave some of the shared ones unlisted
            most = 100 * n // plan.percent
            shared_most = -(-plan.percent * (n + most) // (100 + plan.percent)) - np.maximum(most - plan.listed, 0)
            need = np.where(n < plan.listed, np.minimum(-(-plan.percent * n // 100), np.maximum(shared_most, 1)), plan.least)
            keep = place < (held - need + 1)[row]
            row, values = row[keep], values[keep]
            take = lambda c: batch.column(c).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(values)), take("id"), take("n"), take("minima")], ["value", "id", "n", "minima"]
            )

    return reps.select("id", "n", "minima", "sketch").mapInArrow(lean(run), "value long, id long, n long, minima long")


def _parities(s: np.ndarray, longs: int) -> np.ndarray:
    """For each bit whether an odd number of values falls on it: two sets differ in as many values as bits, at least."""
    odd = np.bincount((mix(s ^ np.uint64(0x5C5C5C5C5C5C5C5C)) % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _parity_rows(sets: DataFrame, plan: Plan) -> DataFrame:
    """id, n (size of the set), p0, p1, ..."""
    names = ["id", "n", *[f"p{k}" for k in range(plan.parities)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "items"):
            every = [np.frombuffer(s, np.uint64) for s in batch.column("items").to_pylist()]
            parities = np.stack([_parities(s, plan.parities) for s in every])
            sizes = pa.array(np.array([len(s) for s in every], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), sizes, *[pa.array(np.ascontiguousarray(p)) for p in parities.T]], names)

    return sets.select("id", "items").mapInArrow(lean(run), ", ".join(f"{c} long" for c in names))


def _prefixes(sets: DataFrame, plan: Plan) -> DataFrame:
    """The shingles of full sets that may be the first common one of a pair: value, id, after (itself and those behind)."""
    shared = _rarity(sets, "items", plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "items"):
            held = np.array([len(s) // 8 for s in batch.column("items").to_pylist()], np.int64)
            values = np.frombuffer(b"".join(batch.column("items").to_pylist()), np.uint64)
            row, values, place = _rarest_first(values, held, shared.value)
            after = held[row] - place
            keep = 100 * after >= plan.percent * held[row]  # the smallest partner has percent of the size
            row, values, after = row[keep], values[keep], after[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(values)), batch.column("id").take(pa.array(row)), pa.array(after.astype(np.int32))], ["value", "id", "after"]
            )

    return sets.select("id", "items").mapInArrow(lean(run), "value long, id long, after int")


def _estimate(pairs: DataFrame, reps: DataFrame, plan: Plan) -> DataFrame:
    """Pairs (a, b) whose union sketch leaves the threshold possible, with ``estimate``."""
    pairs = cut(pairs, "met")

    def half(c: str) -> DataFrame:
        mine = reps.join(_named(pairs, c), "id", "left_semi")
        return mine.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))

    met = pairs.join(half("a"), "a").join(half("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
    goal = plan.percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, na, nb, sa, sb in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                x, y = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                ends = [s[-1] for s, n in ((x, na), (y, nb)) if n > plan.k]
                if ends:  # beyond the end of a sketch nothing is known
                    x, y = x[x <= min(ends)], y[y <= min(ends)]
                both = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - both
                share = both / union
                if share >= goal - (plan.sigmas * (goal * (1 - goal) / union) ** 0.5 if ends else 0):
                    out.append((a, b, share))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["a", "b", "estimate"]
            )

    return met.mapInArrow(lean(run), "a long, b long, estimate double")


class _Sets:
    """Full sets of the representatives that surviving pairs name, each built once from its text."""

    def __init__(self, docs: DataFrame, reps: DataFrame, plan: Plan):
        self.docs, self.reps, self.plan, self.have = docs, reps, plan, None

    def of(self, named: DataFrame) -> DataFrame:
        """The sets of the representatives in ``named`` (id): id, items."""
        self._build(named)
        return self._once().join(_few(named), "id", "left_semi")

    def _build(self, named: DataFrame) -> None:
        if self.have is not None:
            named = named.join(self.have.select("id"), "id", "left_anti")
        wanted = cut(named.join(self.reps.select("id", "rep_doc", "text_hash"), "id"), "wanted")
        width = self.plan.width
        texts = self.docs.select(F.col("doc_id").cast("long").alias("_d"), F.xxhash64("text").alias("_h"), "text").join(
            _few(wanted), F.col("_d").eqNullSafe(F.col("rep_doc")) & (F.col("_h") == F.col("text_hash"))
        )

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                sets = [s.tobytes() for s in shingle_sets(batch.column("text"), width)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], ["id", "items"])

        new = cut(texts.select("id", "text").mapInArrow(lean(build), "id long, items binary"), "sets")
        self.have = new if self.have is None else self.have.union(new)

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (x, y) with intersection * 100 >= percent * union on full sets."""
        self._build(pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct())
        percent, sets = self.plan.percent, self._once()
        # the set of x goes once to each bucket of its partners, however many there are; a bucket holds some MB of sets
        size = self.have.agg(F.sum(F.length("items"))).first()[0] or 0
        buckets = max(int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // _BUCKET_BYTES + 1)
        bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).alias("bucket")
        asked = pairs.groupBy("x", bucket("y")).agg(F.collect_list("y").alias("ys"))
        from_x, from_y = (sets.join(_named(pairs, c), "id", "left_semi") for c in "xy")
        left = asked.join(from_x.select(F.col("id").alias("x"), F.col("items").alias("mine")), "x")
        right = from_y.select(F.col("id").alias("y"), "items").withColumn("bucket", bucket("y")).select(F.col("bucket").alias("bucket"), "y", "items")

        def compare(left: pa.Table, right: pa.Table) -> pa.Table:
            views = lambda column: [np.frombuffer(v.as_buffer(), np.uint64) for v in column]
            held = dict(zip(right["y"].to_pylist(), views(right["items"]), strict=True))
            xs, ys = [], []
            for x, mine, partners in zip(left["x"].to_pylist(), (np.frombuffer(v.as_buffer(), np.uint64) for v in left["mine"]), left["ys"].to_pylist(), strict=True):
                for y in partners:
                    other = held[y]
                    both = len(np.intersect1d(mine, other, assume_unique=True))
                    if 100 * both >= percent * (len(mine) + len(other) - both):
                        xs.append(x)
                        ys.append(y)
            del held
            give_back()
            return pa.table({"x": pa.array(xs, pa.int64()), "y": pa.array(ys, pa.int64())})

        left = left.select("bucket", "x", "mine", "ys").alias("l")
        return left.groupBy("bucket").cogroup(right.alias("r").groupBy("bucket")).applyInArrow(compare, "x long, y long")

    def _once(self) -> DataFrame:
        """All sets built so far, once each; a row repeated in ``docs`` gives its set twice."""
        repeated = not self.have.groupBy("id").count().where("count > 1").isEmpty()
        return self.have.dropDuplicates(["id"]) if repeated else self.have


def components(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """One row for each document: doc_id, text_hash, n_shingles, component_id, kept.

    ``component_id`` is the smallest doc_id of the documents that links reach; ``kept`` marks that document.
    """
    return _labelled(docs, plan).drop("label")


def _labelled(docs: DataFrame, plan: Plan) -> DataFrame:
    """``components`` with a label of each, which components without any id have too; null for empty sets."""
    with passing(docs.sparkSession) as lasting:
        named = _sets_with_labels(docs, plan, lasting)
    smallest = named.groupBy("label").agg(F.min("rep_doc").alias("component_id"))
    of_set = named.join(smallest, "label").select(F.col("d1").alias("_1"), F.col("d2").alias("_2"), "component_id", "label")
    rows = sketches(docs, plan).select("doc_id", "text_hash", "n", "d1", "d2")
    met = rows.join(of_set, (F.col("n") > 0) & (F.col("d1") == F.col("_1")) & (F.col("d2") == F.col("_2")), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return met.select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"), F.when(F.col("n") > 0, F.col("label")).alias("label"),
    )


def _last_pairs(open_lists: DataFrame, near: Column, sets: _Sets, plan: Plan) -> DataFrame:
    """Pairs (a, b) of members of open lists, of different labels, that places and sizes leave possible; a has the turn."""
    # documents share rare words with some that are not like them: who has nobody near in a list needs no full set
    short = open_lists.where(F.col("all") <= plan.small)
    other = short.select(*[F.col(c).alias(f"_{c}") for c in ("value", "id", "n", "minima", "label")])
    kept = short.join(other, (F.col("value") == F.col("_value")) & near, "left_semi").union(open_lists.where(F.col("all") > plan.small))
    who = cut(kept.select("id", "label").distinct(), "members")
    mine = sets.of(who.select("id"))
    listed = cut(_prefixes(mine, plan).join(_few(who), "id"), "prefixes")
    several = listed.groupBy("value").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l < h").select("value")
    marked = _few(cut(_parity_rows(mine, plan), "parities"))  # joined to the rows that are left only
    listed = cut(listed.join(several, "value"), "prefixes").join(marked, "id")
    main = listed.groupBy("value", "label").agg(F.count(F.lit(1)).alias("m")).groupBy("value").agg(F.max(F.struct("m", "label")).alias("main"))
    odd = listed.join(main, "value").where(F.col("label") != F.col("main.label")).drop("main")
    parities = [f"p{k}" for k in range(plan.parities)]
    every = listed.select("value", *[F.col(c).alias(f"_{c}") for c in ("id", "n", "after", "label", *parities)])
    both = F.col("n") + F.col("_n")
    behind = F.least("after", "_after") * (100 + plan.percent) >= both * plan.percent
    flips = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"_{c}"))) for c in parities), F.lit(0))
    close = flips * (100 + plan.percent) <= both * (100 - plan.percent)  # the union less the intersection, at most
    met = odd.join(every, "value").where((F.col("label") != F.col("_label")) & behind & close)
    asked = met.groupBy(F.least("id", "_id").alias("a"), F.greatest("id", "_id").alias("b")).agg(F.max(F.col("id") < F.col("_id")).alias("turn"))
    x, y = F.when(F.col("turn"), F.col("a")).otherwise(F.col("b")), F.when(F.col("turn"), F.col("b")).otherwise(F.col("a"))
    return asked.select(x.alias("a"), y.alias("b"))


def _sets_with_labels(docs: DataFrame, plan: Plan, lasting: Callable[[Callable[[], DataFrame]], DataFrame]) -> DataFrame:
    """The distinct sets: d1, d2, label of the component, rep_doc; the one table that is left."""
    # sketches of all rows are never stored: the representatives keep theirs, a last pass finds the set of each row
    rows = sketches(docs, plan).withColumn("row", F.monotonically_increasing_id())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id"), "row", "text_hash", "n", "minima", "sketch"))
    reps = cut(
        rows.where("n > 0").groupBy("d1", "d2").agg(first.alias("f")).select(
            "d1", "d2", F.col("f.row").alias("id"), F.col("f.doc_id").alias("rep_doc"), "f.text_hash", "f.n", "f.minima", "f.sketch"
        ),
        "representatives",
    )
    lists = cut(_listed(reps, plan).withColumn("label", F.col("id")), "lists")
    crowded = lists.groupBy("value").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    lists = cut(lists.join(crowded, "value"), "lists")  # alone in a list, nobody to meet
    company = lists.groupBy("id").agg(F.sum("c").alias("company"))
    lists = cut(lists.join(company, "id").drop("c"), "lists")
    sets = _Sets(docs, reps, plan)
    roots = None
    near = (
        (F.col("label") != F.col("_label"))
        & (F.least("n", "_n") * 100 >= F.greatest("n", "_n") * plan.percent)
        & (F.bit_count(F.col("minima").bitwiseXOR(F.col("_minima"))) <= plan.flips)
    )
    tried, gains = None, []
    for k in range(plan.rounds + 1):
        by_label = lists.groupBy("value", "label").agg(F.count(F.lit(1)).alias("m"))
        sizes = by_label.groupBy("value").agg(F.sum("m").alias("all"), F.max(F.struct("m", "label")).alias("main")).where("main.m < all")
        sizes = cut(sizes.select("value", "all", F.col("main.label").alias("main"), (F.col("all") - F.col("main.m")).alias("odd")), "open")
        work, listed = sizes.agg(F.sum(F.col("odd") * F.col("all")), F.sum("all")).first()
        if not listed:
            break
        calm = bool(gains) and gains[-1] * 20 <= gains[0] * (len(gains) > 1)
        last = k == plan.rounds or work <= listed or calm
        open_lists = lists.join(sizes, "value")
        if last:  # members of different components that are left
            found = _estimate(_last_pairs(open_lists, near, sets, plan), reps, plan)
        else:
            order = F.xxhash64(F.col("id"), F.lit(k), F.pmod(F.col("value"), F.lit(4)))
            first_choice = -F.col("company") if k == 0 else F.lit(0).cast("long")
            hub = F.min(F.struct(first_choice.alias("f"), order.alias("o"), "id", "n", "minima", "label")).alias("h")
            hubs = open_lists.groupBy("value").agg(hub).select("value", *[F.col(f"h.{c}").alias(f"_{c}") for c in ("id", "n", "minima", "label")])
            met = open_lists.join(hubs, "value").where(near).select(F.col("id").alias("x"), F.col("_id").alias("a")).distinct()
            guess = cut(_estimate(met.select("a", F.col("x").alias("b")), reps, plan), "guesses")
            best = guess.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("estimate", "a")), False), 1, plan.tries).alias("t"))
            found = best.select(F.explode("t").alias("t"), "b").select("t.a", "b")
        named = [F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")]
        found = found.select("*", *named).dropDuplicates(["p", "q"])
        if tried is not None:
            found = found.join(tried, ["p", "q"], "left_anti")
        found = cut(found.select(F.col("a").alias("x"), F.col("b").alias("y"), "p", "q"), "pairs")
        gains.append(0)
        if not found.isEmpty():
            good = cut(sets.confirmed(found), "links")
            new = found.select("p", "q")
            tried = new if tried is None else tried.union(new)
            ends = good.select(F.col("x").alias("u"), F.col("y").alias("v"))
            if roots is not None:
                ends = relabel(relabel(ends, roots, "u"), roots, "v")
            merged = cut(merge_labels(ends), "roots")
            roots = merged if roots is None else cut(relabel(roots, merged, "root").union(merged), "roots")
            gains[-1] = merged.count()
            if not last:
                lists = cut(relabel(lists, merged, "label"), "lists")
        if last:
            break
    known = reps.withColumn("label", F.col("id"))
    known = known if roots is None else relabel(known, roots, "label")
    return lasting(lambda: cut(known.select("d1", "d2", "label", "rep_doc"), "known"))


def distinct_documents(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id; documents without words stay.

    Of several rows with that id, and of components without any id, the row with the smallest text hash stays, of
    rows with equal texts the one whose other columns come first as JSON.
    """
    with passing(docs.sparkSession) as lasting:
        judged = cut(_labelled(docs, plan).select("doc_id", "text_hash", "label", "kept"), "judged")
        first = judged.where("kept and label is not null").groupBy("label", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
        least = first.groupBy("label").agg(F.min("text_hash").alias("least"))
        first = first.join(least, "label")
        named = [F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")]
        others = judged.where("not kept").select(*named).distinct().union(first.where("text_hash <> least").select(*named))
        gone = lasting(lambda: cut(others, "gone"))
        twice = lasting(lambda: cut(first.where("text_hash = least and n > 1").select(*named), "twice"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_h"))
    needed = ("doc_id", "text")
    every = carry(docs, needed)
    repeated = not twice.isEmpty()
    out = every.join(gone.union(twice) if repeated else gone, same, "left_anti")
    if repeated:
        row = F.struct(*every.columns)
        one = every.join(twice, same).groupBy("_d", "_h").agg(F.min_by(row, F.to_json(F.struct(_REST))).alias("row"))
        out = out.union(one.select("row.*"))
    return restore(out, docs, needed)
