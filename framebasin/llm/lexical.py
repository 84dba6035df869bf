"""Ranked lexical search by presence masks: integer BM25 of every document for every item.

1. Items come in blocks of a bounded number. One pass over the texts keeps, for each document with a term, its length
   and the frequencies of the block's terms; Spark counts documents, lengths and document frequencies from that table.
2. Each task reads its documents in blocks of bounded size. A term's bitmap marks the documents of the block that
   hold it; shifted and joined, the bitmaps of an item's terms give each document its presence mask, and documents
   with equal masks form a group. The highest score of a mask is the sum, over its terms, of the highest part that any
   document of the block has. Groups are scored in descending order of it, until the next cannot reach the worst of the
   task's ten best so far; an equal one still can, by a smaller id.
3. The best of all tasks, ten for an item and task, meet in one window over the item.

Nothing but the block's terms is sent to the tasks, and no list of a frequent term leaves one.

Defined results: null texts and texts without terms are no documents and match nothing. An item without terms, or
whose terms no document holds with a weight above 0, has no rows. Repeated rows are documents of their own, repeated
items are searched each. Equal scores go by ascending id, null ids last. Empty tables give an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .frames import slices

_SLICE = 1 << 21
_TERM = [48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123 or c >= 128 for c in range(256)]
#: Bytes outside of terms become spaces, A-Z lose their case; bytes above 127 stand for other scripts and stay.
_FOLD = bytes((c + 32 if 65 <= c < 91 else c) if _TERM[c] else 32 for c in range(256))


@dataclass(frozen=True)
class Plan:
    top: int = 10
    items: int = 512  # in a block
    cells: int = 1 << 21  # numbers of a block of documents that a task holds


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, slice by slice."""
    data, at = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD), 0
    while at < len(data):
        to = data.find(b" ", at + _SLICE) if at + _SLICE < len(data) else len(data)
        to = len(data) if to < 0 else to
        yield data[at:to].split()
        at = to


def _item_terms(items: DataFrame) -> DataFrame:
    """item_id, terms and counts of each item, and a key that puts it in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = []
            for text in batch.column("text").to_pylist():
                seen = Counter()
                for part in terms(text):
                    seen.update(part)
                found.append(seen)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("item_id"),
                    batch.column("block"),
                    pa.array([list(s) for s in found], pa.list_(pa.binary())),
                    pa.array([list(s.values()) for s in found], pa.list_(pa.int64())),
                ],
                ["item_id", "block", "terms", "counts"],
            )

    return items.mapInArrow(run, "item_id long, block int, terms array<binary>, counts array<long>")


def _postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the document), terms (numbers of the vocabulary, ascending) and their frequencies."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in slices(batches, "text"):
            lengths, ends, held, times = [], [0], [], []
            for text in batch.column("text").to_pylist():
                n, seen = 0, Counter()
                for part in terms(text):
                    n += len(part)
                    seen.update(map(number, part))
                seen.pop(None, None)
                lengths.append(n)
                for k in sorted(seen):
                    held.append(k)
                    times.append(seen[k])
                ends.append(len(held))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(held, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
                ],
                ["doc_id", "n", "terms", "times"],
            ).filter(pa.array([n > 0 for n in lengths], pa.bool_()))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, times array<long>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _masks(bitmaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct presence masks of the columns of ``bitmaps`` (terms x documents), as columns, and the mask of each."""
    if len(bitmaps) <= 64:
        mask = np.zeros(bitmaps.shape[1], np.uint64)
        for bit, row in enumerate(bitmaps):
            mask |= row.astype(np.uint64) << np.uint64(bit)
        values, first, group = np.unique(mask, return_index=True, return_inverse=True)
    else:
        packed = np.ascontiguousarray(np.packbits(bitmaps, axis=0).T)
        whole = packed.view(np.dtype((np.void, packed.shape[1])))[:, 0]
        values, first, group = np.unique(whole, return_index=True, return_inverse=True)
    return bitmaps[:, first], group


class _Best:
    """The best documents of one item so far: highest score first, then smallest id."""

    def __init__(self, top: int):
        self.top, self.heap = top, []  # (score, -id), null ids as the smallest

    def least(self) -> int:
        """No score below this one can enter."""
        return self.heap[0][0] if len(self.heap) == self.top else 1

    def add(self, score: int, minus_id: int) -> None:
        if len(self.heap) < self.top:
            heapq.heappush(self.heap, (score, minus_id))
        elif (score, minus_id) > self.heap[0]:
            heapq.heapreplace(self.heap, (score, minus_id))


_NO_ID = -(1 << 64)


def _search(part: np.ndarray, ids: list[int], held: list[tuple[np.ndarray, np.ndarray]], best: list[_Best]) -> None:
    """Scores the documents of a block, columns of ``part`` (terms x documents), for all items."""
    highest = part.max(axis=1)
    for (which, times_weight), found in zip(held, best, strict=True):
        if not len(which) or int(highest[which] @ times_weight) < found.least():
            continue
        mine = part[which]
        masks, group = _masks(mine > 0)
        bound = (highest[which] * times_weight) @ masks
        order = np.argsort(-bound, kind="stable")
        by_group = np.argsort(group, kind="stable")
        starts = np.searchsorted(group[by_group], np.arange(len(bound) + 1))
        for g in order:
            if bound[g] < found.least():
                break
            docs = by_group[starts[g] : starts[g + 1]]
            present = masks[:, g]
            for d, score in zip(docs.tolist(), (times_weight[present] @ mine[np.ix_(present, docs)]).tolist(), strict=True):
                if score >= found.least():
                    found.add(score, ids[d])


def _candidates(postings: DataFrame, held: list[tuple[np.ndarray, np.ndarray]], size: int, n_docs: int, all_terms: int, plan: Plan) -> DataFrame:
    """The best documents of each task: item (number in the block), doc_id, score."""
    shared = postings.sparkSession.sparkContext.broadcast(held)
    step, top = max(16, plan.cells // max(size, 1)), plan.top

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        best = [_Best(top) for _ in items]
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                n = piece.column("n").to_numpy().astype(object)  # 75 * n * N may pass 64 bits
                m = np.array([25 + 75 * x * n_docs // all_terms for x in n], np.int64)
                lists, times = piece.column("terms"), piece.column("times").flatten().to_numpy()
                doc = np.repeat(np.arange(piece.num_rows), np.diff(lists.offsets.to_numpy()))
                part = np.zeros((size, piece.num_rows), np.int64)
                part[lists.flatten().to_numpy(), doc] = 1_000_000_000 * times // (1000 * times + 8 * m[doc])
                ids = [_NO_ID if x is None else -x for x in piece.column("doc_id").to_pylist()]
                _search(part, ids, items, best)
        rows = [(k, None if i == _NO_ID else -i, s) for k, b in enumerate(best) for s, i in b.heap]
        item, ids, scores = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int32()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["item", "doc_id", "score"]
        )

    return postings.mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The ``top`` best documents of each item: item_id, rank (from 1), doc_id, score."""
    spark = docs.sparkSession
    blocks = max(1, -(-items.count() // plan.items))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int").alias("block")
    found = _item_terms(items.select(F.col("item_id").cast("long").alias("item_id"), "text", block))
    if blocks > 1:
        found = cut(found, "items")
    out = None
    for b in range(blocks):
        asked = found.where(F.col("block") == b).collect()  # about plan.items rows
        vocabulary = {t: k for k, t in enumerate(sorted({bytes(t) for r in asked for t in r["terms"]}))}
        postings = cut(_postings(docs, vocabulary), "postings")
        n_docs, all_terms = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = dict(postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a row for each term of the block
        held = []
        for r in asked:
            weighed = {vocabulary[bytes(t)]: c * weight(n_docs, df.get(vocabulary[bytes(t)], 0)) for t, c in zip(r["terms"], r["counts"], strict=True)}
            weighed = {t: w for t, w in weighed.items() if w > 0 and t in df}  # others add nothing to a score
            held.append((np.array(list(weighed), np.int64), np.array(list(weighed.values()), np.int64)))
        numbered = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(asked)], "item int, item_id long")
        best = _candidates(postings, held, len(vocabulary), n_docs, all_terms, plan)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
        best = best.withColumn("rank", rank).where(F.col("rank") <= plan.top)
        best = best.join(F.broadcast(numbered), "item").select("item_id", "rank", "doc_id", "score")
        if blocks > 1:
            best = cut(best, "best")
        out = best if out is None else out.union(best)
    return out


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
j AS (SELECT q, item_id, term, count(*) AS c FROM i GROUP BY ALL),
k AS (SELECT count(*)::BIGINT AS n_docs, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
u AS (SELECT r, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d),
p AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM u WHERE term IN (SELECT term FROM j) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, k GROUP BY term, n_docs),
s AS (SELECT q, item_id, r, doc_id,
             sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // l))))::BIGINT AS score
      FROM j JOIN w USING (term) JOIN p USING (term), k GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) <= 10
"""
