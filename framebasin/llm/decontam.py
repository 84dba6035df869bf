"""Benchmark decontamination: BM25 retrieval of test items for every passage, then overlap of both their parts.

The inverted index is over the test items. Every document is cut into passages of twice the longest item with half
a passage between starts, so an item of the index that stands in a text stands in one passage whole. Each passage is
a query of its distinct words. Scores are BM25 divided by the item's score against itself, so 1 is a whole
item and the threshold is the same for all. As in block-max WAND, bounds come first: the sum of the largest shares
of a passage's words, frequent words as one sum, then the same bound for each block of items; only blocks whose
bound reaches the threshold are scored, and nothing above the threshold is missed.

Items retrieved are verified: half of their five-word shingles must stand in the passage, and half of the different
words of their question (all but the last sentence) and of their answer (the last sentence, or the second half of a
single one; eight words at least). So a leak with some words changed is found too; texts that don't hold the item
share next to no five words in a row with it.

Items are split into indexes of at most ``most_words`` words each, whatever their number. Indexes of together no more
words are broadcast as one pack, and every pack is met by one pass over the documents: a task holds one Python worker
and hashes a text once, however many lengths the items of a pack have.

Defined results: null and empty texts and items match nothing. Items of fewer than five words
are found where all their words stand in a row; ``min_item`` leaves out shorter ones. Repeated rows are judged one by one. Empty tables give no hits. Extra columns stay in ``without_leaks``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import WORD, cut_lean as cut, lean, n_words, slices
from .words import Words, grams, words


@dataclass(frozen=True)
class Search:
    threshold: float = 0.6  # of the item's own score
    overlap: float = 0.5  # of the words of question and of answer
    shingles: float = 0.5  # of the shingles of the whole item
    width: int = 5
    k1: float = 1.2
    b: float = 0.75
    block: int = 8  # items in a block
    frequent: float = 0.05  # share of items from which a word counts as frequent
    min_item: int = 1
    most_words: int = 1_000_000


def folded_words(texts: pa.Array) -> Words:
    """Words in lower case, in any script: leaks in capitals count."""
    return words(pc.utf8_lower(texts))


def answer_words(text: str, least: int = 8) -> int:
    """How many words at the end of an item are its answer: its last sentence, but not fewer than ``least``."""
    body = text.strip(" \t\n\x0b\x0c\r")
    ends = [m.end() for m in re.finditer(r"[.?!][ \t\n\x0b\x0c\r]+|\n", body)]
    size = len(re.findall(WORD, body))
    last = len(re.findall(WORD, body[ends[-1] :])) if ends else size // 2
    return max(last, min(least, size))


class Index:
    """Postings of normalised BM25 shares by term, with the largest share of each term in each block."""

    def __init__(self, items: list[tuple[int, str]], s: Search):
        w = folded_words(pa.array([t for _, t in items], pa.string()))
        sizes = np.diff(w.bounds)
        self.ids = np.array([i for i, _ in items], np.int64)
        self.search, self.half, self.n_words = s, int(max(sizes.max(initial=0), 32)), int(sizes.sum())
        owner = np.repeat(np.arange(len(items)), sizes)
        self.terms, term = np.unique(w.hashes, return_inverse=True)
        key, tf = np.unique(term.astype(np.int64) * len(items) + owner, return_counts=True)
        term, item = key // len(items), key % len(items)
        df = np.bincount(term, minlength=len(self.terms))
        idf = np.log(1 + (len(items) - df + 0.5) / (df + 0.5))
        norm = s.k1 * (1 - s.b + s.b * sizes[item] / max(sizes.mean(), 1))
        share = idf[term] * tf * (s.k1 + 1) / (tf + norm)
        share /= np.bincount(item, share, len(items))[item]
        self.item, self.share = item, share
        self.at = np.searchsorted(term, np.arange(len(self.terms) + 1))
        blocks, first = np.unique(term * len(items) + item // s.block, return_index=True)
        self.block, self.block_max = blocks % len(items), np.maximum.reduceat(share, first) if len(first) else share
        self.block_at = np.searchsorted(blocks // len(items), np.arange(len(self.terms) + 1))
        self.n_blocks = (len(items) - 1) // s.block + 1
        self.largest = np.maximum.reduceat(share, self.at[:-1]) if len(self.terms) else share
        self.is_frequent = df > max(1, s.frequent * len(items))
        self.checks = []
        for _, t in items:
            h = folded_words(pa.array([t], pa.string())).hashes
            cut = max(len(h) - answer_words(t), min(s.width, len(h)))
            width = min(s.width, len(h))
            self.checks.append((width, np.unique(grams(h, width)), np.unique(h[:cut]), np.unique(h[min(cut, len(h) - 1) :])))


def _spread(at: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and posting number of all postings of the chosen terms."""
    size = at[chosen + 1] - at[chosen]
    row = np.repeat(np.arange(len(chosen)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + at[chosen][row]


def _retrieve(w, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word, item and score of all passages above the threshold."""
    s, half = index.search, index.half
    n_text = np.diff(w.bounds)
    none = np.zeros(0, np.int64)
    if not len(index.terms) or not len(w.hashes):
        return none, none, none, none
    term = np.minimum(np.searchsorted(index.terms, w.hashes), len(index.terms) - 1)
    hit = np.flatnonzero(index.terms[term] == w.hashes)
    term = term[hit]
    text = np.repeat(np.arange(len(n_text)), n_text)[hit]
    # passages of a text are numbered from first[text]; a word lies in two that start half a passage apart
    count = np.maximum(-(-n_text // half), 1)
    first = np.cumsum(count) - count
    place = (hit - w.bounds[text]) // half
    passage = np.concatenate([first[text] + place, (first[text] + place - 1)[place > 0]])
    key = np.unique(passage * len(index.terms) + np.concatenate([term, term[place > 0]]))
    passage, term = key // len(index.terms), key % len(index.terms)
    total = int(count.sum())
    slack = 1e-9
    often = index.is_frequent[term]
    calm = np.bincount(passage[often], index.largest[term[often]], total)  # all frequent words at once
    bound = calm + np.bincount(passage[~often], index.largest[term[~often]], total)
    alive = bound >= s.threshold - slack
    rare = ~often & alive[passage]
    row, post = _spread(index.block_at, term[rare])
    cell = passage[rare][row] * index.n_blocks + index.block[post]
    cells, inverse = np.unique(cell, return_inverse=True)
    upper = np.bincount(inverse, index.block_max[post], len(cells)) + calm[cells // index.n_blocks]
    open_cells = cells[upper >= s.threshold - slack]
    quiet = np.flatnonzero(alive & (calm >= s.threshold - slack))  # frequent words alone may do
    if len(quiet):
        open_cells = np.union1d(open_cells, (quiet[:, None] * index.n_blocks + np.arange(index.n_blocks)).ravel())
    if not len(open_cells):
        return none, none, none, none
    mine = np.isin(passage, open_cells // index.n_blocks)
    row, post = _spread(index.at, term[mine])
    cell = passage[mine][row] * index.n_blocks + index.item[post] // s.block
    keep = np.isin(cell, open_cells)
    pair = passage[mine][row][keep] * len(index.ids) + index.item[post][keep]
    pairs, inverse = np.unique(pair, return_inverse=True)
    score = np.bincount(inverse, index.share[post][keep], len(pairs))
    good = score >= s.threshold - slack
    pairs, score = pairs[good], score[good]
    passage, item = pairs // len(index.ids), pairs % len(index.ids)
    text = np.searchsorted(first, passage, "right") - 1
    return text, (passage - first[text]) * half, item, score


def _hits(w: Words, index: Index) -> list[tuple[int, int, float, float, float, int]]:
    """Verified (row, item, score, question overlap, answer overlap, first word), the best passage of each."""
    s = index.search
    best: dict[tuple[int, int], tuple] = {}
    known: dict[tuple[int, int, int], np.ndarray] = {}
    for text, start, item, score in zip(*(x.tolist() for x in _retrieve(w, index)), strict=True):
        a = w.bounds[text] + start
        body = w.hashes[a : min(a + 2 * index.half, w.bounds[text + 1])]
        width, shingles, question, answer = index.checks[item]
        if (text, start, width) not in known:
            known[text, start, width] = np.unique(grams(body, width))
        if np.isin(shingles, known[text, start, width]).mean() < s.shingles:
            continue
        shares = [float(np.isin(part, body).mean()) for part in (question, answer)]
        if min(shares) >= s.overlap:
            new = (score, *shares, start)
            if best.get((text, item), (-1.0,)) < new:
                best[text, item] = new
    return [(t, i, *v) for (t, i), v in sorted(best.items())]


def indexes(benchmark: DataFrame, s: Search) -> Iterator[Index]:
    """Indexes over the items of ``benchmark`` (item_id, text), each of bounded size, items of like length together."""
    sized = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", n_words(F.col("text")).alias("n"))
    sized = sized.where(F.col("n") >= s.min_item).withColumn("kind", F.floor(F.log2("n") / 2))
    for kind, total in sorted((r.kind, r.total) for r in sized.groupBy("kind").agg(F.sum("n").alias("total")).collect()):
        shards = math.ceil(total / s.most_words)
        for k in range(shards):
            mine = sized.where((F.col("kind") == kind) & (F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k))
            rows = sorted((r.item_id if r.item_id is not None else -1, r.text) for r in mine.select("item_id", "text").collect())
            if rows:
                yield Index(rows, s)


def packs(benchmark: DataFrame, s: Search) -> Iterator[list[Index]]:
    """The indexes in lists of together at most ``most_words`` words, one index at least."""
    pack, held = [], 0
    for index in indexes(benchmark, s):
        if pack and held + index.n_words > s.most_words:
            yield pack
            pack, held = [], 0
        pack.append(index)
        held += index.n_words
    if pack:
        yield pack


def leaks(docs: DataFrame, benchmark: DataFrame, search: Search = Search()) -> DataFrame:
    """One row for each document and test item it holds: doc_id, item_id, score, question, answer, first_word."""
    sc = docs.sparkSession.sparkContext
    schema = "doc_id long, item_id long, score double, question double, answer double, first_word long"
    names = [x.split()[0] for x in schema.split(", ")]
    out = docs.sparkSession.createDataFrame([], schema)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    for pack in packs(benchmark, search):
        shared = sc.broadcast(pack)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", 1 << 20):
                w = folded_words(batch.column("text"))
                for index in shared.value:
                    found = _hits(w, index)
                    if found:
                        row, item, *rest = zip(*found, strict=True)
                        ids = [batch.column("doc_id").take(pa.array(row)), pa.array(index.ids[list(item)])]
                        yield pa.RecordBatch.from_arrays([*ids, *map(pa.array, rest)], names)

        out = out.union(rows.mapInArrow(lean(run), schema))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, search: Search = Search()) -> DataFrame:
    """``docs`` without the documents that hold a test item; a map over the rows, nothing is shuffled.

    The rows kept are written to the scratch folder, in Arrow batches bounded by bytes.
    """
    for pack in packs(benchmark, search):
        shared = docs.sparkSession.sparkContext.broadcast(pack)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", 1 << 20):
                w = folded_words(batch.column("text"))
                keep = np.ones(batch.num_rows, bool)
                for index in shared.value:
                    keep[[h[0] for h in _hits(w, index)]] = False
                yield batch.filter(pa.array(keep))

        docs = cut(docs.mapInArrow(lean(run), docs.schema), "clean")
    return docs
