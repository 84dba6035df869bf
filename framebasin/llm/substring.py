"""Repeated passages as paths of a De Bruijn graph over tokens.

An edge of the graph is a window of ``window`` consecutive words, its nodes are the windows' first and last
``window - 1`` words. Only repeated edges matter, and few windows are:

1. Every window is represented by its anchor, the run of ``anchor`` words inside it with the smallest hash. Equal
   windows have equal anchors, and neighbouring windows mostly share theirs, so about a fifth of the positions
   are shuffled to find the anchors that more than one document holds.
2. Windows on such anchors become edges, with a 95-bit hash of their words. The first document of every edge is an
   aggregate with map-side combine; a join brings it back to the document and word of each later edge.
3. A word is removed if any such edge of its document covers it. The queries do not compact nonbranching paths and do
   not compare words at the source; edges are told apart by their hash alone. ``paths`` joins edges that follow each
   other and lead to the same first document into spans, for readers of ``marks`` only.

Whole texts that repeat are found by digest first and take no part in the second step. Hot edges and anchors (a
line in a third of all documents) are pre-aggregated, and their joins are split by adaptive execution.

Defined results: null and empty texts have no words. Texts shorter than a window keep all words. Rows with equal ids
are judged apart from each other and are no source for one another. Rows without an id are left as they are
and are no source. An empty table gives an empty result. Extra columns stay in ``without_repeats``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import carry, cut_lean as cut, lean, restore, slices
from .words import Words, grams, signed, starts_in_text, words

_BYTES_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_CELLS = 1 << 19  # hashes that numpy copies at once to find anchors


def _anchors(w: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, their texts, the start of each window's anchor, and the hashes of all short runs."""
    at, text = starts_in_text(w.bounds, window)
    runs = grams(w.hashes, anchor, seed=7)
    width = window - anchor + 1
    place = np.zeros(len(at), np.int64)
    if len(at):
        view = np.lib.stride_tricks.sliding_window_view(runs, width)
        step = max(1, _CELLS // width)
        first = np.concatenate([np.argmin(view[s : s + step], axis=1) + np.arange(s, min(s + step, len(view))) for s in range(0, len(view), step)])
        place = first[at]
    return at, text, place, runs


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("th"), "text")


def _copies(rows: DataFrame) -> DataFrame:
    """Rows whose whole text also is the text of a smaller id: doc_id, th."""
    named = rows.where("doc_id is not null and text is not null").select("doc_id", "th", F.md5("text").alias("digest"))
    first = named.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    return named.join(first, "digest").where("doc_id > first").select("doc_id", "th").distinct()


def _candidates(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """Anchors that several documents hold, a row for each document: doc_id, places.

    Anchors are told apart by 48 bits; two that meet by chance only make a few windows more candidates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            w = words(batch.column("text"))
            _, text, place, runs = _anchors(w, window, anchor)
            place, first = np.unique(place, return_index=True)
            text = text[first]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(runs[place] >> np.uint64(16))),
                    batch.column("doc_id").take(pa.array(text)),
                    pa.array((place - w.bounds[text]).astype(np.int32)),
                ],
                ["a", "doc_id", "at"],
            )

    found = rows.where("doc_id is not null").mapInArrow(lean(run), "a long, doc_id long, at int")
    shared = found.groupBy("a").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("a")
    return found.join(shared, "a").groupBy("doc_id").agg(F.collect_list("at").alias("places"))


def _edges(rows: DataFrame, candidates: DataFrame, window: int, anchor: int) -> DataFrame:
    """Windows on candidate anchors with their source coordinates: h, h2, doc_id, at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            batch = batch.filter(batch.column("places").is_valid())
            if not batch.num_rows:
                continue
            w = words(batch.column("text"))
            at, text, place, _ = _anchors(w, window, anchor)
            lists = batch.column("places")
            flat = lists.flatten().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            keep = np.isin((text << 32) | (place - w.bounds[text]), (owner << 32) | flat)
            at, text = at[keep], text[keep]
            h, h2 = grams(w.hashes, window, seed=1)[at], grams(w.hashes, window, seed=2)[at]
            th = batch.column("th").to_numpy()[text].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(h)),
                    pa.array((h2 >> np.uint64(33)).astype(np.int32)),
                    batch.column("doc_id").take(pa.array(text)),
                    pa.array((th << 32) | (at - w.bounds[text])),
                ],
                ["h", "h2", "doc_id", "at"],
            )

    # the same exchange of the texts serves the join that removes words
    met = rows.join(candidates, "doc_id", "left").select("doc_id", "th", "text", "places")
    return met.mapInArrow(lean(run), "h long, h2 int, doc_id long, at long")


def marks(docs: DataFrame, window: int = 13, anchor: int = 5) -> DataFrame:
    """Repeated windows of each row that has any: doc_id, th, starts, sources; both null where all words repeat."""
    rows = _rows(docs)
    copies = cut(_copies(rows), "copies")
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    done = copies.select("doc_id").join(several, "doc_id", "left_anti")
    candidates = cut(_candidates(rows, window, anchor).join(done, "doc_id", "left_anti"), "candidates")
    edges = _edges(rows, candidates, window, anchor)
    first = edges.groupBy("h", "h2").agg(F.min("doc_id").alias("source"))
    spans = (
        edges.join(first, ["h", "h2"])
        .where("doc_id > source")
        .groupBy("doc_id", F.shiftright("at", 32).cast("int").alias("th"))
        .agg(F.collect_list(F.struct(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("start"), "source")).alias("found"))
        .select("doc_id", "th", "found.start", "found.source")
        .withColumnsRenamed({"start": "starts", "source": "sources"})
        .join(copies, ["doc_id", "th"], "left_anti")
    )
    none = F.lit(None)
    return spans.unionByName(copies.select("doc_id", "th", none.cast("array<int>").alias("starts"), none.cast("array<bigint>").alias("sources")))


def paths(found: DataFrame, window: int = 13) -> DataFrame:
    """Compacted spans of ``marks``: doc_id, th, start, n_words, source; one for each nonbranching path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, (starts, sources) in enumerate(zip(batch.column("starts").to_pylist(), batch.column("sources").to_pylist(), strict=True)):
                pairs = sorted(set(zip(starts, sources, strict=True)))
                for j, (s, src) in enumerate(pairs):
                    if j and pairs[j - 1] == (s - 1, src):
                        out[-1][2] += 1
                    else:
                        out.append([k, s, window, src])
            at, start, size, source = (list(c) for c in zip(*out, strict=True)) if out else ([], [], [], [])
            take = lambda c: batch.column(c).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [take("doc_id"), take("th"), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(source, pa.int64())],
                ["doc_id", "th", "start", "n_words", "source"],
            )

    return found.where("starts is not null").mapInArrow(lean(run), "doc_id long, th int, start long, n_words long, source long")


def _removed(n: int, starts: list[int] | None, whole: bool, window: int) -> np.ndarray:
    """Which of ``n`` words a repeated window covers."""
    if whole:
        return np.full(n, n >= window)
    steps = np.zeros(n + 1, np.int64)
    if starts is not None and len(starts):
        starts = np.unique(np.asarray(starts))
        steps[starts] += 1
        steps[starts + window] -= 1
    return np.cumsum(steps[:n]) > 0


def _met(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` (with doc_id and th) with what repeats in each row."""
    marked = F.struct("th", "starts")
    right = found.groupBy(F.col("doc_id").alias("_d")).agg(F.collect_list(marked).alias("_marks"))
    mine = F.get(F.filter("_marks", lambda m: m["th"] == F.col("th")), F.lit(0))
    met = docs.join(right, F.col("doc_id") == F.col("_d"), "left").withColumn("_mark", mine)
    return met.withColumns(
        {"_starts": F.col("_mark.starts"), "_whole": F.col("_mark").isNotNull() & F.col("_mark.starts").isNull()}
    ).drop("_d", "_marks", "_mark")


def summary(docs: DataFrame, window: int = 13, anchor: int = 5) -> DataFrame:
    """For each row doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space."""
    found = marks(docs, window, anchor)
    met = _met(_rows(docs), found).select("doc_id", "text", "_starts", "_whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            total, gone, digests = [], [], []
            for text, starts, whole in zip(*(batch.column(c).to_pylist() for c in ("text", "_starts", "_whole")), strict=True):
                parts = _BYTES_WORD.findall((text or "").encode())
                total.append(len(parts))
                if whole or starts:
                    cover = _removed(len(parts), starts, whole, window)
                    parts = [p for p, c in zip(parts, cover.tolist(), strict=True) if not c]
                gone.append(total[-1] - len(parts))
                digests.append(hashlib.sha256(b" ".join(parts)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return met.mapInArrow(lean(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = 50, anchor: int = 5) -> DataFrame:
    """``docs`` with repeated words cut out of the text; the white space around kept words stays.

    Rows that lose all their words are dropped; a column n_chars follows the text.
    """
    found = marks(docs, window, anchor)
    needed = ("doc_id", "text")
    every = carry(docs, needed)
    names, fields = every.columns, every.schema.fields
    met = _met(every.withColumn("th", F.hash("text")), found)
    schema = T.StructType([*fields, T.StructField("_lost", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts, lost = [], []
            for text, starts, whole in zip(*(batch.column(c).to_pylist() for c in ("text", "_starts", "_whole")), strict=True):
                now = text
                if whole or starts:
                    data = (text or "").encode()
                    ends = [(m.start(), m.end()) for m in _BYTES_WORD.finditer(data)]
                    cover = _removed(len(ends), starts, whole, window).tolist()
                    edge = [a for a, _ in ends] + [len(data)]
                    now = b"".join(data[edge[k] : edge[k + 1]] for k, c in enumerate(cover) if not c).decode()
                texts.append(now)
                lost.append(bool(text and text != now and not (now or "").strip(" \t\n\x0b\x0c\r")))
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lost, pa.bool_())], [*names, "_lost"])

    out = restore(met.select(*names, "_starts", "_whole").mapInArrow(lean(run), schema).where("not _lost"), docs, needed)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
e AS (SELECT r, doc_id, i, array_to_string(w[i + 1 : i + 13], ' ') AS g
      FROM (SELECT *, unnest(range(len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) AS source FROM e GROUP BY g),
x AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM e JOIN f USING (g) WHERE doc_id > source),
p AS (SELECT r, doc_id, unnest(range(len(w))) AS p, unnest(w) AS v FROM d),
k AS (SELECT p.r, array_to_string(list(v ORDER BY p.p), ' ') AS kept, count(*) AS n
      FROM p LEFT JOIN x ON p.r = x.r AND p.p = x.p WHERE x.p IS NULL GROUP BY p.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
