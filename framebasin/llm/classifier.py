"""Quality classifier with learned subword embeddings.

A document is the mean of the vectors of its hashed words, of its hashed byte 3- and 4-grams (white space marks
word edges), and of its word bigrams by shape: a word after itself, in either case, is one shared feature; a softmax layer turns the mean into class probabilities. Vectors and layer are trained together by
stochastic gradient descent in numpy on a bounded sample of labelled rows. Scoring is linear before the softmax, so
every feature's share of the logit is computed once and scoring is one gather per feature over all texts.

Only the text enters a score. The sample is the ``sample`` labelled rows with the smallest hash of their id among
those whose remainder of crc32(id as text) by ``folds`` is not 0; the rest is held out. Rows are whole texts; if
their counted features take more than ``sample_bytes``, the sample ends with the last row that fits.

Defined results: null and empty texts score the model's bias. Without labelled rows every score is 0.5. Rows
whose label is null are not learned from; of repeated labels of an id the larger counts. A null id counts as the
empty text in the hash, so it is held out. Extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .frames import carry, restore, slices
from .words import _SPACE, text_bytes, words


@dataclass(frozen=True)
class Settings:
    word_bits: int = 17
    gram_bits: int = 16
    grams: tuple[int, ...] = (3, 4)
    dim: int = 16
    epochs: int = 8
    rate: float = 0.5
    sample: int = 5000
    sample_bytes: int = 160 << 20
    folds: int = 5
    seed: int = 11

    @property
    def size(self) -> int:
        return (1 << self.word_bits) + len(self.grams) * (1 << self.gram_bits) + 1


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray  # size x dim
    layer: np.ndarray  # 2 x dim
    bias: np.ndarray  # 2

    def shares(self) -> np.ndarray:
        return (self.vectors @ (self.layer[1] - self.layer[0])).astype(np.float32)


def features(texts: pa.Array, s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Groups of (text of each feature, feature id); ids are below ``s.size``."""
    w = words(texts)
    out = [(np.repeat(np.arange(len(texts)), np.diff(w.bounds)), (w.hashes & np.uint64((1 << s.word_bits) - 1)).astype(np.int64))]
    folded, owners = words(texts, lower=True).hashes, out[0][0]
    twice = owners[1:][(folded[1:] == folded[:-1]) & (owners[1:] == owners[:-1])]
    out.append((twice, np.full(len(twice), s.size - 1)))
    data, offsets = text_bytes(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    spaced = np.full(len(data) + len(texts) + 1, 32, np.uint32)  # white space before, between and after texts
    spaced[np.arange(len(data)) + text + 1] = data
    owner = np.zeros(len(spaced), np.int32)
    owner[np.arange(len(data)) + text + 1] = text
    blank = _SPACE[spaced]
    spaced[blank] = 32
    for j, n in enumerate(s.grams):
        m = len(spaced) - n + 1
        if m < 1:
            continue
        inside = np.zeros(m, bool)
        for i in range(1, n - 1):
            inside |= blank[i : i + m]
        at = np.flatnonzero(~inside)
        code = np.zeros(len(at), np.uint64)
        for i in range(n):
            code = (code << np.uint64(8)) | spaced[at + i]
        with np.errstate(over="ignore"):
            code = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - s.gram_bits)
        out.append((owner[at + 1], code.astype(np.int64) + (1 << s.word_bits) + j * (1 << s.gram_bits)))
    return out


def held_out(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == 0


def _sample(docs: DataFrame, labels: DataFrame, s: Settings) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Label, feature ids and their shares of the sampled rows, at most ``s.sample``, features counted in tasks."""
    named = (
        labels.where("doc_id is not null and quality is not null")
        .where(~held_out(F.col("doc_id"), s.folds))
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max("quality").cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(s.sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(named), F.col("doc_id") == F.col("_id")).select("doc_id", "_label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 21):
            found = features(batch.column("text"), s)
            text, ids = (np.concatenate([f[k] for f in found]) for k in range(2))
            order = np.argsort(text, kind="stable")
            ends = np.searchsorted(text[order], np.arange(batch.num_rows + 1))
            keys, shares = [], []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                key, n = np.unique(ids[order[a:b]], return_counts=True)
                keys.append(key.astype(np.int32).tobytes())
                shares.append((n / max(1, b - a)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("_label"), pa.array(keys, pa.binary()), pa.array(shares, pa.binary())],
                ["doc_id", "label", "ids", "shares"],
            )

    found = cut(rows.mapInArrow(run, "doc_id long, label int, ids binary, shares binary"), "sample")
    place = F.xxhash64("doc_id").alias("place")
    sizes = found.groupBy(place, "doc_id").agg(F.sum(2 * F.length("ids")).alias("size")).collect()  # a row for each id
    fits, total = [], 0
    for r in sorted(sizes, key=lambda r: (r.place, r.doc_id)):
        total += r["size"]
        if total > s.sample_bytes and fits:
            break
        fits.append(r)
    if not fits:
        return []
    last = fits[-1]
    got = found.where((place < last.place) | ((place == last.place) & (F.col("doc_id") <= last.doc_id))).collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.ids)))
    return [(r.label, np.frombuffer(r.ids, np.int32), np.frombuffer(r.shares, np.float32)) for r in got]


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], s: Settings) -> Model:
    """Plain stochastic gradient descent with a rate that falls to zero."""
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (s.size, s.dim)).astype(np.float32)
    layer, bias = np.zeros((2, s.dim), np.float32), np.zeros(2, np.float32)
    layer[1] = rng.normal(0, 0.1, s.dim)
    steps, done = s.epochs * len(rows), 0
    for _ in range(s.epochs):
        for k in rng.permutation(len(rows)):
            label, ids, shares = rows[k]
            rate = s.rate * (1 - done / steps)
            done += 1
            mine = vectors[ids]
            mean = shares @ mine
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            pull = layer.T @ p
            layer -= rate * np.outer(p, mean)
            bias -= 0.1 * rate * p
            # shares add up to 1, so a feature moves by its share; the factor makes up for many small shares
            vectors[ids] = mine - (rate * min(len(ids), 64)) * shares[:, None] * pull
    return Model(vectors, layer, bias)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | None:
    rows = _sample(docs, labels, settings)
    return train(rows, settings) if rows else None


def score(docs: DataFrame, model: Model | None, settings: Settings = Settings(), into: str = "quality_score") -> DataFrame:
    """``docs`` without its text, with the probability of label 1 in ``into``; one pass, nothing is shuffled."""
    if model is None:
        return docs.drop("text").withColumn(into, F.lit(0.5))
    base = float(model.bias[1] - model.bias[0])
    shared = docs.sparkSession.sparkContext.broadcast(model.shares())
    whole_rows, docs = docs, carry(docs, ("text",))
    names = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*[docs.schema[c] for c in names], T.StructField(into, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in slices(batches, "text", 1 << 21):
            total, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for text, ids in features(batch.column("text"), settings):
                total += np.bincount(text, table[ids], batch.num_rows)
                count += np.bincount(text, minlength=batch.num_rows)
            p = 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + base, -60, 60)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(p)], [*names, into])

    return restore(docs.mapInArrow(run, schema), whole_rows, ("text",), (into,), drop=("text",))
