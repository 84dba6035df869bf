"""Quality rules on text statistics and on how well a public tokeniser fits the text.

Fertility: every distinct word of an Arrow batch is encoded once with a public vocabulary that falls back to
bytes; characters per token, the share of byte-fallback tokens and the entropy of the token distribution are
then sums over the words of each document. Bands per language, or per script where the language has none,
decide.

With labels, ``fit`` derives the band of each language from all its clean labelled rows that pass the base rule: the
floor of characters per token is their ``low`` quantile, and entropy, which grows with the length of a text, has a
floor for each octave of tokens, the ``low`` quantile of the clean rows of that octave. An octave of fewer than
``least`` rows takes the floor of the next shorter one (no octave has as many: one floor for all lengths). Below the shortest the floor falls by one bit an octave, as the
halves of a text have on average at most one bit less than the whole. So a language rejects about two in a hundred
clean rows. Upper limits and languages with fewer than ``least`` clean rows keep the wide ``BANDS``, whose entropy
floor holds from ``min_tokens`` tokens on and falls alike below. No text is too short to judge.

Defined results: null and empty texts have no words, all counts are 0 and they fail the base rule. Null or
unknown languages use the band of their main script, scripts without one use ``other``. Repeated rows are
judged one by one, and count one by one where bands are derived. Of several labels of a document the lowest counts,
null labels do not. Extra columns stay, also those named like a statistic (statistics are a struct of
their own).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import carry, cut_lean, lean, restore, slices
from .words import Words, starts_in_text, words

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """Accepted range: characters per token, largest byte-fallback share, least token entropy in bits.

    ``steps`` are derived entropy floors: from so many tokens on, so many bits; they replace ``min_entropy``.
    """

    min_chars: float
    max_chars: float
    max_bytes: float
    min_entropy: float
    steps: tuple[tuple[int, float], ...] = ()


#: The vocabulary was learned mostly on English, so the floor of characters per token differs by language.
BANDS = {
    "en": Band(1.85, 8.0, 0.08, 5.0),
    "de": Band(1.85, 8.0, 0.08, 5.0),
    "es": Band(1.65, 8.0, 0.08, 5.0),
    "fr": Band(1.55, 8.0, 0.08, 5.0),
    "latin": Band(1.40, 9.0, 0.10, 4.5),
    "cyrillic": Band(1.40, 8.0, 0.15, 4.5),
    "cjk": Band(0.40, 4.0, 0.80, 4.5),
    "other": Band(0.25, 9.0, 1.00, 4.0),
}
#: First code point after each script's range: below 0x250 Latin, and so on.
SCRIPT_EDGES = np.array([0x250, 0x400, 0x530, 0x2E80, 0xA000, 0xAC00, 0xD7B0])
SCRIPT_NAMES = np.array(["latin", "other", "cyrillic", "other", "cjk", "other", "cjk", "other"])


@dataclass(frozen=True)
class Rules:
    vocabulary: str = VOCABULARY
    min_words: int = 50
    max_repeat_pct: int = 50  # share of words in repeated three-word windows, per cent
    min_tokens: int = 150  # from here on the entropy floor of a band without steps holds
    low: float = 0.01  # quantile of the clean labelled rows that is a derived floor
    least: int = 50  # clean labelled rows behind a derived floor
    bands: dict[str, Band] = field(default_factory=lambda: dict(BANDS))
    cached_words: int = 50_000  # distinct words a task keeps encoded


STATS = T.StructType(
    [T.StructField(n, T.LongType()) for n in "n_words word_chars n_symbols n_dup_lines n_repeat_words n_tokens".split()]
    + [T.StructField(n, T.DoubleType()) for n in "chars_per_token byte_share token_entropy".split()]
    + [T.StructField("script", T.StringType())]
)


class Fertility:
    """Encodes words one by one, as the vocabulary's own pre-splitting at spaces does.

    Tokens of many words lie in one flat array. At most ``most`` words stay from one call to the next: those with most
    occurrences in the last.
    """

    def __init__(self, vocabulary: str, most: int):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        self.size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])
        self.most = most
        self.known = np.zeros(0, np.uint64)  # hashes, ascending
        self.tokens, self.begin, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, w: Words, hashes: np.ndarray, first: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of distinct words, by ascending hash, with a place and their occurrences: tokens, begin and size in them."""
        at = np.searchsorted(self.known, hashes)
        hit = np.zeros(len(hashes), bool)
        inside = at < len(self.known)
        hit[inside] = self.known[at[inside]] == hashes[inside]
        new = np.flatnonzero(~hit)
        parts, counts = [self.tokens], [np.zeros(0, np.int64)]
        for k in range(0, len(new), 4096):  # the encoder's lists are many times larger than the arrays kept
            some = first[new[k : k + 4096]]
            ids = self.model.encode(_word_texts(w, some), num_threads=1)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            counts.append(sizes)
            parts.append(np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())))
        begin, sizes = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        begin[hit], sizes[hit] = self.begin[at[hit]], self.sizes[at[hit]]
        sizes[new] = np.concatenate(counts)
        begin[new] = len(self.tokens) + np.cumsum(sizes[new]) - sizes[new]
        tokens = np.concatenate(parts)
        stay = np.arange(len(hashes))
        if len(stay) > self.most:
            stay = np.sort(np.argsort(-times, kind="stable")[: self.most])
        self.known, self.sizes = hashes[stay], sizes[stay]
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.tokens = tokens[_spans(begin[stay], self.sizes)]
        return tokens, begin, sizes


def _spans(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all spans, one span after the other."""
    return np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _word_texts(w: Words, which: np.ndarray) -> list[str]:
    """The words in given places; no word holds a space, so one text holds them all."""
    sizes = w.ends[which] - w.starts[which]
    room = np.full(int(sizes.sum()) + len(which), 32, np.uint8)
    room[_spans(np.cumsum(sizes + 1) - sizes - 1, sizes)] = w.data[_spans(w.starts[which], sizes)]
    return room.tobytes().decode().split(" ")[:-1]


def _repeat_words(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per text, the words inside three-word windows that the text holds twice or more."""
    _, ids = np.unique(hashes, return_inverse=True)
    at, text = starts_in_text(bounds, 3)
    covered = np.zeros(len(hashes) + 1, bool)
    if len(at):
        _, pair = np.unique(ids[at] * (len(hashes) + 1) + ids[at + 1], return_inverse=True)
        _, triple = np.unique(pair * (len(hashes) + 1) + ids[at + 2], return_inverse=True)
        order = np.lexsort((triple, text))
        same = (triple[order][1:] == triple[order][:-1]) & (text[order][1:] == text[order][:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for j in range(3):
            covered[at[twice] + j] = True
    sums = np.concatenate([[0], np.cumsum(covered[:-1])])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _scripts(texts: pa.Array) -> np.ndarray:
    """The script with most letters of each text; Latin where it has none outside ASCII."""
    out = []
    for t in texts.to_pylist():
        if not t or t.isascii():
            out.append("latin")
            continue
        points = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        kinds = np.bincount(np.searchsorted(SCRIPT_EDGES, points[points > 64], "right"), minlength=len(SCRIPT_NAMES))
        names, totals = np.unique(SCRIPT_NAMES, return_inverse=True)
        out.append(names[np.argmax(np.bincount(totals, kinds))])
    return np.array(out, object)


def _dup_lines(text: str | None) -> int:
    if not text or "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def _measure(texts: pa.Array, fertility: Fertility) -> pa.StructArray:
    w = words(texts)
    counts = np.diff(w.bounds)
    edges, n = w.bounds, len(texts)
    per = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[edges])
    started = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])  # code points before a byte
    chars = started[w.ends] - started[w.starts]
    symbols = np.isin(w.data, np.frombuffer(SYMBOLS.encode(), np.uint8))
    symbols = np.diff(np.concatenate([[0], np.cumsum(symbols)])[w.offsets])

    distinct, first, which, times = np.unique(w.hashes, return_index=True, return_inverse=True, return_counts=True)
    flat, begin, sizes = fertility.encode(w, distinct, first, times)
    so_far = np.concatenate([[0], np.cumsum(fertility.is_byte[flat])])
    n_bytes = so_far[begin + sizes] - so_far[begin]
    tokens, bytes_, word_chars = per(sizes[which]), per(n_bytes[which]), per(chars)
    entropy = np.zeros(n)
    for k in range(n):
        mine, times = np.unique(which[edges[k] : edges[k + 1]], return_counts=True)
        total = int(tokens[k])
        if not total:
            continue
        got = np.bincount(flat[_spans(begin[mine], sizes[mine])], np.repeat(times, sizes[mine]), fertility.size)
        share = got[got > 0] / total
        entropy[k] = -(share * np.log2(share)).sum()
    safe = np.maximum(tokens, 1)
    columns = {
        "n_words": counts,
        "word_chars": word_chars,
        "n_symbols": symbols,
        "n_dup_lines": np.array([_dup_lines(t) for t in texts.to_pylist()], np.int64),
        "n_repeat_words": _repeat_words(w.hashes, w.bounds),
        "n_tokens": tokens,
        "chars_per_token": word_chars / safe,
        "byte_share": bytes_ / safe,
        "token_entropy": entropy,
    }
    arrays = [pa.array(v, pa.float64() if v.dtype.kind == "f" else pa.int64()) for v in columns.values()]
    return pa.StructArray.from_arrays([*arrays, pa.array(_scripts(texts), pa.string())], [*columns, "script"])


def with_statistics(docs: DataFrame, rules: Rules, into: str, text: str = "text") -> DataFrame:
    """``docs`` with a struct column of all statistics; one map over the rows, nothing is shuffled."""
    schema = T.StructType([*docs.schema.fields, T.StructField(into, STATS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = Fertility(rules.vocabulary, rules.cached_words)
        for batch in slices(batches, text):
            stats = _measure(pc.cast(batch.column(text), pa.large_string()), fertility)
            yield pa.RecordBatch.from_arrays([*batch.columns, stats], [*batch.schema.names, into])

    return docs.mapInArrow(lean(run), schema)


def fit(measured: DataFrame, labels: DataFrame, rules: Rules, stats: str, lang: str | None = "lang") -> Rules:
    """``rules`` with the bands of all languages that have enough clean labelled rows.

    ``measured`` has doc_id, the language and statistics with ``base_failed``; ``labels`` has doc_id and quality. One
    row for each language and octave comes to the driver. Quantiles are exact over values cut to three decimals, so
    no group holds more than the few thousand values there are.
    """
    s = F.col(stats)
    clean = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_quality")).where("_quality = 1")
    short = lambda c: F.floor(c * 1000) / 1000
    rows = measured.where(~s.base_failed & (s.n_tokens > 0)).select(
        "doc_id",
        (F.coalesce(F.lower(F.col(lang)), s.script) if lang else s.script).alias("_key"),
        F.floor(F.log2(s.n_tokens)).cast("int").alias("_octave"),
        short(s.chars_per_token).alias("_chars"),
        short(s.token_entropy).alias("_bits"),
    )
    met = rows.join(clean, F.col("doc_id") == F.col("_id")).rollup("_key", "_octave")
    found = met.agg(F.count(F.lit(1)).alias("n"), *[F.percentile(c, F.lit(rules.low)).alias(c) for c in ("_chars", "_bits")])
    levels: dict[str, tuple[float, float]] = {}
    steps: dict[str, list[tuple[int, float]]] = {}
    for r in found.where((F.col("n") >= rules.least) & F.col("_key").isNotNull()).orderBy("_key", "_octave").collect():
        if r._octave is None:
            levels[r._key] = (r._chars, r._bits)
        else:
            steps.setdefault(r._key, []).append((1 << r._octave, r._bits))
    bands = dict(rules.bands)
    for key, (chars, bits) in levels.items():
        wide = bands.get(key, bands["other"])
        bands[key] = replace(wide, min_chars=chars, steps=tuple(steps.get(key, ())) or ((1, bits),))
    return replace(rules, bands=bands)


def _entropy_floor(n_tokens: F.Column, band: Band, rules: Rules) -> F.Column:
    (start, bits), *more = band.steps or ((rules.min_tokens, band.min_entropy),)
    out = F.lit(float(bits)) - F.greatest(F.lit(0.0), F.log2(F.lit(float(start))) - F.log2(F.greatest(n_tokens, F.lit(1))))
    for least, bits in more:
        out = F.when(n_tokens >= least, F.lit(float(bits))).otherwise(out)
    return out


def fertility_ok(stats: str, rules: Rules, lang: str | None = "lang") -> F.Column:
    """Whether fertility lies inside the band of the row's language, else of its script."""
    s = F.col(stats)
    named = lambda f: F.create_map(*chain.from_iterable((F.lit(k), F.lit(float(f(b)))) for k, b in rules.bands.items()))
    key = F.coalesce(
        F.when(F.lower(F.col(lang)).isin(*rules.bands), F.lower(F.col(lang))) if lang else F.lit(None),
        F.when(s.script.isin(*rules.bands), s.script),
        F.lit("other"),
    )
    floor = F.lit(None).cast("double")
    for k, b in rules.bands.items():
        floor = F.when(key == k, _entropy_floor(s.n_tokens, b, rules)).otherwise(floor)
    return (
        s.chars_per_token.between(named(lambda b: b.min_chars)[key], named(lambda b: b.max_chars)[key])
        & (s.byte_share <= named(lambda b: b.max_bytes)[key])
        & (s.token_entropy >= floor)
    )


def judge(
    docs: DataFrame, rules: Rules | None = None, into: str = "quality_stats", labels: DataFrame | None = None, keep_text: bool = True
) -> DataFrame:
    """``docs`` with a struct of statistics, ``base_failed`` and ``kept`` inside it.

    A document fails the base rule with fewer than ``min_words`` words or with too large a share of words in
    repeated windows; it is kept if it passes that and its fertility lies inside its band. With ``labels`` (doc_id,
    quality) the bands are derived; measured rows are written once then, without the text unless it is kept.
    """
    rules = rules or Rules()
    lang = "lang" if "lang" in docs.columns else None
    needed = tuple(c for c in ("doc_id", "text", "lang") if c == "text" or (c in docs.columns and (c != "doc_id" or labels is not None)))
    s = F.col(into)
    failed = (s.n_words < rules.min_words) | (100 * s.n_repeat_words > rules.max_repeat_pct * s.n_words)
    measured = with_statistics(carry(docs, needed), rules, into).withColumn(into, s.withField("base_failed", failed))
    gone = () if keep_text else ("text",)
    measured = measured.drop(*gone)
    if labels is not None:
        measured = cut_lean(measured, "statistics")
        rules = fit(measured, labels, rules, into, lang)
    kept = ~s.base_failed & fertility_ok(into, rules, lang)
    return restore(measured.withColumn(into, s.withField("kept", kept)), docs, needed, (into,), drop=gone)


def keep_good(docs: DataFrame, rules: Rules | None = None, labels: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    name = "quality_stats"
    while name in docs.columns:
        name += "_"
    return judge(docs, rules, name, labels).where(F.col(name).kept).drop(name)
