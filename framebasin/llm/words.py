"""Words of Arrow text columns as numpy arrays of 64-bit hashes.

A word is a run of bytes other than space and the five ASCII controls tab to carriage return. Texts are
worked through in slices of a quarter megabyte cut at white space, so memory follows the number of words,
not the number of bytes, and a very long text needs no more than a short one.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

_SLICE = 1 << 18  # bytes; arrays of eight bytes for each are made on the way, and tables kept
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_CODES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_CODES = _CODES.copy()
_LOWER_CODES[65:91] = _CODES[97:123]

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


class Words(NamedTuple):
    bounds: np.ndarray  # int64, one more than texts: words of text i are bounds[i] to bounds[i + 1]
    hashes: np.ndarray  # uint64
    starts: np.ndarray  # int64 byte offsets into data
    ends: np.ndarray
    data: np.ndarray  # uint8, all texts one after the other
    offsets: np.ndarray  # int64 byte offsets of the texts


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                globals()[name] = np.cumprod(steps)
    return _powers[:n], _inverses[:n]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and where each text starts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array, lower: bool = False) -> Words:
    """All words of a text column; ``lower`` folds A-Z only. Empty and null texts have none."""
    data, offsets = text_bytes(texts)
    codes = _LOWER_CODES if lower else _CODES
    cuts = np.zeros(len(data) + 1, bool)
    cuts[offsets] = True
    parts, at = [], 0
    while at < len(data):
        to = min(at + _SLICE, len(data))
        while to < len(data):  # move to the next place between two words
            stop = np.flatnonzero(_SPACE[data[to : to + 4096]] | cuts[to : to + 4096][: len(data[to : to + 4096])])
            if len(stop):
                to += int(stop[0])
                break
            to = min(to + 4096, len(data))
        piece, edge = data[at:to], cuts[at : to + 1]
        solid = ~_SPACE[piece]
        before = np.empty(len(piece), bool)
        before[0], before[1:] = True, ~solid[:-1]
        after = np.empty(len(piece), bool)
        after[-1], after[:-1] = True, ~solid[1:]
        start = np.flatnonzero(solid & (before | edge[:-1]))
        end = np.flatnonzero(solid & (after | edge[1:])) + 1
        power, inverse = _tables(len(piece) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(codes[piece] * power[:-1], out=sums[1:])
            h = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
        parts.append((start + at, end + at, h))
        at = to
    starts, ends, hashes = (
        (np.concatenate([p[k] for p in parts]) for k in range(3))
        if parts
        else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    )
    bounds = np.searchsorted(starts, offsets, "left").astype(np.int64)
    return Words(bounds, hashes, starts, ends, data, offsets)


def grams(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of every k consecutive entries; the last k - 1 entries start no window."""
    n = max(0, len(hashes) - k + 1)
    acc = np.full(n, seed * 2 + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            acc = acc * _BASE + hashes[j : j + n]
            acc ^= acc >> np.uint64(29)
    return mix(acc)


def starts_in_text(bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where k words of one text start, and the text of each."""
    lengths = np.diff(bounds)
    per = np.maximum(lengths - k + 1, 0)
    text = np.repeat(np.arange(len(lengths)), per)
    first = np.cumsum(per) - per
    return np.arange(len(text)) - first[text] + bounds[:-1][text], text


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)
