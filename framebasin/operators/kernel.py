"""Distances of whole frames inside a task: a frame is packed once, minima and counts leave it, pairs never do.

Frames of one size are measured together as numpy arrays; a frame with more than ``_DENSE`` atoms that is searched up
to a cutoff goes through a cell list with cells as wide as the cutoff, so its work follows its atoms. No more than
``_MOST`` pairs are held at a time, whatever the frame. Images are the nearest by rounding of fractional differences,
as everywhere in this package; cells without volume or periodic axis have none.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cell

_DENSE = 96  # atoms up to which all pairs of a frame are measured, cutoff or not
_MOST = 1 << 19


class Frames(NamedTuple):
    start: np.ndarray  # atoms of frame f are start[f] to start[f + 1]
    code: np.ndarray  # number of the species of each atom
    names: list[str]
    xyz: np.ndarray
    inv: np.ndarray | None  # inverse cells, cells and periodic axes of all frames; None without cells
    box: np.ndarray | None
    axes: np.ndarray | None


def packed(atoms: DataFrame, frame: Sequence[str], most: int, only: Sequence[str] | None = None) -> DataFrame:
    """One row per frame: key, natoms, rows (species, x, y, z) of frames up to ``most`` atoms, lattice and pbc.

    Larger frames have no rows, ``only`` keeps atoms of some species. ``atoms`` has natoms.
    """
    row = F.struct("species", "x", "y", "z")
    wanted = F.col("natoms") <= most
    if only is not None:
        wanted = wanted & F.col("species").isin(*only)
    cells = [F.any_value(c).alias(c) for c in ("lattice", "pbc") if c in atoms.columns]
    return atoms.groupBy(*frame).agg(F.max("natoms").alias("natoms"), F.collect_list(F.when(wanted, row)).alias("rows"), *cells)


def unpack(batch: pa.RecordBatch, rows: str = "rows") -> Frames:
    """The frames of a batch of packed rows."""
    lists = batch.column(rows)
    flat = lists.flatten()
    start = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    species = flat.field("species").dictionary_encode()
    xyz = np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in "xyz"], axis=1)
    code = species.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    inv = box = axes = None
    if "lattice" in batch.schema.names:
        n = batch.num_rows
        inv, box, axes = np.zeros((n, 3, 3)), np.zeros((n, 3, 3)), np.zeros((n, 3), bool)
        for f, (lattice, pbc) in enumerate(zip(batch.column("lattice").to_pylist(), batch.column("pbc").to_pylist(), strict=True)):
            if lattice is None or len(lattice) < 9 or not pbc or not any(pbc):
                continue
            m = np.array(lattice[:9], float).reshape(3, 3)
            if abs(np.linalg.det(m)) >= cell.SINGULAR:
                inv[f], box[f], axes[f] = np.linalg.inv(m), m, np.array(pbc[:3], bool)
    return Frames(start, code, species.dictionary.to_pylist(), xyz, inv, box, axes)


def _measured(fr: Frames, f: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of atom pairs a, b of frames f."""
    dv = fr.xyz[b] - fr.xyz[a]
    if fr.axes is not None:
        on = fr.axes[f].any(axis=1)
        if on.any():
            which = f if on.all() else f[on]
            frac = np.einsum("pk,pkj->pj", dv[on], fr.inv[which])
            frac -= np.where(fr.axes[which], np.rint(frac), 0.0)
            dv[on] = np.einsum("pk,pkj->pj", frac, fr.box[which])
    return np.sqrt(dv[:, 0] * dv[:, 0] + dv[:, 1] * dv[:, 1] + dv[:, 2] * dv[:, 2])


def _celled(fr: Frames, f: int, cutoff: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Atom pairs of a frame that may be within the cutoff."""
    lo, hi = fr.start[f], fr.start[f + 1]
    p = fr.xyz[lo:hi]
    axes = fr.axes[f] if fr.axes is not None else np.zeros(3, bool)
    wide = np.zeros(3, np.int64)  # cells of a periodic axis
    at = np.empty(p.shape, np.int64)
    frac, height = p, np.ones(3)
    if axes.any():
        frac, height = p @ fr.inv[f], 1 / np.linalg.norm(fr.inv[f], axis=0)
    for k in range(3):
        if axes[k]:
            wide[k] = max(1, int(height[k] / cutoff))
            at[:, k] = np.floor((frac[:, k] - np.floor(frac[:, k])) * wide[k]).clip(0, wide[k] - 1)
        else:
            line = np.floor(frac[:, k] * height[k] / cutoff).astype(np.int64)
            at[:, k] = line - line.min() + 1
    size = np.where(axes, wide, at.max(axis=0) + 2)
    number = (at[:, 0] * size[1] + at[:, 1]) * size[2] + at[:, 2]
    order = np.argsort(number, kind="stable")
    held = number[order]
    steps = [range(min(3, w)) if on else range(3) for on, w in zip(axes, wide, strict=True)]
    for step in itertools.product(*steps):
        to = at + np.array(step) - np.array([len(s) // 2 for s in steps])
        to = np.where(axes, to % np.maximum(size, 1), to)
        target = (to[:, 0] * size[1] + to[:, 1]) * size[2] + to[:, 2]
        first, last = np.searchsorted(held, target, "left"), np.searchsorted(held, target, "right")
        count = last - first
        ends = np.cumsum(count)
        i0 = 0
        while i0 < len(p):
            done = ends[i0 - 1] if i0 else 0
            i1 = max(i0 + 1, int(np.searchsorted(ends, done + _MOST, "right")))
            c = count[i0:i1]
            a = np.repeat(np.arange(i0, i1), c)
            b = order[np.arange(len(a)) - np.repeat(np.cumsum(c) - c, c) + first[a]]
            keep = a < b
            yield a[keep] + lo, b[keep] + lo
            i0 = i1


def pairs(fr: Frames, cutoff: float | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs of atoms of a frame (no further apart than the cutoff): frame, atom, atom, distance, piece by piece."""
    sizes = np.diff(fr.start)
    for n in np.unique(sizes):
        same = np.flatnonzero(sizes == n)
        if n < 2:
            continue
        if cutoff is not None and n > _DENSE:
            for f in same:
                for a, b in _celled(fr, f, cutoff):
                    yield _kept(fr, np.full(len(a), f), a, b, cutoff)
            continue
        rows = max(1, int(_MOST // n))  # first atoms at a time
        for r in range(0, n - 1, rows):
            i = np.arange(r, min(r + rows, n - 1))
            a0 = np.repeat(i, n - 1 - i)
            b0 = np.concatenate([np.arange(k + 1, n) for k in i])
            step = max(1, _MOST // len(a0))
            for s in range(0, len(same), step):
                some = same[s : s + step]
                base = fr.start[some][:, None]
                f = np.repeat(some, len(a0))
                yield _kept(fr, f, (base + a0).ravel(), (base + b0).ravel(), cutoff)


def _kept(fr, f, a, b, cutoff):
    d = _measured(fr, f, a, b)
    if cutoff is None:
        return f, a, b, d
    near = d <= cutoff
    return f[near], a[near], b[near], d[near]


def _species(fr: Frames, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y = fr.code[a], fr.code[b]
    return np.minimum(x, y) * len(fr.names) + np.maximum(x, y)


HISTOGRAM = "si string, sj string, bin long, n long, on_edge long, dmax double"


def histogram(frames: DataFrame, dr: float, cutoff: float | None) -> DataFrame:
    """Counts of pair distances of packed frames by species and bin of width ``dr``, a few rows for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fr = unpack(batch)
            found: dict[tuple[int, int], list] = {}
            for _, a, b, d in pairs(fr, cutoff):
                low = np.floor(d / dr).astype(np.int64)
                low = low - (d < low * dr) + (d >= (low + 1) * dr)
                span = int(low.max(initial=0)) + 1
                keys, where = np.unique(_species(fr, a, b) * span + low, return_inverse=True)
                n = np.bincount(where, minlength=len(keys))
                edge = np.bincount(where, weights=(d == low * dr), minlength=len(keys)).astype(np.int64)
                top = np.full(len(keys), -np.inf)
                np.maximum.at(top, where, d)
                for key, *values in zip(keys.tolist(), n.tolist(), edge.tolist(), top.tolist(), strict=True):
                    old = found.setdefault((key // span, key % span), [0, 0, -np.inf])
                    old[0], old[1], old[2] = old[0] + values[0], old[1] + values[1], max(old[2], values[2])
            k = len(fr.names)
            rows = [(fr.names[c // k], fr.names[c % k], low, *v) for (c, low), v in found.items()]
            yield _table(rows, ["si", "sj", "bin", "n", "on_edge", "dmax"], [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()])

    return frames.mapInArrow(run, HISTOGRAM)


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def shortest(frames: DataFrame, frame: Sequence[str]) -> DataFrame:
    """Shortest distance by species pair (si, sj, d) with the first frame attaining it, a few rows for each batch."""
    names = list(frame)
    key = [frames.schema[c] for c in names]
    schema = T.StructType([T.StructField("si", T.StringType()), T.StructField("sj", T.StringType()), T.StructField("d", T.DoubleType()), *key])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fr = unpack(batch)
            keys = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
            place = np.empty(len(keys), np.int64)
            place[sorted(range(len(keys)), key=keys.__getitem__)] = np.arange(len(keys))
            k = len(fr.names)
            best, first = np.full(k * k, np.inf), np.full(k * k, len(keys), np.int64)
            for f, a, b, d in pairs(fr):
                code = _species(fr, a, b)
                old = best.copy()
                np.minimum.at(best, code, d)
                first[best < old] = len(keys)
                at = d == best[code]
                np.minimum.at(first, code[at], place[f[at]])
            back = np.argsort(place)
            seen = np.flatnonzero(np.isfinite(best))
            which = pa.array(back[first[seen]])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([fr.names[c // k] for c in seen], pa.string()), pa.array([fr.names[c % k] for c in seen], pa.string()),
                    pa.array(best[seen], pa.float64()), *[batch.column(c).take(which) for c in names],
                ],
                ["si", "sj", "d", *names],
            )

    return frames.mapInArrow(run, schema)


def closest(fr: Frames, cutoff: float | None = None) -> np.ndarray:
    """Shortest distance of every frame, infinite where no pair is (within the cutoff)."""
    out = np.full(len(fr.start) - 1, np.inf)
    for f, _, _, d in pairs(fr, cutoff):
        np.minimum.at(out, f, d)
    return out


def with_closest(frames: DataFrame, cutoff: float, into: str = "d") -> DataFrame:
    """``frames`` with the shortest distance up to ``cutoff`` of each, NULL where there is none."""
    schema = T.StructType([*frames.schema.fields, T.StructField(into, T.DoubleType())])
    kept = frames.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = closest(unpack(batch, "atoms"), cutoff)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(np.isinf(d), np.nan, d), pa.float64(), from_pandas=True)], [*kept, into])

    return frames.mapInArrow(run, schema)
