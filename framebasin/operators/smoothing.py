"""Cubic smoothing spline with a bound on the residual, one fit for each curve.

The spline is the smoothest curve (least integral of the squared second derivative) whose squared residuals sum up to
the bound (Reinsch 1967). With second derivatives g at the inner points it solves (R + w Q'Q) g = Q'y and f = y - w Q g,
two banded matrices of the point distances; the residual grows with w, which is found by halving. A bound above the
residual of the straight line gives the line, a bound of 0 the interpolating spline.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _solve(diagonal: np.ndarray, first: np.ndarray, second: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solution of a symmetric system with two side diagonals."""
    n = len(diagonal)
    d, e, f = diagonal.tolist(), [*first.tolist(), 0.0, 0.0], [*second.tolist(), 0.0, 0.0]
    z = right.tolist()
    for k in range(n):  # L D L' in place: e and f become the factors below the diagonal
        below, further = e[k] / d[k], f[k] / d[k]
        if k + 1 < n:
            d[k + 1] -= below * e[k]
            e[k + 1] -= below * f[k]
            z[k + 1] -= below * z[k]
        if k + 2 < n:
            d[k + 2] -= further * f[k]
            z[k + 2] -= further * z[k]
        z[k] /= d[k]
        e[k], f[k] = below, further
    for k in range(n - 2, -1, -1):
        z[k] -= e[k] * z[k + 1] + (f[k] * z[k + 2] if k + 2 < n else 0.0)
    return np.array(z)


def smoothing_spline(x: np.ndarray, y: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Values and second derivatives at the points of the smoothing spline with the given sum of squared residuals."""
    n = len(x)
    slope, level = np.polyfit(x, y, 1) if n > 1 else (0.0, float(y[0]))
    line = slope * x + level
    if n < 3 or float(((y - line) ** 2).sum()) <= bound:
        return line, np.zeros(n)
    h = np.diff(x)
    a, c = 1 / h[:-1], 1 / h[1:]
    b = -a - c  # column k of Q is a, b, c in rows k, k + 1, k + 2
    r0, r1 = (h[:-1] + h[1:]) / 3, h[1:-1] / 6
    q0, q1, q2 = a * a + b * b + c * c, b[:-1] * a[1:] + c[:-1] * b[1:], c[:-2] * a[2:]
    bend = a * y[:-2] + b * y[1:-1] + c * y[2:]

    def fit(w: float) -> tuple[np.ndarray, np.ndarray, float]:
        g = _solve(r0 + w * q0, r1 + w * q1, w * q2, bend)
        moved = np.zeros(n)
        moved[:-2] += a * g
        moved[1:-1] += b * g
        moved[2:] += c * g
        return y - w * moved, np.concatenate([[0.0], g, [0.0]]), w * w * float(moved @ moved)

    low, high = 0.0, float(h.mean() ** 3)
    while fit(high)[2] < bound:
        low, high = high, high * 8
        if high > 1e30:
            return line, np.zeros(n)
    if bound <= 0:
        return fit(0.0)[:2]
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if fit(mid)[2] < bound else (low, mid)
        if high - low <= 1e-13 * high:
            break
    return fit((low + high) / 2)[:2]


def spline_values(x: np.ndarray, f: np.ndarray, g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The spline at any places; straight on beyond its ends."""
    if len(x) == 1:
        return np.full(len(at), f[0])
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    h, u, v = x[k + 1] - x[k], at - x[k], x[k + 1] - at
    inside = (u * f[k + 1] + v * f[k]) / h - u * v / 6 * ((1 + u / h) * g[k + 1] + (1 + v / h) * g[k])
    h0, h1 = x[1] - x[0], x[-1] - x[-2]
    s0 = (f[1] - f[0]) / h0 - h0 * (2 * g[0] + g[1]) / 6
    s1 = (f[-1] - f[-2]) / h1 + h1 * (2 * g[-1] + g[-2]) / 6
    return np.where(at < x[0], f[0] + s0 * (at - x[0]), np.where(at > x[-1], f[-1] + s1 * (at - x[-1]), inside))


def first_rise(r: np.ndarray, g: np.ndarray, bound: float = 1.0, scale: int = 10) -> float | None:
    """Radius where the smoothed g(r) first rises after its peak, on ``scale`` times as many points from 0 to the end."""
    at = np.linspace(0, r[-1], len(r) * scale)
    y = spline_values(r, *smoothing_spline(r, g, bound), at)
    top = int(y.argmax())
    up = np.flatnonzero(np.diff(y[top:]) > 0)
    return float(at[top + up[0]]) if len(up) else None


def spline_minimum(g: DataFrame, bound: float = 1.0, scale: int = 10) -> DataFrame:
    """``sa, sb, rcut`` of every pair's g(r); pairs that never rise after the peak are left out.

    A curve has a row per bin, r / dr of them, and is fitted in one task; curves run side by side.
    """

    def run(curve: pd.DataFrame) -> pd.DataFrame:
        curve = curve.sort_values("r")
        found = first_rise(curve["r"].to_numpy(), curve["g"].to_numpy(), bound, scale)
        rows = [] if found is None else [(curve["sa"].iloc[0], curve["sb"].iloc[0], found)]
        return pd.DataFrame(rows, columns=["sa", "sb", "rcut"])

    slim = g.select("sa", "sb", F.col("r").cast("double").alias("r"), F.col("g").cast("double").alias("g"))
    return slim.groupBy("sa", "sb").applyInPandas(run, "sa string, sb string, rcut double")
