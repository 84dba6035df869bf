"""Cell algebra as Column expressions (rows of the lattice are the vectors)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a cell with a smaller determinant is singular.
SINGULAR = 1e-12


def _m(lat: Column) -> list[Column]:
    return [F.get(lat, F.lit(k)) for k in range(9)]


def cell_det(lat: Column) -> Column:
    """Signed determinant a . (b x c)."""
    a, b, c, d, e, f, g, h, i = _m(lat)
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def cell_volume(lat: Column) -> Column:
    """``|a . (b x c)|``."""
    return F.abs(cell_det(lat))


def cell_inverse(lat: Column) -> Column:
    """Inverse of the 3x3 cell, NULL when singular."""
    a, b, c, d, e, f, g, h, i = _m(lat)
    det = cell_det(lat)
    adj = [
        e * i - f * h, c * h - b * i, b * f - c * e,
        f * g - d * i, a * i - c * g, c * d - a * f,
        d * h - e * g, b * g - a * h, a * e - b * d,
    ]
    return F.when(F.abs(det) >= SINGULAR, F.array(*[v / det for v in adj]))


def row_times(v: Sequence[Column], m: Column) -> list[Column]:
    """Row vector times matrix."""
    return [
        v[0] * F.get(m, F.lit(k)) + v[1] * F.get(m, F.lit(k + 3)) + v[2] * F.get(m, F.lit(k + 6))
        for k in range(3)
    ]


def to_frac(v: Sequence[Column], inv: Column) -> list[Column]:
    """Cartesian -> fractional, given the inverse cell."""
    return row_times(v, inv)


def to_cart(f: Sequence[Column], lat: Column) -> list[Column]:
    """Fractional -> Cartesian."""
    return row_times(f, lat)


def wrap(f: Column) -> Column:
    """Fractional coordinate folded into [0, 1)."""
    return f - F.floor(f)


def norm(v: Sequence[Column]) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def min_image(dr: Sequence[Column], lat: Column, inv: Column, pbc: Column) -> list[Column]:
    """Displacement folded by rounding fractional components (half to even).

    Axes that are not periodic keep their component; without a usable cell, or
    without any periodic axis, the plain displacement is returned.
    """
    frac = to_frac(dr, inv)
    folded = [
        F.when(F.get(pbc, F.lit(k)), frac[k] - F.rint(frac[k])).otherwise(frac[k]) for k in range(3)
    ]
    periodic = inv.isNotNull() & F.exists(pbc, lambda p: p)
    return [F.when(periodic, v).otherwise(d) for v, d in zip(to_cart(folded, lat), dr)]


def min_image_27(dr: Sequence[Column], lat: Column) -> Column:
    """B11, ``images=27``: shortest length over the 27 neighbouring images."""
    m = _m(lat)
    lengths = []
    for i in (-1, 0, 1):
        for j in (-1, 0, 1):
            for k in (-1, 0, 1):
                v = [dr[c] - (m[c] * i + m[3 + c] * j + m[6 + c] * k) for c in range(3)]
                lengths.append(norm(v))
    return F.least(*lengths)


def angle_deg(v1: Sequence[Column], v2: Sequence[Column]) -> Column:
    """Angle in degrees, cosine clipped to [-1, 1]."""
    dot = v1[0] * v2[0] + v1[1] * v2[1] + v1[2] * v2[2]
    cos = dot / (norm(v1) * norm(v2))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))


def axis_heights(lat: Column) -> list[Column]:
    """Distance between opposite faces for each axis: V / |b x c| and so on."""
    m = _m(lat)
    rows = [m[0:3], m[3:6], m[6:9]]
    out = []
    for k in range(3):
        u, v = rows[(k + 1) % 3], rows[(k + 2) % 3]
        cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
        out.append(cell_volume(lat) / norm(cross))
    return out


def cell_lengths(lat: Column) -> list[Column]:
    m = _m(lat)
    return [norm(m[3 * k : 3 * k + 3]) for k in range(3)]
