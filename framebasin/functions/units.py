"""Tensor layouts and unit conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit factors.
HARTREE_EV = 27.211386245988
HARTREE_BOHR_EV_ANG = 51.4220674763259
# Second published pair, kept for logs written with it.
HARTREE_EV_LEGACY = 27.2113838565563
HARTREE_BOHR_EV_ANG_LEGACY = 51.4220631857
EV_ANG3_GPA = 160.2176634
EV_ANG3_KBAR = 1602.1766208
BAR_GPA = 0.0001

# Positions in a 6-component tensor of the 9 row-major components.
VOIGT_LAYOUTS = {
    "xx,yy,zz,xy,yz,zx": [0, 3, 5, 3, 1, 4, 5, 4, 2],
    "xx,yy,zz,yz,xz,xy": [0, 5, 4, 5, 1, 3, 4, 3, 2],
}
# Fixed value: a reference component of this size or more means "not computed".
SENTINEL = 1e6

_ENERGY = {"ev": 1.0, "hartree": HARTREE_EV, "hartree_legacy": HARTREE_EV_LEGACY}
_FORCE = {
    "ev/ang": 1.0,
    "hartree/bohr": HARTREE_BOHR_EV_ANG,
    "hartree/bohr_legacy": HARTREE_BOHR_EV_ANG_LEGACY,
}
_PRESSURE = {
    "ev/ang3": 1.0,
    "gpa": 1.0 / EV_ANG3_GPA,
    "bar": BAR_GPA / EV_ANG3_GPA,
    "kbar": 1.0 / EV_ANG3_KBAR,
}


def voigt_to_9(arr: Column, order: str = "xx,yy,zz,xy,yz,zx") -> Column:
    """6 components -> 9 row-major components."""
    return F.array(*[F.get(arr, F.lit(k)) for k in VOIGT_LAYOUTS[order]])


def nine_to_voigt(arr: Column, order: str = "xx,yy,zz,xy,yz,zx") -> Column:
    """9 row-major components -> 6 components (upper triangle)."""
    layout = VOIGT_LAYOUTS[order]
    return F.array(*[F.get(arr, F.lit(layout.index(k))) for k in range(6)])


def to_ev(col: Column, unit: str) -> Column:
    """Energy or force to eV or eV/A."""
    factor = {**_ENERGY, **_FORCE}[unit]
    return col * F.lit(factor)


def stress_to_virial(stress: Column, volume: Column, unit: str = "gpa", sign: int = 1) -> Column:
    """Stress components times volume, in eV.

    ``sign=-1`` gives the convention virial = -stress * V.
    """
    factor = sign * _PRESSURE[unit]
    return F.transform(stress, lambda s: s * volume * F.lit(factor))


def virial_to_stress(virial: Column, volume: Column) -> Column:
    """stress = -virial / V in eV/A^3."""
    return F.transform(virial, lambda v: -v / volume)


def per_atom(col: Column, natoms: Column) -> Column:
    """B15."""
    return col / natoms


def total(col: Column, natoms: Column) -> Column:
    """B15."""
    return col * natoms
