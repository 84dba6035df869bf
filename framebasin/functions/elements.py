"""Element symbols: normalisation and ordering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Element symbols in order of atomic number, 1 to 118.
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn "
    "Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce "
    "Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn "
    "Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl "
    "Mc Lv Ts Og"
).split()

# Fixed value: rank of a symbol that is not an element; sorts after all elements.
UNKNOWN_RANK = 1000


def norm_symbol(col: Column) -> Column:
    """``mo`` -> ``Mo``; anything but one or two letters is NULL."""
    s = F.initcap(F.lower(F.trim(col)))
    return F.when(s.rlike("^[A-Z][a-z]?$"), s)


def atomic_rank(col: Column) -> Column:
    """Atomic number of a symbol; unknown symbols come last."""
    pos = F.array_position(F.array(*[F.lit(s) for s in SYMBOLS]), col)
    return F.when(pos > 0, pos.cast("int")).otherwise(F.lit(UNKNOWN_RANK))
