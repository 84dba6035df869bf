"""Per-element reference energies by least squares."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def species_counts(atoms: DataFrame, species: Sequence[str], frame: Sequence[str]) -> DataFrame:
    """One count column per species and frame."""
    return atoms.groupBy(*frame).agg(
        *[F.count_if(F.col("species") == s).alias(f"n_{s}") for s in species]
    )


def fit_element_energy(
    counts: DataFrame, species: Sequence[str], energy: str = "energy"
) -> tuple[dict[str, float], DataFrame]:
    """Energies per element and the frames with ``shifted`` residual energy.

    One aggregate pass builds the k x k normal equations (k = number of
    elements). If they are singular, every two elements are tied together by an
    extra equation e_i - e_j = 0.
    """
    x = [F.col(f"n_{s}").cast("double") for s in species]
    y = F.col(energy)
    k = len(species)
    sums = [F.sum(x[i] * x[j]) for i in range(k) for j in range(i, k)] + [F.sum(xi * y) for xi in x]
    row = list(counts.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first())
    xtx = np.zeros((k, k))
    it = iter(row)
    for i in range(k):
        for j in range(i, k):
            xtx[i, j] = xtx[j, i] = next(it)
    xty = np.array([next(it) for _ in range(k)])
    if np.linalg.matrix_rank(xtx) < k:
        for i in range(k):
            for j in range(i + 1, k):
                d = np.zeros(k)
                d[i], d[j] = 1, -1
                xtx += np.outer(d, d)
    e = np.linalg.lstsq(xtx, xty, rcond=None)[0]
    fit = sum((xi * F.lit(float(v)) for xi, v in zip(x, e)), F.lit(0.0))
    return dict(zip(species, map(float, e))), counts.withColumn("shifted", y - fit)
