"""Slow, plain re-implementations the operators are compared with."""

import math

import numpy as np
from framebasin.schema import ATOM
from pyspark.sql import types as T

FRAME_SCHEMA = T.StructType(
    [
        T.StructField("file_ord", T.IntegerType()),
        T.StructField("frame_idx", T.LongType()),
        T.StructField("natoms", T.IntegerType()),
        T.StructField("lattice", T.ArrayType(T.DoubleType())),
        T.StructField("pbc", T.ArrayType(T.BooleanType())),
        T.StructField("atoms", T.ArrayType(ATOM)),
    ]
)


def frame(file_ord, idx, species, xyz, lattice=None, pbc=(True, True, True)):
    atoms = [(i, s, *map(float, p), None, None, None) for i, (s, p) in enumerate(zip(species, xyz))]
    cell = None if lattice is None else [float(v) for v in np.asarray(lattice).reshape(-1)]
    return (file_ord, idx, len(atoms), cell, list(pbc), atoms)


def frames_df(spark, rows):
    return spark.createDataFrame(rows, FRAME_SCHEMA)


def distance(p, q, lattice, pbc):
    d = np.asarray(q, float) - np.asarray(p, float)
    if lattice is not None and any(pbc):
        m = np.asarray(lattice, float).reshape(3, 3)
        if abs(np.linalg.det(m)) >= 1e-12:
            f = d @ np.linalg.inv(m)
            for k in range(3):
                if pbc[k]:
                    f[k] -= round(f[k])
            d = f @ m
    return math.sqrt(float((d * d).sum()))


def all_pairs(row):
    _, _, n, lattice, pbc, atoms = row
    for i in range(n):
        for j in range(i + 1, n):
            a, b = atoms[i], atoms[j]
            yield i, j, a[1], b[1], distance(a[2:5], b[2:5], lattice, pbc)


def random_frames(seed, count, natoms, lattice=None, pbc=(True, True, True), species="Mo Te Li".split(), scale=10.0):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(count):
        n = natoms if isinstance(natoms, int) else int(rng.integers(*natoms))
        names = [species[int(rng.integers(len(species)))] for _ in range(n)]
        rows.append(frame(0, k, names, rng.uniform(-0.2, 1.2, (n, 3)) * scale, lattice, pbc))
    return rows
