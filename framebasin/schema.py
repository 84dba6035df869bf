"""Schemas of the frame corpus."""

from __future__ import annotations

from pyspark.sql import types as T

ATOM = T.StructType(
    [
        T.StructField("atom_idx", T.IntegerType()),
        T.StructField("species", T.StringType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("z", T.DoubleType()),
        T.StructField("fx", T.DoubleType()),
        T.StructField("fy", T.DoubleType()),
        T.StructField("fz", T.DoubleType()),
    ]
)

DOUBLES = T.ArrayType(T.DoubleType())

FRAME = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("file_ord", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("frame_idx", T.LongType()),
        T.StructField("natoms", T.IntegerType()),
        T.StructField("lattice", DOUBLES),
        T.StructField("pbc", T.ArrayType(T.BooleanType())),
        T.StructField("properties", T.StringType()),
        T.StructField("info", T.MapType(T.StringType(), T.StringType())),
        T.StructField("info_keys", T.ArrayType(T.StringType())),
        T.StructField("energy", T.DoubleType()),
        T.StructField("virial", DOUBLES),
        T.StructField("stress", DOUBLES),
        T.StructField("uncertainty", T.DoubleType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("config_type", T.StringType()),
        T.StructField("atoms", T.ArrayType(ATOM)),
    ]
)

#: columns that identify and order a frame in a corpus
FRAME_KEY = ("file_ord", "frame_idx")
