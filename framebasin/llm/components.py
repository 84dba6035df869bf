"""Connected components of an edge table by hooking and jumping, as DataFrame joins.

Defined results: edges with a null end join nothing and are left out, loops and repeated edges change nothing, labels of
no edge have no row. Edges that all meet in one label cost one round. An empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def merge_labels(edges: DataFrame) -> DataFrame:
    """For edges (u, v) between labels: label, root, where root is the smallest label of the component.

    Each round every label points to its smallest neighbour if that is smaller, pointers are doubled until they
    stop moving, and edges are rewritten to roots; stars and chains shrink by a constant factor at least, so the
    number of rounds follows the logarithm of the longest path. Only edges that still join two roots go on.
    """
    left = cut(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    found = None
    while not left.isEmpty():
        pointers = cut(left.groupBy(F.col("v").alias("label")).agg(F.min("u").alias("root")), "pointers")
        while True:
            up = pointers.select(F.col("label").alias("_l"), F.col("root").alias("_r"))
            jumped = cut(
                pointers.join(up, F.col("root") == F.col("_l"), "left").select(
                    "label", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")
                ),
                "pointers",
            )
            pointers = jumped.select("label", "root")
            if jumped.where("moved").isEmpty():
                break
        if found is None:
            found = pointers
        else:
            new = pointers.select(F.col("label").alias("_l"), F.col("root").alias("_r"))
            kept = found.join(new, F.col("root") == F.col("_l"), "left").select("label", F.coalesce("_r", "root").alias("root"))
            found = cut(kept.union(pointers), "labels")
        left = cut(relabel(relabel(left, pointers, "u"), pointers, "v").where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    return found if found is not None else left.select(F.col("u").alias("label"), F.col("v").alias("root"))


def relabel(df: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    """``df`` with the labels in ``column`` replaced by their roots."""
    up = roots.select(F.col("label").alias("_l"), F.col("root").alias("_r"))
    return df.join(up, F.col(column) == F.col("_l"), "left").withColumn(column, F.coalesce("_r", column)).drop("_l", "_r")
