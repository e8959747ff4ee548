"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawloom.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(v, comp) for every vertex of the edges (a, b): comp is the smallest vertex it can reach.

    In each round every vertex looks at its smallest neighbour, pointers are followed once more, and the edges between
    the vertices pointed at go into the next round, until none is left. Smallest neighbours combine before the shuffle,
    so a vertex with many edges is no hot key; all rounds are written tables, so a lost executor costs one round."""
    left = edges.select("a", "b").filter("a <> b").distinct()
    labels = None
    while True:
        left = materialize(left, "edges")
        if left.isEmpty():
            break
        both = left.union(left.select(F.col("b"), F.col("a")))
        near = both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("to"))
        near = materialize(near, "near")
        there = near.select(F.col("v").alias("to"), F.col("to").alias("then"))
        jump = materialize(near.join(there, "to").select("v", F.col("then").alias("to")), "jump")
        if labels is None:
            labels = jump.withColumnRenamed("to", "comp")
        else:
            step = jump.select(F.col("v").alias("comp"), F.col("to"))
            labels = labels.join(step, "comp", "left").select("v", F.coalesce("to", "comp").alias("comp"))
        labels = materialize(labels, "labels")
        a, b = jump.select(F.col("v").alias("a"), F.col("to").alias("x")), jump.select(F.col("v").alias("b"), F.col("to").alias("y"))
        moved = left.join(a, "a").join(b, "b").filter("x <> y")
        left = moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    if labels is None:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("comp")).limit(0)
    return labels
