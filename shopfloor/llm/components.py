"""Connected components by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges ``(u, v)``, v < u.

    Large: neighbours above a node move to its least neighbour.  Small: a node and its neighbours below move to
    the least of them.  The least neighbour is an aggregate with partial sums, and the join back is an
    equi-join whose skewed keys Spark splits, so a hub is never gathered in one task.
    """
    ends = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = ends.join(least, "u")
    if large:
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u != v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``; the component is named by its least node.

    Nodes without an edge, null ends and loops are not in the result.  Every round is written to the shared
    folder; the number of rounds grows with the logarithm of the longest path.
    """
    now = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, seen = materialize(now), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        now = materialize(_star(_star(now, True), False))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
