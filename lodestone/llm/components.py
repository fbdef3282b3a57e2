"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is an aggregation with partial sums and a join that adaptive
execution can split at a hot node; the driver sees only a count of edges that
changed.  Each step's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """``edges``: (u, v) with u > v, distinct.  Returns edges of the same form."""
    if large:
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
    joined = both.join(least, F.col("u") == F.col("k"))
    if large:
        new = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = joined.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
    return new.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the smallest node reachable.

    Loops and repeated edges are ignored; an empty table gives an empty result.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        now = stored(_stars(_stars(now, True), False), "edges")
        # Converged when every node has one edge, to its root: no node that is pointed at points further.
        count, nodes, roots, both = now.select(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.col("u") % 1000003), F.sum(F.col("v") % 1000003)).first()
        if mark == (count, nodes, roots, both):
            break
        mark = (count, nodes, roots, both)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
