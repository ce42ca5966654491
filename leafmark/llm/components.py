"""Connected components by alternating star contraction; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm.shared import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Points the neighbours of each node, the larger ones (large) or the smaller ones and itself, to its lowest neighbour.

    A hub's neighbours are never gathered: each arc meets its node's minimum in a join, which AQE splits where it is skewed.
    """
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    arcs = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else down
    low = arcs.groupBy("u").agg(F.min("v").alias("low"))
    joined = arcs.join(low, "u")
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.least("low", "u").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v")))
    return moved.filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of comparable ids, in any direction, repeats allowed, as node, root (its component's smallest node).

    Nodes without edges don't appear; self-loops make no node.
    """
    now = staged(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        now = staged(_star(staged(_star(now, True), "large-star"), False), "small-star")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
