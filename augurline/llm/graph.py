"""Connected components of a graph in DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augurline.llm.cluster import joined, measured, stored


def least_of(edges: DataFrame) -> DataFrame:
    """For each node a of the edges its smallest neighbour m, and their number n."""
    return edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b), root the smallest node it is connected with.

    Alternating large-star and small-star steps; after each pair of them the edges are written to the shared folder, until they no
    longer change.  A step needs each node's smallest neighbour only, which is combined before the shuffle; a hub with a large share of
    all edges gets it by a broadcast of the few such hubs, since its edges would else meet in one task.  Loops and repeated edges are
    allowed, edges with a null end are left out, and without edges the result is empty.
    """
    figures = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20, 0)")).alias("sum")
    now, state = measured(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", *figures)
    while count := state["n"]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = joined(both, least_of(both), "a", 2 * count).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        large = stored(large, "edges")
        low = least_of(large)
        small = joined(large, low, "a", count).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        before = state
        now, state = measured(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges", *figures)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
