"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import dropped, written


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every node of (a, b); the component is its least node.

    Each step is a grouped minimum and a merge join on the node (the files of edges are small beside their rows), so a
    node with very many neighbours is pre-aggregated and its join is split by skew handling; nothing gathers a
    neighbourhood. Rounds end when all edges form stars.
    """
    e = written(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct(), "edges")
    for _ in range(max_rounds):
        if _stars_only(e):
            break
        # large star: neighbours above a node go to the least of its neighbourhood
        both = e.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(e.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least.hint("merge"), "x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("u <> v")
        # small star: a node and its neighbours below go to the least of these
        least = large.groupBy(F.col("v").alias("x")).agg(F.min("u").alias("m"))
        down = large.select(F.col("v").alias("x"), F.col("u").alias("y")).join(least.hint("merge"), "x")
        small = down.select(F.col("y").alias("v"), F.col("m").alias("u")).unionByName(least.select(F.col("x").alias("v"), F.col("m").alias("u"))).where("u <> v").distinct()
        before, e = e, written(small, "edges")
        dropped(before)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct()
    return e.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(roots)


def _stars_only(e: DataFrame) -> bool:
    """Whether each node of the distinct edges (v, u), u < v, is either a root or below one root."""
    ends = e.select(F.col("v").alias("x"), F.lit(1).alias("below")).unionByName(e.select(F.col("u").alias("x"), F.lit(0).alias("below")))
    each = ends.groupBy("x").agg(F.sum("below").alias("n"), F.min("below").alias("least"))
    return each.where("n > 1 or n = 1 and least = 0").agg(F.count("*").alias("n")).first()["n"] == 0
