"""Connected components of undirected links by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import written

MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node that links reach) of every node of links (node, other), of any orderable type.

    Each round links the larger neighbours of a node, then the smaller ones, to its smallest neighbour, until all
    components are stars: the logarithm of a component's size in rounds, whatever its shape. Minima are combined before
    they are shuffled, and no node's neighbours are ever collected.
    """

    def linked_to_least(edges: DataFrame, larger: bool) -> DataFrame:
        """Edges (u, v) point from a node to its neighbour; links neighbours on one side of u to the least one."""
        least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
        moved = edges.join(least, "u").filter("v > u" if larger else "v < u").select(F.col("v").alias("a"), F.col("least").alias("b"))
        kept = moved if larger else moved.unionByName(least.select(F.col("u").alias("a"), F.col("least").alias("b")))
        return kept.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()

    def are_stars(edges: DataFrame) -> bool:
        """Whether every node has one smaller neighbour, which has none, or has no smaller one."""
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up = 1 AND down = 1").isEmpty()

    edges = written(links.filter("node <> other").select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        if are_stars(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = written(linked_to_least(linked_to_least(both, True), False), "edges")
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
