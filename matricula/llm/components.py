"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matricula.llm.base import through_table


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: no node has two lesser neighbours, or one and a larger one."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.lit(0).alias("lesser")), F.struct(F.col("b").alias("node"), F.lit(1).alias("lesser")))).alias("e"))
    lesser = ends.groupBy("e.node").agg(F.sum("e.lesser").alias("n"), F.min("e.lesser").alias("least"))
    return lesser.filter("n > 1 or (n = 1 and least = 0)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's least neighbour (or the node)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").filter("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of long nodes, a <> b -> (node, root), root the least node of the component.

    Nodes without an edge are not in the result. `edges` is read more than once: pass a table. The number of
    rounds is logarithmic in the size of a component; every round is written to the shared folder, and only
    whether it ended in stars reaches the driver. A hub's many edges are joined, never gathered, so Spark can split them.
    """
    edges = through_table(_small_star(_large_star(edges)), "stars")
    while not _settled(edges):
        edges = through_table(_small_star(_large_star(edges)), "stars")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        edges.select("a", "a").distinct())
