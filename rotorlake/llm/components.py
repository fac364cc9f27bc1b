"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialise


def are_stars(edges: DataFrame) -> bool:
    """Whether every node of edges(a, b) is the ``a`` of one edge or the ``b`` of any number, and never both."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not nodes.where((F.col("out") > 1) | (F.col("out") > 0) & (F.col("into") > 0)).take(1)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for every node of edges(a, b).

    Alternating large-star and small-star steps: every node's larger neighbours, then its smaller ones, are
    hung onto the smallest node in reach, until all edges lead from a node straight to its component's smallest.
    Each step is one aggregation and one join; rows never outnumber the edges, and each round is written to the
    shared folder.
    """
    if not edges.take(1):
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component"))
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        # edges lead to smaller nodes, so a forest of stars is the result
        if are_stars(now):
            break
        # large star: edges (u, v), v > u, become (v, least of u's neighbourhood)
        both = now.union(now.select("b", "a"))
        least = materialise(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
        large = materialise(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        # small star: a node's smaller neighbours, and itself, go to the smallest of them
        least_b = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least_b, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        new = materialise(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        drop(now.sparkSession, now, least, large, least_b)
        now = new
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return materialise(now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots), "components")
