"""Connected components by alternating star contraction (union-find over DataFrames)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours join the smallest of its neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours join the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of edges (a, b); component is the smallest node reachable.

    Edges with a null end or equal ends link nothing.  No edges: no rows.  The
    rounds grow with the logarithm of the longest chain; a graph that isn't
    contracted after max_rounds raises RuntimeError.
    """
    edges = durable(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct())
    state = None
    for _ in range(max_rounds):
        edges = durable(_small_star(_large_star(edges)))
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == (now.n, now.s):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        state = (now.n, now.s)
    raise RuntimeError("the components did not settle")
