"""Connected components of an edge table by alternating large and small stars.

Every step is a grouped minimum (combined before the shuffle) and a join of the
edges with it.  A vertex may have any number of edges: its edges are dealt over
salts in the join.  The number of edges never grows, and rounds are few (the
logarithm of the longest path).  Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MOST_ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with ``m``: the least of u and all its neighbours in the table."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return common.salted_left_join(edges, least, "u")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge to another; component is its least node.

    Null nodes and edges from a node to itself are left out.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = common.durable(edges.distinct())
    before = None
    for _ in range(MOST_ROUNDS):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = _least(large)
        edges = common.durable(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: no fixpoint in {MOST_ROUNDS} rounds")
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
