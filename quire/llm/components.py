"""Connected components by alternating large-star and small-star steps, in DataFrame operations.

Each step replaces a node's edges by edges to the smallest neighbour, so the edges soon form stars
around each component's smallest node.  Minima are pre-aggregated before the shuffle, and every
step is checkpointed, so lost executors cost one step.  At most ``EDGES`` edges are in one partition,
where steps need no shuffle, whose tasks would be many more than the work is worth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import cut

#: Edges in a partition.
EDGES = 100_000


def _together(rows: DataFrame, parts: int) -> DataFrame:
    """In one partition, of which Spark knows that keys meet there, if there is only one."""
    return rows.coalesce(1) if parts == 1 else rows


def _least(rows: DataFrame, parts: int) -> DataFrame:
    """With the smallest v of each u as m; by a join, which splits a node of many edges, unless all are in one partition."""
    if parts == 1:
        return rows.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    return rows.join(rows.groupBy("u").agg(F.min("v").alias("m")), "u")


def _stars(edges: DataFrame, parts: int) -> bool:
    """Whether every node is either a centre or has exactly one edge, to a centre."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("centre"))
    )
    nodes = _together(ends, parts).groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
    return nodes.where("leaf > 1 OR (leaf = 1 AND centre = 1)").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every node of ``links``; the component is its smallest node.

    Links may be repeated, in either direction, or from a node to itself; those with a null are
    left out.
    """
    x, y = F.col(a), F.col(b)
    edges = links.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    edges = cut(edges)
    # Few edges in few partitions: each would cost a shuffle file for every step.
    parts = 1 + edges.count() // EDGES
    edges = cut(edges.coalesce(parts))
    while not _stars(edges, parts):
        both = _together(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), parts)
        large = _least(both, parts).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        if parts == 1:
            ends = F.array(F.when(F.col("v") > F.col("m"), F.col("v")), F.col("u"))
            edges = cut(_least(large, parts).select(F.explode(F.array_compact(ends)).alias("u"), F.col("m").alias("v")).distinct())
        else:
            small = _least(large, parts).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            edges = cut(small.unionByName(large.groupBy("u").agg(F.min("v").alias("v"))).distinct().coalesce(parts))
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)
