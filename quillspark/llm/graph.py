"""Connected components of a graph of any size, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, split_join, stored


def _least(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each node, and the number of its edges."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of an edge; the component is its smallest node.

    A step groups by a node, which is pre-aggregated, and joins its smallest neighbour back to its
    edges. Nodes with a large share of all edges (few, whatever the graph) are joined by broadcast,
    so their edges are not brought together; nothing is collected.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    now, path = stored(pairs, "edges")
    total, mark = now.count(), None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).withColumn("m", F.least("u", "m"))
        large = split_join(both.where("v > u"), least, "u", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large, p1 = stored(large, "edges")
        least, p2 = stored(_least(large), "edges")
        small = split_join(large, least, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(least.select("u", F.col("m").alias("v"))).distinct()
        after, to = stored(small, "edges")
        got = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(spark, path, p1, p2)
        now, path, total = after, to, got[0]
        if got == mark:
            break
        mark = got
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
