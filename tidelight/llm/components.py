"""Connected components of an edge table by alternating large-star and small-star steps.

Both steps point every node at the least node it knows of; neighbours are never gathered, only
their minimum is, combined on the map side. Each round is written to the shared folder. The
number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    met = both.join(_least(both), "u").where("v > u")
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _least(down)
    met = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return met.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node in ``edges`` (u, v) with u != v; root is the least node reachable."""
    edges = stage(edges.select("u", "v").where("u != v").distinct())
    before = None
    while (now := _mark(edges)) != before:
        before = now
        edges = stage(_small_star(_large_star(edges)))
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return nodes.unionByName(roots)
