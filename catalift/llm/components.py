"""Connected components by alternating stars, wholly in joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest node around it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.hash("v", "u").cast("long"))).first()
    )


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node that has a link; component is its smallest node.

    ``links`` may hold repeats, both directions and self links; null ends are ignored. Each
    round ends in a table in the shared scratch folder; rounds grow with the logarithm of
    the longest path. Hubs are cut by skewed joins, as no sort or group follows them directly.
    """
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    edges = store(pairs.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    before = _mark(edges)
    while before[0]:
        edges = store(_small(_large(edges)))
        after = _mark(edges)
        if after == before:
            break
        before = after
    child = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    root = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return child.union(root)
