"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest node next to it (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of these. Edges run from the larger node u to v."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    moved = edges.join(least, "u").filter("v != least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.unionByName(least.select("u", F.col("least").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the smallest node that can be reached.

    Minima are combined before the shuffle and joined back, so the links of a node with very many neighbours need not
    meet in one task. Each round's links are written to the shared folder; the rounds end when they form stars, which
    takes about the logarithm of the largest component's size. Null and self links are ignored.
    """
    ordered = links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges, before = durable(ordered.distinct()), None
    while True:
        total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        state = edges.agg(F.count("*"), total).first()
        if state == before:
            break
        before = state
        edges = durable(_small_star(_large_star(edges)))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
