"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").bitwiseAND(0xFFFFFFFF))).first())


def components(links: DataFrame) -> DataFrame:
    """Rows (node, label) for all nodes of `links` (a, b): the smallest node of each one's component.

    Every round halves distances to the smallest node; all links of a component end in it.
    Rounds are written to the shared folder, where only the last stays; no neighbourhood is collected.
    """
    tables = Tables()
    edges = tables.stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "links")
    before, now = None, _state(edges)
    while now[0] and now != before:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Minima are written, so that the join is one of two plain shuffles, whose hot nodes Spark can split.
        least = tables.stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "minima")
        large = tables.stored(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        tables.drop(edges, least)
        least = tables.stored(large.groupBy("a").agg(F.min("b").alias("m")), "minima")
        inner = large.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = tables.stored(inner.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        tables.drop(large, least)
        before, now = now, _state(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
