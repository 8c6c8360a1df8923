"""Connected components over a table of links, by alternating large and small stars.

Each round is two aggregations and two joins on the nodes of the links that are left; minima are aggregated
before the shuffle, and hot nodes are split by adaptive skew joins, so a component of any size is never
gathered in one task. Rounds grow with the logarithm of the longest path. Every round is written to the
shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> (node, root) for every linked node; root is the smallest node of its component."""
    edges = stash(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))  # every link runs down from a to b
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = stash(small.where("a != b").distinct(), "links")
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = new
        if tuple(mark) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(mark)
