"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigwin.llm.common import stored


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _both(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``links``; a component is its smallest node.

    Large-star hangs a node's larger neighbours on its smallest neighbour (or itself),
    small-star does so with its smaller ones.  Minima are combined before they shuffle and
    joined back to the links, so a node with very many links is never one task's group.
    Each round is written to the shared folder; it ends when the links stay as they are.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    links = stored(links.select(u, v).where("u <> v").distinct(), "links")
    before = None
    while True:
        sums = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == before:
            break
        before = sums
        every = _both(links)
        least = _least(every).select("u", F.least("u", "m").alias("m"))
        large = (every.where("v > u").join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # Now each u > v; small-star: the neighbours below u, and u, hang on the smallest of them.
        least = _least(large)
        small = large.join(least, "u")
        small = (small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        links = stored(small, "links")
    hung = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return hung.unionByName(roots)
