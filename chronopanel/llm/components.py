"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: bigint, any order, repeats allowed) to (node, root): root is the smallest node reachable.

    Only nodes with an edge to another node appear. Each round rewires every node to the smallest node seen near it;
    the rounds needed grow with the logarithm of a component's size. A round's edges are checkpointed; all that
    reaches the driver is a count and a checksum. An empty table gives an empty result.
    """
    now = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = None
    while (state := mark(now)) != before:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.explode(F.array(F.struct("m", F.col("b").alias("v")), F.struct("m", F.col("a").alias("v")))).alias("e"))
        now, before = cut(small.select(F.col("e.m").alias("a"), F.col("e.v").alias("b")).where("a <> b").distinct()), state
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select("a", "a").distinct())


def mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
