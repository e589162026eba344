"""Connected components of links, by alternating stars on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomtide.llm.common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for each node of a link between two different nodes.

    Each round hooks every node's larger neighbours, then its smaller ones, to the smallest neighbour; links become
    stars in few rounds. A round is two minima with partial aggregation and joins back, written in the shared folder.
    Only two numbers a round come to the driver.
    """
    pairs = links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).filter("u < v").distinct()
    pairs = written(pairs)
    before = None
    while True:
        # Large star: (v, smallest of u and its neighbours) for each larger neighbour v of u.
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select("v", F.col("m").alias("u")).filter("u < v").distinct()
        # Small star: v and all smaller neighbours go to the smallest.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(least, "v")
        small = joined.select(F.col("u").alias("v"), F.col("m").alias("u")).union(joined.select("v", F.col("m").alias("u")))
        pairs = written(small.filter("u < v").distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return pairs.select(F.col("v").alias("node"), F.col("u").alias("component")).union(
                pairs.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
            )
        before = now
