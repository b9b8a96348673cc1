"""Connected components of a graph of links, without ever bringing links to the driver.

Alternates large-star and small-star steps (Kiveris et al., Connected Components in MapReduce and Beyond, 2014): every step replaces links
by links to smaller ids and needs a grouped minimum, which is summed up before it is shuffled, and a join whose hot keys Spark can split.
The links of each step are written to the shared folder; a step's table goes once the next one is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, stash


def components(links: DataFrame, steps: int = 60) -> DataFrame:
    """links (a, b) -> (id, component) with the smallest id reachable, for every id that has a link."""
    spark = links.sparkSession
    edges = stash(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links")
    before = None
    for _ in range(steps):
        both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        # large star: larger neighbours of v link to the least of v and its neighbours
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # small star: v and its smaller neighbours link to the least of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v")
        small = small.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).union(low.select("v", F.col("m").alias("u"))).distinct()
        after = stash(small, "links")
        sums = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        was, now = before or sums(edges), sums(after)
        drop_stash(spark, edges)
        edges, before = after, now
        if was == now:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("v").alias("id"), F.col("u").alias("component")).union(edges.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct())
