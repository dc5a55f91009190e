"""Connected components of a link table, by shuffles only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pooled


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node of ``links (a, b)``.

    Alternates large-star and small-star steps until nothing changes: each
    takes the smallest neighbour of every node by a map-side combined minimum
    and hooks the other neighbours to it, so a hub of any degree is fine. The
    edges are cut to the shared folder after each round; the driver sees a
    count and a checksum only.
    """

    def facts(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = cut(pooled(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()))
    before = facts(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(pooled(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()))
        after = facts(edges)
        if after == before:
            break
        before = after
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
