"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.session import cut


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): every node of ``edges`` with the smallest node it reaches.

    Alternating large-star and small-star steps: each round ties the larger
    neighbours of a node to the smallest one, then does the same downwards, and
    a round costs four aggregations over edges. Rounds grow with the logarithm of
    the longest path. Only a count and a checksum per round reach the driver.
    Edges with a null end or equal ends are ignored; an empty table gives an
    empty result.
    """
    star = cut(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    )
    seen = None
    while True:
        both = star.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            star.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = (
            both.join(least, "u")
            .where("v > u AND v != m")
            .select(F.col("v").alias("hi"), F.col("m").alias("lo"))
            .distinct()
        )
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(lowest, "hi")
            .where("lo != m")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(lowest.select("hi", F.col("m").alias("lo")))
        )
        star = cut(small.distinct())
        now = star.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    labels = star.groupBy("hi").agg(F.min("lo").alias("component"))
    roots = star.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return labels.select(F.col("hi").alias("node"), "component").unionByName(roots)
