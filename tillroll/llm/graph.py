"""Connected components of a link table by alternating star contractions (DataFrame joins and groups)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over ``links``; nodes without links don't appear.

    Each round points every node at the smallest node of its neighbourhood, first from its larger
    neighbours and then from its smaller ones; stars grow until no edge changes.  A round is two
    grouped aggregates and two joins over the edges, cut by a checkpoint; only an edge count and a sum
    reach the driver.  A hub with many neighbours is pre-aggregated by the grouped minimum.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                .where("u <> v").distinct())
    state = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")),
                        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    return (edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
            .union(edges.groupBy("v").agg(F.min("v").alias("component")).withColumnRenamed("v", "node"))
            .groupBy("node").agg(F.min("component").alias("component")))
