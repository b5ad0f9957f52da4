"""Connected components of a link table, by alternating large and small stars.

Every round points neighbours at the least id seen from a node, so a component shrinks to a star
around its least id in a number of rounds that grows with the logarithm of its size. A round is two
aggregates with map-side minima and two equi-joins; its links are written, so lineage stays short
and a lost executor costs one round at most. Nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Rounds


def _checksum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in `links` (a, b); component is the least id reachable."""
    spark = links.sparkSession
    rounds, larger = Rounds(spark, "links"), Rounds(spark, "large-stars", keep=1)
    links = rounds.put(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    while (now := _checksum(links)) != last:
        last = now
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # Large star: neighbours above a node point at the least of its neighbourhood.
        large = links.select(F.col("b").alias("n"), F.col("a").alias("v")).join(least.withColumnRenamed("a", "n"), "n").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = larger.put(large)
        # Small star: neighbours below a node, and the node, point at the least of them.
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        links = rounds.put(small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct())
    larger.clear()
    rounds.clear(but_last=True)
    stars = links.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())
