"""Connected components by alternating large-star and small-star rounds; edges never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.snapshot import materialize, remove_table


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (long columns u, v): root is the smallest node it reaches.

    Each half round takes the smallest neighbour of every node (combined map-side) and points the others at
    it. The edges of a round are written under ``spark.checkpoint.dir``, those of the round before removed. It ends when the
    edges are stars. Self-loops and repeats are allowed.
    """
    spark = edges.sparkSession
    now = materialize(spark, edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        # every edge is now (larger, smaller)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        then = materialize(spark, small)
        remove_table(spark, now)
        now = then
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """No node has two smaller neighbours, or a smaller and a larger one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR down = 1 AND up = 1").isEmpty()
