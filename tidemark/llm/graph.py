"""Connected components of a table of links, by alternating large and small stars; nothing is gathered in the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame) -> Written:
    """edges (a, b) with a <> b, both longs -> (node, component): the smallest node reachable, for the nodes that aren't it themselves.

    The stars turn the links into ones that lead straight to the smallest node of each component; the number of rounds
    grows with the logarithm of the longest path. Each round is written, so lost executors repeat that round only.
    """
    sums = lambda df: tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
    now = Written(_small(edges.where("a <> b")))
    seen = sums(now.df)
    while True:
        after = Written(_small(_large(now.df)))
        now.drop()
        now, before = after, seen
        if (seen := sums(now.df)) == before:
            break
    now.df = now.df.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return now
