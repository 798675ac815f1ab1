"""Connected components of a link table, by alternating large and small stars. DataFrame functions only.

Each round attaches every larger neighbour of a node to the smallest one (large star), then every smaller neighbour (small
star); rounds go on until the links are stars, each node linked to the smallest of its component, which a round would
leave as they are. Each round is written to the shared folder. Nothing is collected but one flag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _unsettled(links: DataFrame) -> bool:
    """Whether the links (a, b) are anything but stars: some a has two links, or is the b of another."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("over")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("over")))
    ends = ends.groupBy("node").agg(F.sum("over").alias("n"), F.min("over").alias("least"))
    return bool(ends.agg(F.max(F.expr("n > 1 or n = 1 and least = 0"))).first()[0])


def _star(links: DataFrame, small: bool) -> DataFrame:
    """links (a, b) with a > b; the same components, nearer to stars."""
    both = links if small else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if small:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
    else:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a > b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (two columns, any order, self-links allowed); component: the least node."""
    x, y = links.columns
    links = links.where(F.col(x) != F.col(y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    links = common.materialize(links, "links")
    while _unsettled(links):
        old, links = links, common.materialize(_star(_star(links, False), True), "links")
        common.discard(old)
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
