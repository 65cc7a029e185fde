"""Connected components of a table of links, as joins and aggregates until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hangstats.llm.common import stage_table


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour, or to itself if that is smaller."""
    near = _both_ways(links)
    least = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return near.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them. ``links``: a < b."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(least, "b").filter("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    own = least.select(F.col("m").alias("a"), "b")
    return moved.unionByName(own).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` for each node of ``links`` (columns a < b, whole numbers): root is the smallest it reaches.

    Large and small stars in turn; after a number of rounds that grows with the
    logarithm of the largest component every node is linked to its root alone.
    Each round is written to the shared folder, so a lost executor repeats one
    round at most. A node without links has no row.
    """
    now = stage_table(links.select("a", "b").filter("a < b").distinct(), "links")
    state = None
    while True:
        now = stage_table(_small_star(_large_star(now)), "stars")
        after = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == state or after[0] == 0:
            break
        state = after
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
