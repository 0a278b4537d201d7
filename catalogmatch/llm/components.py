"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogmatch.llm.staging import stage


def _large(links: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours on the least node it knows."""
    both = links.select("up", "down").unionByName(links.select(F.col("down").alias("up"), F.col("up").alias("down")))
    least = both.groupBy("up").agg(F.min("down").alias("least")).select("up", F.least("up", "least").alias("least"))
    return both.where("down > up").join(least, "up").select(F.col("down").alias("up"), F.col("least").alias("down")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """Every node hangs itself and its smaller neighbours on the least of these."""
    least = links.groupBy("up").agg(F.min("down").alias("least"))
    moved = links.join(least, "up").where("down <> least").select(F.col("down").alias("up"), F.col("least").alias("down"))
    return moved.unionByName(least.select("up", F.col("least").alias("down"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``links(a, b)``; the component is its smallest node.

    Each round is a few joins on links and is written down, so no lineage grows and nothing but two
    counts reaches the driver.  Self links are ignored; an empty table gives no rows.
    """
    ends = links.where("a <> b")
    now = stage(ends.select(F.greatest("a", "b").alias("up"), F.least("a", "b").alias("down")).distinct(), "links")
    while True:
        now = stage(_small(_large(now)), "links")
        parents = now.groupBy("up").agg(F.count("*").alias("n"))
        many = parents.where("n > 1").limit(1).count()
        deep = now.alias("x").join(now.alias("y"), F.col("x.down") == F.col("y.up"), "left_semi").limit(1).count()
        if not many and not deep:
            break
    return now.select(F.col("up").alias("node"), F.col("down").alias("component")).unionByName(
        now.select(F.col("down").alias("node"), F.col("down").alias("component")).distinct())
