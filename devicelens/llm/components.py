"""Connected components of links, by alternating large and small stars.

Each round every node passes its smallest neighbour to its larger (then to its
smaller) neighbours; the links become stars around each component's smallest
node in a logarithmic number of rounds. Rounds are written to the shared
folder; nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devicelens.llm.common import materialize


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; component is its smallest node.

    With ``rounds`` it stops early: equal components are then surely
    connected, different ones may be.
    """
    links = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .distinct(), "links")
    done = 0
    while done != rounds and (rounds is not None or not _flat(links)):
        both = links.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large.where("a <> b"), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))))
        links = materialize(small.where("a <> b").distinct(), "links")
        done += 1
    if rounds is not None:
        # A node may still lie under several others; any one of them is connected to it.
        links = links.groupBy("a").agg(F.min("b").alias("b"))
    tops = links.select(F.col("b").alias("a")).distinct().join(links, "a", "left_anti")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        tops.select(F.col("a").alias("node"), F.col("a").alias("component")))


def _flat(links: DataFrame) -> bool:
    """Whether no node lies under two others, or under one and above another: each component is a star then."""
    ends = links.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("under")), F.struct(F.col("b").alias("node"), F.lit(0).alias("under")))))
    ends = ends.groupBy("node").agg(F.sum("under").alias("under"), F.min("under").alias("least"))
    return ends.where("under > 1 OR (under = 1 AND least = 0)").agg(F.count(F.lit(1))).first()[0] == 0
