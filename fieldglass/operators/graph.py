"""Connected components of a link table, without collecting it.

Alternating large-star and small-star rounds (Kiveris et al., 2014): each
round is one min-aggregation and one equi join on the node.  The aggregation
combines before its shuffle.  Nodes with more than a 256th of all links are
some hundred at most; their minima are broadcast and their links never shuffled
by node, so no task gets a hot node.  Rounds are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.plans import scratch

#: A node is hot with more links than this (1 MB of them) and than a share of all.
HOT, SHARE = 1 << 16, 256


def _star(edges: DataFrame, large: bool, hot: int | None) -> DataFrame:
    """One star round over (a, b); every edge is seen from one or both ends.  Without ``hot`` no node is."""
    if large:
        near = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    if hot is None:
        joined = near.join(least.select("a", "m"), "a")
    else:
        joined = _apart(near, least, hot)
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _apart(near: DataFrame, least: DataFrame, hot: int) -> DataFrame:
    """``near`` with its nodes' minima; those of hot nodes are broadcast."""
    busy = F.broadcast(least.where(F.col("n") > hot).select("a", F.col("m").alias("top")))
    seen = near.join(busy, "a", "left")
    cold = seen.where("top is null").join(least.select("a", "m"), "a").select("a", "b", "m")
    return cold.unionByName(seen.where("top is not null").select("a", "b", F.col("top").alias("m")))


def components(links: DataFrame, a: str, b: str, stage: Callable[[DataFrame, str], DataFrame] = scratch.stage) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link.

    Nodes are longs.  Nulls and self-links are ignored; an empty table gives
    no rows; repeated links count once.  ``stage`` writes a table and reads it back.
    """
    edges = stage(links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").distinct(), "links")
    told, size = None, edges.count()
    while size:
        # a node of the first star has ``size`` links at most, one of the second twice that
        hot = max(HOT, 2 * size // SHARE) if 2 * size > HOT else None
        edges = stage(_star(_star(edges, True, hot), False, hot), "star")
        now = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if tuple(now) == told:
            break
        told, size = tuple(now), now[0]
    tops = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)
