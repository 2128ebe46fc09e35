"""Ordinals within groups of any size, without a window over a whole group.

Rows are sorted by range into parts, each row's place in its part is
known by the part alone, and the parts' sizes (a row for each part and group)
give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldglass.plans.scratch import partitions, stage

_LOCAL = 33  # bits of a row's place in its part


def ordinals(rows: DataFrame, keys: list[str], order: list[Column], name: str = "n", part: str | None = None) -> DataFrame:
    """``rows`` with the 1-based place of each in its group; ``part``: name of a column for the part, in order within a group.

    The order must be total, or equal rows take places in any order.  The result is written, so it can be used again.
    """
    ids = "placed_at"
    sorted_ = rows.repartitionByRange(partitions(rows.sparkSession), *keys, *order).sortWithinPartitions(*keys, *order)
    placed = stage(sorted_.withColumn(ids, F.monotonically_increasing_id()), "placed")
    pid, at = F.shiftright(F.col(ids), _LOCAL), F.col(ids).bitwiseAND(F.lit((1 << _LOCAL) - 1))
    sizes = placed.groupBy(*keys, pid.alias("pid")).agg(F.count("*").alias("size"), F.min(at).alias("first_at"))
    # one row for each part and group: without groups, as many as there are parts
    before = F.coalesce(F.sum("size").over(W.partitionBy(*keys).orderBy("pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*keys, "pid", (before - F.col("first_at") + 1).alias("shift"))
    on = F.col("p.pid") == F.col("o.pid")
    for k in keys:
        on = on & F.col(f"p.`{k}`").eqNullSafe(F.col(f"o.`{k}`"))
    out = placed.withColumn("pid", pid).alias("p").join(offsets.alias("o"), on).select("p.*", "o.shift")
    return out.select(*rows.columns, (at + F.col("shift")).alias(name), *([F.col("pid").alias(part)] if part else []))


def running_sum(rows: DataFrame, keys: list[str], part: str, order: str, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of the values at the same or an earlier place of the group; ``part`` as from ``ordinals``."""
    sums = rows.groupBy(*keys, part).agg(F.sum(value).alias("own"))
    before = F.sum("own").over(W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(*keys, part, F.coalesce(before, F.lit(0)).alias("before"))
    here = W.partitionBy(*keys, part).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(value).over(here)).join(sums, [*keys, part]).withColumn(name, F.col(name) + F.col("before")).drop("before")


def running_max(rows: DataFrame, keys: list[str], part: str, order: str, value: str, name: str) -> DataFrame:
    """``rows`` with the greatest value among those at the same or a later place of the group; ``part`` as from ``ordinals``."""
    later = W.partitionBy(*keys, part).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    tops = rows.groupBy(*keys, part).agg(F.max(value).alias("top"))
    behind = F.max("top").over(W.partitionBy(*keys).orderBy(part).rowsBetween(1, W.unboundedFollowing))
    tops = tops.select(*keys, part, behind.alias("behind"))
    return rows.withColumn(name, F.max(value).over(later)).join(tops, [*keys, part]).withColumn(name, F.greatest(name, "behind")).drop("behind")


def following(rows: DataFrame, keys: list[str], part: str, order: str, values: list[str]) -> DataFrame:
    """``rows`` with ``next_<value>`` of the row at the next place of the group, null for the last."""
    here = W.partitionBy(*keys, part).orderBy(order)
    firsts = rows.groupBy(*keys, part).agg(F.min_by(F.struct(*values), order).alias("first"))
    firsts = firsts.select(*keys, part, F.lead("first").over(W.partitionBy(*keys).orderBy(part)).alias("behind"))
    out = rows.withColumn("ahead", F.lead(F.struct(*values)).over(here)).join(firsts, [*keys, part])
    return out.select(*rows.columns, *[F.coalesce(F.col(f"ahead.{v}"), F.col(f"behind.{v}")).alias(f"next_{v}") for v in values])
