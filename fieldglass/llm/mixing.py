"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a fixed pseudo-random order, fill blocks of equal
text.  Block j of a source of weight w has the window [floor(j / w),
ceil((j + 1) / w)): it is released at the window's start and due at its end.
Among released blocks the one with the earliest deadline takes the next slot,
so after any number of slots each source is less than one block from its
share.  Weights are exact fractions (of floats, their exact values): windows
are computed in integers of any length, and nothing is rounded to a period.
Where a source runs out the rest go on with their weights in proportion, from
a new start.  The schedule is as long as the text has blocks.  One task walks
through it, holding one block of each source, and writes the slots as it goes;
the driver holds the sources' weights only.  Rows find their slots by a join.

Defined results: every row gets a position; a null source is a source of its
own; a null text has length 0; rows equal in identifier are ordered by their
texts' hash, rows equal in both by a hash of the whole row; an empty table gives no rows; sources of weight 0 follow after all
others, in equal shares; if all weights are 0, all share equally.  Other columns
pass through; a column of theirs named as a new one (block, slot, position)
gets an underscore behind its name.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice
from numbers import Rational

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldglass.llm._shared import free_name, mapped, packed, stage

#: Text of a block in characters, and slots that the scheduling task hands on at a time.
BLOCK_CHARS, PERIOD = 1 << 16, 1000
#: So many slots are sent to every executor; a longer schedule is joined by a shuffle.
SENT = 1 << 16
#: Rows of a range of the pseudo-random order, which is ranked apart, if one source had all.
RANGE_ROWS = 1 << 16


def integer_weights(weights: dict[str, Rational | float]) -> dict[str, int]:
    """Integers in exactly the proportion of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    if any(w < 0 for w in exact.values()):
        raise ValueError("a source's weight is negative")
    unit = math.lcm(*(w.denominator for w in exact.values()))
    out = {s: int(w * unit) for s, w in exact.items()}
    g = math.gcd(*out.values()) or 1
    return {s: w // g for s, w in out.items()}


def schedule(weights: dict[str, int]) -> Iterator[str]:
    """The source of each slot, without end. Earliest deadline first over released blocks."""
    total = sum(weights.values())
    later = [(0, s, 0) for s in sorted(weights)]  # (release, source, block)
    heapq.heapify(later)
    ready: list[tuple[int, int, int, str, int]] = []
    slot = 0
    while True:
        while later and later[0][0] <= slot:
            _, s, j = heapq.heappop(later)
            k = weights[s]
            due = -(-(j + 1) * total // k)
            # ties: a window that overlaps its successor's is served first
            overlap = (j + 1) * total % k != 0
            heapq.heappush(ready, (due, -int(overlap), -k, s, j))
        due, _, _, s, j = heapq.heappop(ready)
        assert slot < due
        yield s
        heapq.heappush(later, ((j + 1) * total // weights[s], s, j + 1))
        slot += 1


def pfair(weights: dict[str, int]) -> list[str]:
    """The source of each slot until all weights are served exactly."""
    return list(islice(schedule(weights), sum(weights.values())))


def slots(blocks: dict[str, int], weights: dict[str, int]) -> Iterator[tuple[str, int]]:
    """(source, block) of each slot until every source's blocks are placed.

    Each phase ends at the slot in which some source places its last block;
    the others go on in the next phase.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    while left:
        own = {s: weights[s] for s in left if weights[s]} or dict.fromkeys(left, 1)
        for s in schedule(integer_weights(own)):
            yield s, blocks[s] - left[s]
            left[s] -= 1
            if not left[s]:
                del left[s]
                break


def _slots(blocks: dict[str, int], weights: dict[str, int], rows: int):
    def work(batches):
        for _ in batches:
            found, base = slots(blocks, weights), 0
            while part := list(islice(found, rows)):
                columns = [pa.array([s for s, _ in part], pa.string()), pa.array([j for _, j in part], pa.int64()), pa.array(range(base, base + len(part)), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["_s", "block", "slot"])
                base += len(part)

    return work


_NULL = "\0null"


def mix_sources(
    docs: DataFrame,
    weights: dict[str, Rational | float] | None = None,
    power: float = 0.5,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
    period: int = PERIOD,
    size: Column | None = None,
    tie: Column | None = None,
) -> DataFrame:
    """The input's columns with block (of its source), slot, and position in the mixed order.

    weights: by source; without them a source of n characters weighs
    n ** power.  Sources missing from weights weigh as the smallest given.
    A document belongs to the block in which it begins.  ``period``: slots that
    the scheduling task hands on at a time.  ``size`` and ``tie`` stand for the text's length and hash, for callers without a text column.
    """
    spark = docs.sparkSession
    order = F.xxhash64(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit("mix"))
    n = size if size is not None else F.coalesce(F.length(F.col(f"`{text_col}`")), F.lit(0))
    keyed = docs.select(
        F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(_NULL)).alias("_s"),
        order.alias("_o"),
        F.col(f"`{id_col}`").alias("_id"),
        (tie if tie is not None else F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))).alias("_h"),
        (n.cast("long") + 1).alias("_n"),
        packed(docs).alias("_row"),
    )
    light = stage(keyed.select("_s", "_o", "_n"), "sizes")
    # as many ranges as the rows need, so that none grows with the table
    ranges = max(4, (light.count() // RANGE_ROWS).bit_length())
    ranged = F.shiftright(F.col("_o"), 64 - ranges)
    keyed, light = keyed.withColumn("_range", ranged), light.withColumn("_range", ranged)
    # lengths summed per (source, range) first; then only these sums are added up
    sums = light.groupBy("_s", "_range").agg(F.sum("_n").alias("_sum"))
    before = W.partitionBy("_s").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    totals = {r["_s"]: r["t"] for r in sums.groupBy("_s").agg(F.sum("_sum").alias("t")).collect()}
    new = ["block", "slot", "position"]
    out_cols = [F.col("_row")[c].alias(free_name(c, [*new, *(d for d in docs.columns if d != c)]) if c.lower() in new else c) for c in docs.columns]
    within = W.partitionBy("_s", "_range").orderBy("_o", "_id", "_h", F.xxhash64("_row")).rowsBetween(W.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum("_n").over(within), F.lit(0))
    if weights is None:
        weights = {s: float(t) ** power for s, t in totals.items()}
    else:
        weights = {_NULL if s is None else s: w for s, w in weights.items()}
    floor = min(weights.values(), default=1)
    own = integer_weights({s: weights.get(s, floor) for s in totals})
    blocks = {s: -(-t // block_chars) for s, t in totals.items()}
    plan = stage(mapped(spark.range(0, 1, 1, 1), _slots(blocks, own, period), "_s string, block long, slot long"), "slots")
    plan = F.broadcast(plan) if sum(blocks.values()) <= SENT else plan
    placed = (
        keyed.join(sums.select("_s", "_range", "_before"), ["_s", "_range"])
        .withColumn("_start", start)
        .withColumn("block", F.expr(f"_start div {int(block_chars)}"))
        .join(plan, ["_s", "block"])
    )
    return placed.select(*out_cols, "block", "slot", F.struct("slot", F.col("_start").alias("start")).alias("position"))
