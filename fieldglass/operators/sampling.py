"""Farthest-first samples with kept distances.

Every row keeps its least distance to the picks so far.  A pass over the table
updates it and brings the best ``POOL`` rows to the driver; there picks go on,
each against the pool alone, for as long as the best row of the pool comes
before the first row that was left behind: distances only fall, so no row left
behind can have overtaken it.  Then a new pass takes up the picks since the last
one.  The result is that of a plain walk, with a few passes instead of one a pick.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.plans import scratch

#: Rows that a pass brings to the driver.
POOL = 512


@dataclass(frozen=True)
class Rules:
    """Rows that a pick rules out: those of its hash or source, and those within ``close`` bits and a distance of ``near``."""

    close: int = 4
    near: float = 0.08


def _distance(vector: Column, other: list[float], mean: bool) -> Column:
    total = F.aggregate(F.zip_with(vector, F.lit(other).cast("array<double>"), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)
    return total / F.size(vector) if mean else total


@dataclass
class _Pool:
    """The best rows of a pass; ``bound``: the last one's place in the order, if rows were left behind."""

    rows: list
    mean: bool
    rules: Rules | None
    bound: tuple | None
    vectors: np.ndarray = field(init=False)
    least: np.ndarray = field(init=False)
    out: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.vectors = np.array([r["vector"] for r in self.rows], np.float64).reshape(len(self.rows), len(self.rows[0]["vector"]) if self.rows else 0)
        self.least = np.array([r["least"] for r in self.rows], np.float64)
        self.out = np.zeros(len(self.rows), bool)

    def key(self, i: int) -> tuple:
        return -self.least[i], self.rows[i]["place"], self.rows[i]["id"]

    def best(self) -> int | None:
        """The first row that may be picked, if it precedes all that were left behind."""
        free = np.flatnonzero(~self.out)
        if not len(free):
            return None
        i = min(free.tolist(), key=self.key)
        return i if self.bound is None or self.key(i) <= self.bound else None

    def take(self, i: int):
        pick = self.rows[i]
        # added up one after another, as the passes do
        gap = np.abs(self.vectors - self.vectors[i]).cumsum(axis=1)[:, -1] if self.vectors.shape[1] else np.zeros(len(self.rows))
        gap = gap / self.vectors.shape[1] if self.mean and self.vectors.shape[1] else gap
        self.least = np.minimum(self.least, gap)
        self.out[i] = True
        if self.rules is not None:
            for j, r in enumerate(self.rows):
                variant = gap[j] <= self.rules.near and bin((r["bits"] ^ pick["bits"]) & (1 << 64) - 1).count("1") <= self.rules.close
                self.out[j] |= r["hash"] == pick["hash"] or r["source"] == pick["source"] or variant
        return pick


def _walk(rows: DataFrame, groups: list[tuple[str | None, int]], mean: bool, rules: Rules | None) -> list:
    """Picks of each group in turn; fewer if a group has no more."""
    spark = rows.sparkSession
    taken: list = []
    with scratch.passing(spark):
        table = scratch.stage(rows.withColumn("least", F.lit(float("inf"))).withColumn("out", F.lit(False)), "sample")
        done = 0  # picks that the table's distances know

        def fresh(group: str | None) -> _Pool:
            nonlocal table, done
            if done < len(taken):
                least, out = F.col("least"), F.col("out")
                for t in taken[done:]:
                    gap = _distance(F.col("vector"), t["vector"], mean)
                    least = F.least(least, gap)
                    out = out | (F.col("id") == t["id"])
                    if rules is not None:
                        variant = (F.bit_count(F.col("bits").bitwiseXOR(F.lit(t["bits"]))) <= rules.close) & (gap <= rules.near)
                        out = out | (F.col("hash") == t["hash"]) | (F.col("source") == t["source"]) | variant
                table = scratch.stage(table.withColumn("least", least).withColumn("out", F.coalesce(out, F.lit(False))), "sample")
                done = len(taken)
            free = table.where(~F.col("out"))
            free = free if group is None else free.where(F.col("split") == group)
            best = free.orderBy(F.desc("least"), "place", "id").limit(POOL + 1).collect()
            kept = best[:POOL]
            bound = (-kept[-1]["least"], kept[-1]["place"], kept[-1]["id"]) if len(best) > POOL else None
            return _Pool(kept, mean, rules, bound)

        for group, count in groups:
            pool = fresh(group)
            for _ in range(count):
                i = pool.best()
                if i is None and pool.bound is not None:
                    pool = fresh(group)
                    i = pool.best()
                if i is None:
                    break
                taken.append(pool.take(i))
    return taken


def _placed(rows: DataFrame, id_col: str, seed: int, order: Column | None) -> DataFrame:
    return rows.withColumn("place", (order if order is not None else F.xxhash64(F.col(id_col), F.lit(seed))).cast("long"))


def diverse(rows: DataFrame, counts: dict[str, int], seed: int, close: int = 4, near: float = 0.08, order: Column | None = None) -> list:
    """Identifiers picked farthest first, split by split, without copies and variants of those taken.

    rows: id, split, hash, source, bits (perceptual hash), vector (of one
    length).  No hash or source is taken twice, nor a row within ``close`` bits
    and a mean difference of ``near`` of one taken.  Ties go by ``order``, a
    column that stands for any table of ranks, else by a seeded hash; then by id.
    """
    slim = _placed(rows, "id", seed, order).select("id", "split", "hash", "source", "bits", F.col("vector").cast("array<double>").alias("vector"), "place")
    taken = _walk(slim, list(counts.items()), True, Rules(close, near))
    for split, count in counts.items():
        if sum(t["split"] == split for t in taken) < count:
            raise ValueError(f"could not select {count} sufficiently distinct rows from {split}")
    return [t["id"] for t in taken]


def farthest_first(rows: DataFrame, id_col: str, vector: str, count: int, seed: int, order: Column | None = None) -> list:
    """``count`` identifiers, fewer if there are no more rows: the first in the order, then each the farthest (by the sum of absolute differences) from those taken before."""
    slim = _placed(rows, id_col, seed, order).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vector"), "place")
    return [t["id"] for t in _walk(slim, [(None, count)], False, None)]
