"""Contracts that are observed in the job that writes: counts of violations and of rows, checked before publication.

    watched, seen = observe(rows, {"box": ~valid}, {"images": F.count_distinct("image")}, example=F.col("image"))
    publish(watched, seen, path)

The rows are read once: the metrics come from the write itself.  What
violates a rule is counted and the least example named; the written folder is put in its
place only if no rule is violated and the expected numbers are met.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from fieldglass.operators.contracts import ContractError
from fieldglass.plans import scratch


@dataclass
class Seen:
    """The metrics of a job that has run."""

    observation: Observation
    rules: list[str]
    numbers: list[str]
    expected: dict[str, Any] = field(default_factory=dict)

    def metrics(self) -> dict[str, Any]:
        got = self.observation.get
        return {n: got[n] for n in ("rows", *self.numbers)} | {r: got[f"bad_{r}"] for r in self.rules}

    def problems(self) -> list[str]:
        """What does not hold, with its numbers; call it after an action has run."""
        got = self.observation.get
        out = [f"{r}: {got[f'bad_{r}']} of {got['rows']} rows, for example {got[f'example_{r}']}" for r in self.rules if got[f"bad_{r}"]]
        return out + [f"{n} is {got[n]}, not {v}" for n, v in self.expected.items() if got[n] != v]

    def require(self, what: str) -> dict[str, Any]:
        bad = self.problems()
        if bad:
            raise ContractError(f"{what}: {'; '.join(bad)}")
        return self.metrics()


def observe(rows: DataFrame, rules: dict[str, Column], numbers: dict[str, Column] | None = None, example: Column | None = None, expected: dict[str, Any] | None = None) -> tuple[DataFrame, Seen]:
    """``rows`` unchanged, and what their next job will tell.

    rules: name -> whether a row violates it (null counts as a violation);
    numbers: name -> an aggregate; ``expected``: numbers that must be met.
    """
    numbers = numbers or {}
    unknown = set(expected or {}) - {*numbers, "rows"}
    if unknown:
        raise ContractError(f"no number is called {sorted(unknown)[0]}")
    seen = Observation(f"contract-{uuid.uuid4().hex}")
    told = (example if example is not None else F.lit(None)).cast("string")
    bad = {r: F.coalesce(c, F.lit(True)) for r, c in rules.items()}
    metrics = [F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in numbers.items()]]
    for r, c in bad.items():
        metrics += [F.count_if(c).alias(f"bad_{r}"), F.min(F.when(c, told)).alias(f"example_{r}")]
    return rows.observe(seen, *metrics), Seen(seen, list(rules), list(numbers), expected or {})


def publish(watched: DataFrame, seen: Seen, path: str, write: Callable[[DataFrame, str], None] | None = None) -> dict[str, Any]:
    """Write beside ``path``, check, and rename; a violation leaves what was at ``path`` and nothing else.  Returns the metrics."""
    spark = watched.sparkSession
    building = f"{path.rstrip('/')}.building-{uuid.uuid4().hex}"
    try:
        (write or (lambda d, p: d.write.parquet(p)))(watched, building)
        got = seen.require(path)
    except BaseException:
        scratch.remove(spark, building)
        raise
    jvm = spark.sparkContext._jvm
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = f"{path.rstrip('/')}.before-{uuid.uuid4().hex}"
    there = fs.exists(place(path))
    if there and not fs.rename(place(path), place(aside)):
        scratch.remove(spark, building)
        raise OSError(f"{path} can't be put aside")
    if not fs.rename(place(building), place(path)):
        if there:
            fs.rename(place(aside), place(path))
        scratch.remove(spark, building)
        raise OSError(f"{path} can't be put in its place")
    if there:
        scratch.remove(spark, aside)
    return got


def split_numbers(split: str, classes: int, splits: tuple[str, ...], class_col: str | None = None) -> dict[str, Column]:
    """Aggregates by split, and by split and class if a class column is given: names as ``expected_numbers`` makes them."""
    s = F.col(split)
    out = {f"{n}_rows": F.count_if(s == n) for n in splits}
    if class_col is not None:
        out |= {f"{n}_class_{c}": F.count_if((s == n) & (F.col(class_col) == c)) for n in splits for c in range(classes)}
    return out


def expected_numbers(rows: dict[str, int], classes: dict[str, list[int]] | None = None) -> dict[str, int]:
    """What ``split_numbers`` must give: rows of each split, and of each class in it."""
    return {f"{n}_rows": v for n, v in rows.items()} | {f"{n}_class_{c}": v for n, counts in (classes or {}).items() for c, v in enumerate(counts)}


def order_free(select: Callable[[DataFrame], list], rows: DataFrame) -> list:
    """A selection's result, which must be the same for two layouts of the rows: sorted one way in many files, the other way in one.

    The layouts are written tables, so no plan can undo them.
    """
    spark = rows.sparkSession
    with scratch.passing(spark):
        key = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])))
        parted = scratch.stage(rows.repartition(7, key).sortWithinPartitions(key), "layout")
        single = scratch.stage(rows.repartition(1).sortWithinPartitions(key.desc()), "layout")
        first, second = select(parted), select(single)
    if first != second:
        raise ContractError("the selection depends on the order of its input")
    return first
