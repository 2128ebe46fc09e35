"""Comparison of configurations that are rows (path, parent, type, value), as from ``sources.settings``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.operators.contracts import ContractError

#: The sections that make an experiment what it is, and the fields of an environment that must not drift.
SECTIONS = ("dataset", "model", "training", "augmentation", "evaluation", "seed_policy", "framework")
ENVIRONMENT = ("python.version", "python.implementation", "libraries", "cuda.available", "cuda.runtime_version", "cuda.cudnn_version", "gpu.name", "gpu.vram_bytes", "gpu.driver_version", "weights.sha256")


def differences(left: DataFrame, right: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, path, left_type, left_value, right_type, right_value of keys that one side lacks or whose type or value differs.

    Below such a key nothing is told: a mapping that one side lacks is one
    difference.  ``by``: columns of both sides that tell the pairs apart.
    """
    by = by or []
    tagged = left.select(*by, "path", "parent", F.struct("type", "value").alias("l"), F.lit(None).cast("struct<type:string,value:string>").alias("r")).unionByName(
        right.select(*by, "path", "parent", F.lit(None).cast("struct<type:string,value:string>").alias("l"), F.struct("type", "value").alias("r"))
    )
    j = tagged.groupBy(*by, "path").agg(F.max("parent").alias("parent"), F.max("l").alias("l"), F.max("r").alias("r"))
    off = j.where(~F.col("l").eqNullSafe(F.col("r")))
    above = off.select(*by, F.col("path").alias("parent"))
    return off.join(above, [*by, "parent"], "left_anti").select(*by, "path", *[F.col(f"{s}.{c}").alias(f"{n}_{c}") for s, n in (("l", "left"), ("r", "right")) for c in ("type", "value")])


def differing(left: Column, right: Column) -> Column:
    """``differences`` of two documents of one row, as from ``sources.settings.flattened``: an array, so that no key moves."""
    ends = lambda side, p: F.array_max(F.transform(F.filter(side, lambda x: x["path"] == p), lambda x: F.struct(x["type"], x["value"])))
    parents = lambda p: F.array_max(F.transform(F.filter(F.concat(left, right), lambda x: x["path"] == p), lambda x: x["parent"]))
    paths = F.array_distinct(F.transform(F.concat(F.array_except(left, right), F.array_except(right, left)), lambda x: x["path"]))
    both = F.transform(paths, lambda p: F.struct(p.alias("path"), parents(p).alias("parent"), ends(left, p).alias("l"), ends(right, p).alias("r")))
    off = F.filter(both, lambda x: ~x["l"].eqNullSafe(x["r"]))
    # bound once, for a lambda that names an expression works it out for each element
    own = F.get(F.transform(F.array(off), lambda o: F.filter(o, lambda x: ~F.exists(o, lambda y: F.coalesce(y["path"] == x["parent"], F.lit(False))))), F.lit(0))
    return F.transform(own, lambda x: F.struct(x["path"].alias("path"), *[x[s][c].alias(f"{n}_{c}") for s, n in (("l", "left"), ("r", "right")) for c in ("type", "value")]))


def scientific(rows: DataFrame, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """The keys of the scientific sections; a configuration without one of them is an error."""
    own = rows.where(F.substring_index("path", ".", 1).isin(list(sections)))
    there = {r["path"] for r in own.where(F.col("path").isin(list(sections)) & (F.col("type") == "dict")).select("path").distinct().collect()}
    lacking = [s for s in sections if s not in there]
    if lacking:
        raise ContractError(f"the configuration has no section {lacking[0]}")
    return own


def fields(rows: DataFrame, names: tuple[str, ...] = ENVIRONMENT) -> DataFrame:
    """The keys that are compared between environments, with all below them."""
    own = F.lit(False)
    for n in names:
        own = own | (F.col("path") == n) | F.col("path").startswith(f"{n}.")
    return rows.where(own).withColumn("parent", F.when(F.col("path").isin(list(names)), F.lit("")).otherwise(F.col("parent")))


def unplanned(configs: DataFrame, plan: DataFrame) -> DataFrame:
    """first, second, path, rule: differences between two configurations that the plan does not name (unplanned) or names in vain (absent).

    configs: name, path, parent, type, value; plan: first, second, path; a
    pair whose configurations must be equal has one row with a null path.
    """
    pairs = plan.select("first", "second").distinct()
    own = lambda side: pairs.join(configs.withColumnRenamed("name", side), side)
    found = differences(own("first"), own("second"), ["first", "second"]).select("first", "second", "path", F.lit(1).alias("found"))
    want = plan.where("path is not null").select("first", "second", "path", F.lit(1).alias("planned"))
    j = found.join(want, ["first", "second", "path"], "full_outer")
    return j.where("found is null or planned is null").select("first", "second", "path", F.when(F.col("planned").isNull(), "unplanned").otherwise("absent").alias("rule"))


def exact(rows: DataFrame, expected: DataFrame) -> None:
    """The configuration has exactly the expected keys, values and types, else an error that names the first path."""
    bad = differences(rows, expected).orderBy("path").limit(1).collect()
    if bad:
        raise ContractError(f"the configuration differs: {bad[0].asDict()}")


def routes(rows: DataFrame, splits: dict[str, str]) -> None:
    """A dataset's configuration routes each split to its folder and names no other."""
    got = {r["path"]: r["value"] for r in rows.where(F.col("path").isin("train", "val", "valid", "test")).collect()}
    if got != splits:
        raise ContractError(f"the configuration routes {got}, not {splits}")


def unsound(rows: DataFrame, rates: tuple[str, ...] = ("precision", "recall", "f1", "iou")) -> DataFrame:
    """path, value, rule of numbers that are not finite, and of rates outside 0 to 1; rows as from ``sources.settings.json``.

    JSON has no such numbers: they are texts there, nan, infinity and -infinity.
    """
    number = F.col("value").try_cast("double")
    endless = F.col("type").isin("float", "str") & F.lower("value").isin("nan", "infinity", "-infinity")
    outside = F.col("type").isin("int", "float") & F.substring_index("path", ".", -1).isin(list(rates)) & ~number.between(0, 1)
    return rows.select(*[c for c in rows.columns if c not in ("parent", "type")], F.when(endless, "not_finite").when(outside, "rate_outside").alias("rule")).where("rule is not null")
