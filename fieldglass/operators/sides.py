"""Comparison of any number of tables by key: one tagged union, one aggregate, one exchange.

Every side's rows are tagged with the side's number; a key's group tells by a
bit mask which sides have it, how often, and for each value whether the
sides that should agree do.  Nothing is joined, so four sides cost what two do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.operators.contracts import ContractError

#: Sides are bits of a long.
MOST = 62


def _tagged(sides: dict[str, DataFrame], keys: list[str], values: list[str]) -> DataFrame:
    if not 2 <= len(sides) <= MOST:
        raise ContractError(f"compare from 2 to {MOST} sides")
    kinds = {v: next((d.schema[v].dataType for d in sides.values() if v in d.columns), None) for v in values}
    lacking = [v for v, k in kinds.items() if k is None]
    if lacking:
        raise ContractError(f"no side has {lacking[0]}")
    tagged = [d.select(*keys, F.lit(i).alias("side"), *[(F.col(v) if v in d.columns else F.lit(None)).cast(kinds[v]).alias(v) for v in values]) for i, d in enumerate(sides.values())]
    return reduce(DataFrame.unionByName, tagged)


def compare(sides: dict[str, DataFrame], keys: list[str], same: dict[str, list[str]]) -> DataFrame:
    """keys, present (bit mask in the order of the sides), problems (sorted codes); a row for each key.

    ``same``: value -> the sides whose values must be equal, nulls included.
    Codes: missing:SIDE, repeated:SIDE, differs:VALUE.  A side that lacks the key
    takes no part in its values.
    """
    names = list(sides)
    unknown = [s for on in same.values() for s in on if s not in sides]
    if unknown:
        raise ContractError(f"no side is called {unknown[0]}")
    rows = _tagged(sides, keys, list(same))
    here = lambda i: F.col("side") == i
    aggs: list[Column] = [F.count_if(here(i)).alias(f"n_{i}") for i in range(len(names))]
    for k, (value, on) in enumerate(same.items()):
        known = F.when(F.col("side").isin([names.index(s) for s in on]), F.struct(F.col(value).isNull().alias("nil"), F.col(value).alias("v")))
        aggs += [F.min(known).alias(f"least_{k}"), F.max(known).alias(f"most_{k}")]
    g = rows.groupBy(*keys).agg(*aggs)
    codes = [F.when(F.col(f"n_{i}") == 0, f"missing:{s}") for i, s in enumerate(names)] + [F.when(F.col(f"n_{i}") > 1, f"repeated:{s}") for i, s in enumerate(names)]
    codes += [F.when(~F.col(f"least_{k}").eqNullSafe(F.col(f"most_{k}")), f"differs:{value}") for k, value in enumerate(same)]
    mask = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.col(f"n_{i}") > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(len(names))])
    return g.select(*keys, mask.alias("present"), F.array_sort(F.array_compact(F.array(*codes))).alias("problems"))


def counted(compared: DataFrame, keys: list[str]) -> DataFrame:
    """problem, n, first_key: how many keys have each problem and the first of them; the problem '' counts the keys without any."""
    each = compared.select(F.struct(*keys).alias("key"), F.explode(F.when(F.size("problems") == 0, F.array(F.lit(""))).otherwise(F.col("problems"))).alias("problem"))
    return each.groupBy("problem").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))


def require_identical(compared: DataFrame, what: str) -> None:
    """An error that tells the first key with a problem."""
    bad = compared.where(F.size("problems") > 0).orderBy(*[c for c in compared.columns if c not in ("present", "problems")]).limit(1).collect()
    if bad:
        raise ContractError(f"{what}: {bad[0].asDict()}")


def shared_values(sides: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """column, values, shared: how many distinct values there are and how many of them all sides have; nulls are none."""
    rows = _tagged(sides, [], columns)
    long = rows.select("side", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("side", "x.*").where("value is not null")
    held = long.groupBy("column", "value").agg(F.bit_or(F.expr("shiftleft(1L, side)")).alias("mask"))
    found = held.groupBy("column").agg(F.count("*").alias("values"), F.count_if(F.col("mask") == (1 << len(sides)) - 1).alias("shared"))
    # a column without values counts 0
    every = rows.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return every.join(found, "column", "left").na.fill(0, ["values", "shared"])


def four_way(control_images: DataFrame, control_labels: DataFrame, other_images: DataFrame, other_labels: DataFrame) -> DataFrame:
    """Identity of a control and a derived dataset: images (split, stem, width, height, channels) and labels (split, stem, sha256, annotations)."""
    sides = {"control_images": control_images, "other_images": other_images, "control_labels": control_labels, "other_labels": other_labels}
    images, texts = ["control_images", "other_images"], ["control_labels", "other_labels"]
    return compare(sides, ["split", "stem"], {"width": images, "height": images, "channels": images, "sha256": texts, "annotations": texts})


def derived(source: DataFrame, made: DataFrame, remap: Column) -> DataFrame:
    """Identity of a dataset and one made from it: paths equal, images byte for byte, labels equal after ``remap``.

    Rows: path, kind (images or labels), content; ``remap`` gives the label content that the source's should become.
    """
    label = F.col("kind") == "labels"
    side = lambda d, body: d.select("path", "kind", F.when(~label, F.sha2("content", 256)).alias("image"), F.when(label, F.sha2(body, 256)).alias("label"))
    sides = {"source": side(source, remap), "derived": side(made, F.col("content"))}
    return compare(sides, ["path"], {"kind": list(sides), "image": list(sides), "label": list(sides)})


def lineage(manifest: DataFrame, samples: DataFrame, split: str) -> DataFrame:
    """Identity of a manifest and the samples of one split: names one to one, digests equal; rows: split, stem, image_sha256, label_sha256."""
    sides = {"manifest": manifest.where(F.col("split") == split), "samples": samples.where(F.col("split") == split)}
    return compare(sides, ["stem"], {c: list(sides) for c in ("image_sha256", "label_sha256")})


def export_identity(export: DataFrame, source: DataFrame) -> DataFrame:
    """Identity of a prediction export and its source samples: ids, dimensions, digests and targets in their order."""
    truth = F.transform("ground_truth", lambda t: F.struct(t["box_id"].alias("box_id"), t["class_id"].cast("int").alias("class_id"), t["xyxy"].cast("array<double>").alias("xyxy")))
    side = lambda d: d.select("sample_id", "split", "width", "height", "image_sha256", "label_sha256", truth.alias("ground_truth"))
    sides = {"export": side(export), "source": side(source)}
    return compare(sides, ["sample_id"], {c: list(sides) for c in ("split", "width", "height", "image_sha256", "label_sha256", "ground_truth")})
