"""Dataset trees, manifests, prediction exports and training logs."""

from __future__ import annotations

import hashlib
import json
import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.scene import EXPORT, SPLITS

_PART = r"(?:^|/)((?:train|valid|test)(?:/.*)?)$"


def content(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, length, content of every file, empty ones too.

    The scan passes over files without bytes; they are known from its file index, which the driver holds anyway.
    """
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    names = [(re.sub("^file:/+", "file:/", unquote(p)),) for p in scan.inputFiles()]
    every = spark.createDataFrame(names, "path string")
    return every.join(scan.select("path", "length", "content"), "path", "left").select("path", F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("content", F.lit("").cast("binary")).alias("content"))


def files(spark: SparkSession, root: str, glob: str = "*", hashed: bool = False) -> DataFrame:
    """path, relative_path, split, kind, name, stem, size_bytes (and sha256)."""
    df = content(spark, root, glob)
    rel = F.regexp_extract("path", _PART, 1)
    name = F.element_at(F.split("path", "/"), -1)
    cols = ["path", rel.alias("relative_path"), F.get(F.split(rel, "/"), F.lit(0)).alias("split"), F.get(F.split(rel, "/"), F.lit(1)).alias("kind"), name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.col("length").alias("size_bytes")]
    return df.select(*cols, *([F.sha2("content", 256).alias("sha256")] if hashed else []))


def images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images; one that can't be decoded has height -1."""
    return spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(root).select("image.*")


def candidate_id(name: str, relative: str) -> str:
    slug = "".join(c if c.isascii() and c.isalnum() else "-" for c in name.lower())
    while "--" in slug:
        slug = slug.replace("--", "-")
    return f"{slug.strip('-')}-{hashlib.sha1(relative.casefold().encode()).hexdigest()[:8]}"


def export(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXPORT).json(path)


def export_violations(rows: DataFrame, classes: int) -> DataFrame:
    """sample_id, rule for every broken rule of a prediction export."""
    box = lambda b: (F.size(b["xyxy"]) == 4) & (b["xyxy"][0] < b["xyxy"][2]) & (b["xyxy"][1] < b["xyxy"][3]) & (b["xyxy"][0] >= 0) & (b["xyxy"][1] >= 0) & (b["xyxy"][2] <= F.col("width")) & (b["xyxy"][3] <= F.col("height"))
    both = ("predictions", "ground_truth")
    rules = {
        "split": ~F.col("split").isin(*SPLITS) | ~F.col("sample_id").startswith(F.concat(F.col("split"), F.lit("/"))),
        "dimensions": (F.col("width") <= 0) | (F.col("height") <= 0),
        **{f"{c}_ids": (F.size(F.array_distinct(F.transform(c, lambda b: b["box_id"]))) != F.size(c)) | F.exists(c, lambda b: F.coalesce(b["box_id"], F.lit("")) == "") for c in both},
        **{f"{c}_class": F.exists(c, lambda b: ~b["class_id"].between(0, classes - 1)) for c in both},
        **{f"{c}_box": F.exists(c, lambda b: ~F.coalesce(box(b), F.lit(False))) for c in both},
        "confidence": F.exists("predictions", lambda b: ~F.coalesce(b["confidence"].between(0, 1), F.lit(False))),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in rules.items()]))
    single = rows.select("sample_id", F.explode(found).alias("rule"))
    twice = rows.groupBy("sample_id").agg(F.count("*").alias("n")).where("n > 1").select("sample_id", F.lit("sample_id").alias("rule"))
    return single.unionByName(twice)


def best_epoch(log: DataFrame, score: str = "map50_95") -> DataFrame:
    """The epoch of the greatest score, the earliest on ties."""
    return log.agg(F.max_by(F.struct(*log.columns), F.struct(F.col(score), -F.col("epoch"))).alias("r")).select("r.*")


def config_digest(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
