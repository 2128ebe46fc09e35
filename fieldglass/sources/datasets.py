"""Dataset trees end to end: discovery, class lists, strict pairing, manifests, CSV and Markdown tables."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.operators import duplicates
from fieldglass.scene import SPLITS
from fieldglass.sources import settings, trees

KINDS = ("images", "labels")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """candidate_id, root, config, class_names of every folder with a data.yaml and all splits' images and labels; an error without any.

    Folders are known by the files in them.
    """
    every = trees.content(spark, root)
    path = F.col("path")
    parts = every.select(path, F.regexp_extract(path, r"^(.*)/(train|valid|test)/(images|labels)/[^/]+$", 1).alias("root"), F.regexp_extract(path, r"/((?:train|valid|test)/(?:images|labels))/[^/]+$", 1).alias("part"))
    whole = parts.where("root <> ''").groupBy("root").agg(F.count_distinct("part").alias("n")).where(F.col("n") == len(SPLITS) * len(KINDS)).select("root")
    configs = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "data.yaml").text(root, wholetext=True)
    configs = configs.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")).withColumn("root", F.regexp_replace("file", "/data\\.yaml$", "")).join(whole, "root")
    lists = settings.class_lists(settings.yaml(configs.select("file", "text")))
    base = re.sub(r"^file:/*", "/", root).rstrip("/")
    own = F.regexp_replace("root", "^file:/*", "/")
    rel = F.substr(own, F.lit(len(base) + 2))
    rel = F.when(rel == "", ".").otherwise(rel)
    slug = F.trim(F.regexp_replace(F.lower(F.element_at(F.split(own, "/"), -1)), "[^a-z0-9]+", "-"), F.lit("-"))
    name = F.concat(slug, F.lit("-"), F.substring(F.sha1(F.lower(rel).cast("binary")), 1, 8))
    failed = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat_ws(": ", "file", "problem")).cast("array<string>")).otherwise(F.col("names"))
    out = configs.select("root", "file").join(lists, "file", "left").select(name.alias("candidate_id"), "root", F.col("file").alias("config"), failed.alias("class_names"))
    if out.isEmpty():
        raise FileNotFoundError(f"no complete dataset below {root}")
    return out.orderBy(F.lower("root"), "root")


def primary(candidates: DataFrame, marker: str = ".yolov8") -> DataFrame:
    """The candidate that stands for its copies: the versioned folder first, then by path."""
    name = F.lower(F.element_at(F.split("root", "/"), -1))
    return candidates.orderBy(~name.contains(marker), F.lower("root"), "root").limit(1)


def pairs(spark: SparkSession, root: str, strict: bool = True, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """split, stem, image, label of files that pair one to one; ``strict`` refuses any other file of these splits."""
    every = trees.files(spark, root).where(F.col("split").isin(list(splits)) & F.col("kind").isin(list(KINDS)))
    side = lambda kind, name: every.where(F.col("kind") == kind).select("split", F.lower("stem").alias("stem"), F.col("path").alias(name))
    images, labels = side("images", "image"), side("labels", "label")
    paired = duplicates.pair_files(images, labels, "stem", ["split"])
    if strict:
        bad = paired.where("status <> 'paired'").orderBy("split", "stem").limit(1).collect()
        if bad:
            raise ValueError(f"{bad[0]['split']}/{bad[0]['stem']} is {bad[0]['status']}")
    one = paired.where("status = 'paired'").select("split", "stem")
    return one.join(images, ["split", "stem"]).join(labels, ["split", "stem"])


def unique_stems(files: DataFrame, suffixes: list[str]) -> DataFrame:
    """stem, path of files with one of the suffixes whose stem no other has."""
    own = files.where(F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1)).isin(suffixes))
    return own.groupBy(F.lower("stem").alias("stem")).agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1").drop("n")


def tolerant_labels(files: DataFrame, names: list[str]) -> DataFrame:
    """file, line_number, class_name, coords of the lines that are not blank, unchecked."""
    lines = files.select("file", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("n", "line")).where(F.trim("line") != "")
    t = F.split(F.trim("line"), r"\s+")
    name = F.get(F.array(*[F.lit(n) for n in names]), F.get(t, F.lit(0)).cast("int"))
    return lines.select("file", (F.col("n") + 1).alias("line_number"), name.alias("class_name"), F.transform(F.slice(t, 2, 1 << 20), lambda x: x.cast("double")).alias("coords"))


def dimensions(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(image, width, height, channels of what can be decoded; an issue row for each file that can't)."""
    rows = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(root).select("image.origin", "image.width", "image.height", "image.nChannels")
    good = rows.where("height > 0").select(F.col("origin").alias("image"), "width", "height", F.col("nChannels").alias("channels"))
    bad = rows.where("height <= 0").select(F.col("origin").alias("image"), F.lit(0).alias("line_number"), F.lit("unreadable_image").alias("code"))
    return good, bad


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """relative_path, size_bytes, sha256 of every file, in the order of the lower-case path."""
    base = re.sub(r"^file:/*", "/", root).rstrip("/")
    rows = trees.content(spark, root)
    path = F.regexp_replace("path", "^file:/*", "/")
    rel = F.substr(path, F.lit(len(base) + 2))
    return rows.select(rel.alias("relative_path"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256")).orderBy(F.lower("relative_path"), "relative_path")


def manifest_digest(rows: DataFrame) -> str:
    """SHA-256 over ``path TAB size TAB digest`` lines in order, without a final line feed.

    The ordered lines are streamed to the driver part by part, so no array of all is made.
    """
    import hashlib

    line = F.concat_ws("\t", "relative_path", F.col("size_bytes").cast("string"), "sha256")
    told, first = hashlib.sha256(), True
    for r in rows.orderBy(F.lower("relative_path"), "relative_path").select(line.alias("line")).toLocalIterator():
        told.update((("" if first else "\n") + r["line"]).encode())
        first = False
    return told.hexdigest()


def csv(spark: SparkSession, path: str, schema: str | T.StructType, where: Column | None = None) -> DataFrame:
    """A CSV table with a header, cast to the given types; values that can't be cast fail, flags are read in any case."""
    want = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("mode", "FAILFAST").csv(path)
    names = {c.strip(): c for c in raw.columns}
    missing = [f.name for f in want if f.name not in names]
    if missing:
        raise ValueError(f"{path} has no column {missing[0]}")
    cast = lambda f: F.lower(F.trim(F.col(f"`{names[f.name]}`"))).cast(f.dataType) if isinstance(f.dataType, T.BooleanType) else F.col(f"`{names[f.name]}`").cast(f.dataType)
    out = raw.select(*[cast(f).alias(f.name) for f in want])
    return out if where is None else out.where(where)


def training_log(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame:
    """A training log: header names trimmed, all values finite numbers, else an error."""
    raw = spark.read.option("header", True).csv(path)
    ok = lambda c: F.when(F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)), c).otherwise(F.raise_error(F.lit(f"{path} holds a value that is not finite")).cast("double"))
    cols = {c: (names or {}).get(c.strip(), c.strip()) for c in raw.columns}
    out = raw.select(*[ok(F.col(f"`{c}`").try_cast("double")).alias(n) for c, n in cols.items()])
    return out.withColumn("epoch", F.col("epoch").cast("int")) if "epoch" in out.columns else out


def markdown_rows(spark: SparkSession, path: str, cells: int, after: str | None = None, before: str | None = None) -> DataFrame:
    """c0, c1, ... of Markdown table rows with so many cells whose second to last are whole numbers; between two marks if given."""
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))
    if after is not None:
        text = text.where(F.col("text").contains(after)).select(F.substring_index("text", after, -1).alias("text"))
    if before is not None:
        text = text.select(F.substring_index("text", before, 1).alias("text"))
    row = r"^\s*\|\s*([^|]+?)\s*" + r"\|\s*(\d+)\s*" * (cells - 1) + r"\|\s*$"
    line = text.select(F.explode(F.split("text", "\r?\n")).alias("line")).where(F.col("line").rlike(row))
    return line.select(*[(F.regexp_extract("line", row, i + 1) if i == 0 else F.regexp_extract("line", row, i + 1).cast("long")).alias(f"c{i}") for i in range(cells)])


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; a line that does not fit the schema is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def verified_json(spark: SparkSession, path: str, files_key: str = "files") -> dict:
    """A JSON document whose map of file names to digests holds for the files beside it."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    document = json.loads(text)
    folder = path.rsplit("/", 1)[0]
    for name, digest in sorted(document.get(files_key, {}).items()):
        found = spark.read.format("binaryFile").load(f"{folder}/{name}").select(F.sha2("content", 256)).first()[0]
        if found != digest:
            raise ValueError(f"{name} has changed")
    return document
