"""CSV, JSON and JSON-lines files, each one part that its reader finds under the given name."""

from __future__ import annotations

import json
import math
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file on any file system that Spark knows."""
    p, fs, _ = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def flat(df: DataFrame) -> DataFrame:
    """Nested values as JSON text with sorted keys, flags as True and False."""

    def cell(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            return F.initcap(c.cast("string"))
        if isinstance(f.dataType, T.StructType):
            keys = sorted(f.dataType.names)
            return F.to_json(F.struct(*[c[k].alias(k) for k in keys]), {"ignoreNullFields": "false"})
        if isinstance(f.dataType, T.MapType):
            return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
        return F.to_json(c) if isinstance(f.dataType, T.ArrayType) else c

    return df.select(*[cell(f).alias(f.name) for f in df.schema.fields])


def csv(df: DataFrame, path: str, columns: list[str] | None = None, need_rows: bool = False) -> None:
    """A folder of CSV with a header; ``columns``: those to write, in order; ``need_rows``: an empty table is an error."""
    if need_rows and df.isEmpty():
        raise ValueError(f"no rows for {path}")
    flat(df.select(*[f"`{c}`" for c in columns]) if columns else df).coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def finite_text(value: Any) -> Any:
    """Numbers that are not finite as text, and keys as text, however deep."""
    if isinstance(value, dict):
        return {str(k): finite_text(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [finite_text(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return "nan" if math.isnan(value) else "infinity" if value > 0 else "-infinity"
    return value


def document(spark: SparkSession, value: Any, path: str) -> None:
    """JSON, two blanks a level, keys sorted; a number that is not finite is an error."""
    write_text(spark, path, json.dumps(value, indent=2, sort_keys=True, allow_nan=False, ensure_ascii=False) + "\n")


def json_lines(df: DataFrame, path: str) -> None:
    """JSON lines that read back to the very rows, else an error.

    The rows are counted and their hashes added up in the job that writes
    them, and once more as they are read back: nothing is shuffled, and the input is read once.
    """

    def sums(d: DataFrame) -> list[Column]:
        text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in d.columns]), {"ignoreNullFields": "false"})
        add = lambda h: F.sum(h.cast("decimal(38,0)"))
        return [F.count(F.lit(1)).alias("rows"), add(F.xxhash64(text)).alias("one"), add(F.xxhash64(F.lit(1), text)).alias("two")]

    seen = Observation(f"json-lines-{uuid.uuid4().hex}")
    df.observe(seen, *sums(df)).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    back = df.sparkSession.read.schema(df.schema).json(path)
    if back.agg(*sums(back)).first().asDict() != seen.get:
        raise ValueError(f"{path} does not read back")


def batches(reports: DataFrame, path: str) -> None:
    """One CSV row for each batch of nested reports (condition, batches: array of structs)."""
    rows = reports.select(*[c for c in reports.columns if c != "batches"], F.posexplode("batches").alias("batch_index", "batch"))
    csv(rows.select(*[c for c in rows.columns if c != "batch"], "batch.*"), path)
