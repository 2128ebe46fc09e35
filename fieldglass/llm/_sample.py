"""Bounded, deterministic samples of labelled rows for training."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm._shared import mapped


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the identifier's text, modulo ``modulus``; null for null."""
    return F.crc32(doc_id.cast("string")) % modulus


def held_out(doc_id: Column, modulus: int, fold: int) -> Column:
    return F.coalesce(remainder(doc_id, modulus) == fold, F.lit(False))


def bounded(ids: DataFrame, most: int, *keep: str) -> DataFrame:
    """At most ``most`` rows, the first by a hash of doc_id."""
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))
    return ids.where("doc_id is not null").select("doc_id", *keep, order.alias("_o")).orderBy("_o", "doc_id", *keep).limit(most).select("doc_id", *keep)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of a bounded sample; ids is at most some thousand rows."""
    return docs.join(F.broadcast(ids), "doc_id")


def fitted(sample: DataFrame, fit: Callable[[list[dict]], object]) -> object | None:
    """``fit`` of all rows of a bounded sample, worked out in one task, so the driver holds the model alone; None without rows."""

    def work(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], ["model"])

    got = mapped(sample.repartition(1), work, "model binary").collect()
    return pickle.loads(bytes(got[0]["model"])) if got else None
