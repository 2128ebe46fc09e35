"""Written intermediates that pass, Arrow work of bounded batches, and a bounded row filter."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm import _bytes as B
from fieldglass.plans.scratch import partitions, remove, shared_dir, swept

__all__ = ["free_name", "heavy", "mapped", "marked", "might_contain", "partitions", "passing", "split_join", "stage", "unpacked"]

#: The row filter's bits: 2**25 bits are at most 1024 rows of 4 KiB.
FILTER_BITS = 25

_PASSING: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


@contextmanager
def passing(spark: SparkSession):
    """Tables staged inside are deleted at the end, but for lasting ones."""
    mine: list[str] = []
    token = _PASSING.set((*_PASSING.get(), mine))
    try:
        yield
    finally:
        _PASSING.reset(token)
        for path in mine:
            remove(spark, path)


#: Writers hold a row group of each task whole, and pages of a hundred rows
#: at least unless told otherwise; with packed rows that would be much.
WRITE = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 4, "parquet.block.size.row.check.min": 4}


def stage(df: DataFrame, label: str, lasting: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    ``lasting``: how many of the innermost ``passing`` blocks the table outlives.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    with swept(spark):
        df.write.options(**WRITE).parquet(path)
    B.tidy()  # what the driver's models left
    blocks = _PASSING.get()
    blocks = blocks[: max(0, len(blocks) - lasting)]
    if blocks:
        blocks[-1].append(path)
    return spark.read.schema(schema).parquet(path)


#: Bytes of an Arrow batch; a longer row is a batch of its own.
BATCH_BYTES = 2 << 20


def mapped(df: DataFrame, work, schema) -> DataFrame:
    """mapInArrow whose workers hand back freed memory at the end of a task.

    Sets the session's bound on the bytes of a batch, for both sides of the
    pipe hold whole batches: ten thousand texts may be 64 MB.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(B.released(work), schema)


def packed(df: DataFrame) -> Column:
    """The caller's whole row as one value, so that no name of it can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def unpacked(df: DataFrame, row: str = "row") -> list[Column]:
    """The columns of ``df`` out of a packed row."""
    return [F.col(row)[c].alias(c) for c in df.columns]


def marked(big: DataFrame, key: Column, small: DataFrame, small_key: Column, bits: int = FILTER_BITS) -> DataFrame:
    """(row, key, may): ``big``'s packed rows, their keys, and whether the key may be among ``small``'s keys.

    A bitmap of 2**bits hash positions is aggregated in Spark and joined by
    broadcast: at most 2**bits / 32768 rows of 4 KiB whatever the inputs'
    sizes, so the bound holds at any scale.  False positives only let more
    rows through; an exact join must follow.
    """
    h = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    maps = (
        small.select(h(small_key).alias("h"))
        .groupBy(F.bitmap_bucket_number("h").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
    )
    probe = big.select(packed(big).alias("row"), key.alias("key")).withColumn("h", h(F.col("key"))).withColumn("bucket", F.bitmap_bucket_number("h"))
    pos = F.bitmap_bit_position("h")
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(pos / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, (pos % 8).cast("int")).bitwiseAND(F.lit(1))
    return probe.join(F.broadcast(maps), "bucket", "left").select("row", "key", F.coalesce(bit == 1, F.lit(False)).alias("may"))


def might_contain(big: DataFrame, key: Column, small: DataFrame, small_key: Column, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of ``big`` whose key may be among ``small``'s keys; see ``marked``."""
    return marked(big, key, small, small_key, bits).where("may").select(*unpacked(big))


def heavy(total: int) -> int:
    """A key with more rows than this, of ``total``, is dealt over several tasks; at most 256 keys are."""
    return max(1024, total // 256)


def split_join(big: DataFrame, small: DataFrame, hot: int) -> DataFrame:
    """``big`` (with a key k) with the value v that ``small`` (k, v, n) has for it, or null.

    n is the number of the key's rows.  Keys of more than ``hot`` rows are
    broadcast (few, see ``heavy``), the others joined by a shuffle.
    """
    busy = F.broadcast(small.where(F.col("n") > hot).select("k", F.col("v").alias("busy")))
    seen = big.join(busy, "k", "left")
    cold = seen.where("busy is null").drop("busy").join(small.where(F.col("n") <= hot).select("k", "v"), "k", "left")
    return cold.unionByName(seen.where("busy is not null").withColumnRenamed("busy", "v"))


def free_name(name: str, taken: list[str]) -> str:
    """``name`` with underscores behind it until no column has it, whatever the letters' case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name
