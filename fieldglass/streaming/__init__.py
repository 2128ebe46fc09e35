"""Structured Streaming forms of operators that need no state beyond a row.

The reference has no streams; matching is stateless per image, so it runs on
micro-batches unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def each_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Apply ``work`` to each micro-batch and append its rows; a batch is written once.

    The batch's number names its folder, so a batch that is run again after a
    failure replaces its own rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
