"""Searches of a stream of queries: each micro-batch is a bounded query set. Stateless, so no watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def stream_search(queries: DataFrame, search: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Appends the hits of every micro-batch to Parquet files, one folder for each batch, so a batch that is run again overwrites its own."""

    def each(batch: DataFrame, number: int) -> None:
        search(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
