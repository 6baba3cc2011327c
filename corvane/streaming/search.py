"""Queries as a stream over a static index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def search_stream(queries: DataFrame, search: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Every micro-batch of the streaming queries runs the batch search and goes to the sink with its number.

    The index is a table, so batches do not depend on each other; the sink
    should write by batch number to be safe against a batch that runs twice.
    Without seconds, what is there is processed and the stream ends.
    """

    def batch(frame: DataFrame, number: int) -> None:
        sink(search(frame), number)

    writer = queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()
