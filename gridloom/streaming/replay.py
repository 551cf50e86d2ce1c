"""Re-running a batch query whenever boxes arrive: the index is rebuilt each time, as it has no insertion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def each_batch(stream: DataFrame, query: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]):
    """Start a stream whose every micro-batch of boxes goes through query, and its result to sink."""
    return stream.writeStream.foreachBatch(lambda df, epoch: sink(query(df), epoch)).start()
