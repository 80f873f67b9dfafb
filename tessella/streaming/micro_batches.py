"""Applying an operator to the micro-batches of a stream.

The operators here sort and cut whole tables, which has no meaning for an unbounded one; what can be done is to apply them
to each micro-batch and append the results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def apply_to_batches(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that writes ``operator`` of every micro-batch as Parquet, each under its own ``epoch=`` folder.

    A micro-batch that is run again after a failure replaces its folder, so its rows are written once.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
