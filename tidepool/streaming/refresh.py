"""Structured Streaming over tables of changed notes: each micro-batch brings the vector index up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidepool.operators.index import VectorIndex


def refresh_on_change(changes: DataFrame, snapshot: Callable[[], tuple[DataFrame, DataFrame]], index: VectorIndex, profile: str, embed: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Run the index refresh whenever ``changes`` brings rows; ``snapshot`` gives the notes and chunks as they are then.

    The refresh is a function of the snapshot alone, so a batch that is run again changes nothing.
    """

    def batch(rows: DataFrame, _: int) -> None:
        if rows.take(1):
            index.refresh(*snapshot(), profile, embed)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
