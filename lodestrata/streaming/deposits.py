"""New deposits as a stream: the pipeline is a batch job, so this is the one entry that streams feed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestrata.operators import deposits as dep


def stream(source: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch of (r, c, ord, rank, ...) reaches handle with one deposit for each cell.

    A batch that is run again after a failure has the same id, so handle can skip it."""

    def once(batch: DataFrame, number: int) -> None:
        handle(dep.dedupe(batch), number)

    return source.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
