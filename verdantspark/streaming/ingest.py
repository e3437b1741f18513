"""Micro-batch ingestion of results, in place of batches started by hand: an extension, not a port."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import append_new


def ingest(results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch of a stream of result rows to a CSV folder, without ids that are there; all that waits is
    taken, then the query ends."""
    return results.writeStream.foreachBatch(lambda batch, _: append_new(batch.dropDuplicates(["id"]), path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
