"""An extra: ingestion of record files as they arrive.  The operators it calls are those of batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.schemas import AGENDA


def stream_agenda(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Calls ``handle(records, batch)`` for the new files of each trigger; ends when all that is there has been read.

    A batch can come twice after a failure; upserts by record id and payload make that harmless.
    """
    records = spark.readStream.schema(AGENDA).json(folder)
    return records.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
