"""Form processing has no operator of its own for streams; arrivals() feeds the batch operators from one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def arrivals(spark: SparkSession, directory: str, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each batch of files that arrive in a directory (path, modificationTime, length, content) to a batch operator, once."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "*.[pP][dD][fF]").load(directory)
    return files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
