"""Incremental forms of the batch steps, as structured streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from terrane.operators.bronze import KEY, with_hash


def landing_stream(spark: SparkSession, path: str, schema: StructType, max_files: int = 100) -> DataFrame:
    """New landing files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)


def dedupe_stream(records: DataFrame, at: str = "fetched_at", delay: str = "1 day") -> DataFrame:
    """Records whose key (source, id, content hash) was not met within the delay; state is dropped behind the watermark."""
    return with_hash(records).withWatermark(at, delay).dropDuplicatesWithinWatermark(list(KEY))


def rate_stream(calls: DataFrame, at: str = "ts", client: str = "client_id", delay: str = "1 minute", window: str = "1 minute") -> DataFrame:
    """Calls of each client by window; late calls count until the watermark has passed."""
    return calls.withWatermark(at, delay).groupBy(F.col(client).alias("client_id"), F.window(at, window)["start"].alias("window_start")).agg(F.count("*").alias("calls"))


def run_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run a batch function over each micro-batch: once over what is there, or every so often. The function gets the batch's
    number, so that a batch done again after a failure can be recognised by its sink."""
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
