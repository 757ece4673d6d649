"""Structured Streaming over the same plans: files in, upserted or appended tables out.

The engine's operators are batch plans; a stream runs them on each micro-batch, and
windowed counts use watermarks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def windowed_agg(stream: DataFrame, time: str, width: str, by: list[str], *aggregates, late: str = "10 minutes") -> DataFrame:
    """Tumbling windows; rows later than ``late`` are dropped by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(*aggregates)


def for_each(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """``work`` gets each micro-batch and its number; a number seen again is the same batch again."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(work)
    return (writer.trigger(availableNow=True) if once else writer).start()


def append(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
