"""Bars from a stream of ticks: a bar is written once its window has closed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tapeflow.functions.times import from_instant, to_instant
from tapeflow.sources.bars import ticks_to_bars
from tapeflow.streaming.books import landed

TICK_SCHEMA = "symbol string, ts timestamp_ntz, seq bigint, price double, size double"


def read_ticks(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    return landed(spark, path, TICK_SCHEMA, files_per_batch)


def stream_bars(ticks: DataFrame, width: str = "1 hour", delay: str = "2 minutes") -> DataFrame:
    """The batch aggregation under a watermark; ticks later than ``delay`` are dropped."""
    timed = ticks.withColumn("ts", to_instant(F.col("ts"))).withWatermark("ts", delay)
    return ticks_to_bars(timed, width).withColumn("ts", from_instant(F.col("ts")))


def write_bars(
    bars: DataFrame, path: str, checkpoint: str, available_now: bool = False,
    every: str = "60 seconds",
) -> StreamingQuery:
    writer = (
        bars.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).outputMode("append")
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return writer.trigger(**trigger).start()
