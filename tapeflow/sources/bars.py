"""Price-bar sources: landing, paged history, ticks to bars, latest slice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeflow.functions.times import from_millis

BAR_COLS = ("open", "high", "low", "close", "volume")

BAR_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        *[T.StructField(c, T.DoubleType()) for c in BAR_COLS],
    ]
)

# Exchange rows as delivered: milliseconds since epoch, then OHLCV.
RAW_BAR_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("ms", T.LongType()),
        *[T.StructField(c, T.DoubleType()) for c in BAR_COLS],
    ]
)


def land_bars(raw: DataFrame, source: str = "crypto") -> DataFrame:
    """Typed bars from delivered rows, with the symbol and source as columns."""
    return raw.select(
        "symbol",
        F.lit(source).alias("source"),
        from_millis(F.col("ms")).alias("ts"),
        *[F.col(c).cast("double").alias(c) for c in BAR_COLS],
    )


def merge_pages(pages: DataFrame, source: str = "crypto") -> DataFrame:
    """One history from overlapping pages: the earliest page wins for each bar time.

    A min over a struct combines map-side, so a hot symbol never lands in one task.
    """
    first = F.min(F.struct("page", *BAR_COLS))
    kept = pages.groupBy("symbol", "ms").agg(first.alias("b"))
    return land_bars(kept.select("symbol", "ms", *[f"b.{c}" for c in BAR_COLS]), source)


def ticks_to_bars(ticks: DataFrame, width: str) -> DataFrame:
    """Bars from ticks(symbol, ts, seq, price, size); ``seq`` is a number that orders a bar's ticks.

    All five measures are plain aggregates over fixed-width values, so a hash
    aggregate shrinks the data before the shuffle, without sorting it, and the
    shuffle key (symbol, bar) spreads a hot symbol.
    """
    return (
        ticks.groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(
            F.min_by("price", "seq").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "seq").alias("close"),
            F.sum("size").cast("double").alias("volume"),
        )
        .select("symbol", F.col("w.start").alias("ts"), *BAR_COLS)
    )


def latest_bars(bars: DataFrame, n: int = 168) -> DataFrame:
    """The newest ``n`` bars of each symbol.

    The rank filter turns into a per-task group limit before the shuffle, so at most
    ``n`` rows per symbol and task are moved.
    """
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("ts").desc()))
    return bars.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")
