"""Order-book streams: recording signals and tracking state per symbol.

The stateless part (book to signal row) is the same projection as in batch. The tracker
keeps (smoothed imbalance, state, last time) per symbol as a table per batch, and each batch
is the batch tracker started from that table: no symbol's rows meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tapeflow.functions.book import BOOK, BookRules
from tapeflow.functions.times import from_instant, to_instant
from tapeflow.operators.book import signals
from tapeflow.operators.book import track as track_history
from tapeflow.plans.tables import drop_folder, keep, scratch
from tapeflow.sources.snapshots import LEVELS

BOOK_SCHEMA = f"symbol string, ts timestamp_ntz, bids {LEVELS}, asks {LEVELS}"
TRACK_SCHEMA = (
    "symbol string, ts timestamp_ntz, raw_imbalance double, smoothed double, state string, "
    "confidence double, reliable boolean"
)
STATE_SCHEMA = "symbol string, ema double, held string, last_ts timestamp_ntz"
_TRACKED = [f.split()[0] for f in TRACK_SCHEMA.split(", ")]


def landed(spark: SparkSession, path: str, schema: str, files_per_batch: int | None) -> DataFrame:
    """A stream of landed Parquet files.

    Files of a landed table are in no order of time. Taken a few at a time, rows of a later
    batch would be older than the state or the watermark and be lost. ``streaming.backfill``
    admits them in order of time instead, a bounded number at once; without it a backfill takes
    all files there are in one batch. ``files_per_batch`` is for live folders, where files
    arrive in order; what is late there is dropped and counted (``late_rows``).
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def late_rows(query: StreamingQuery) -> int:
    """Rows the watermark has dropped so far, as far as the query's progress reports go back."""
    ops = (op for p in query.recentProgress for op in p["stateOperators"])
    return sum(op.get("numRowsDroppedByWatermark", 0) for op in ops)


def read_books(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    return landed(spark, path, BOOK_SCHEMA, files_per_batch)


def record(
    books: DataFrame, path: str, checkpoint: str, rules: BookRules = BOOK, delay: str = "2 minutes",
    available_now: bool = False, every: str = "60 seconds",
) -> StreamingQuery:
    """Append signal rows as they come; a snapshot delivered twice is written once."""
    rows = signals(books, rules).withColumn("at", to_instant(F.col("ts"))).withWatermark("at", delay)
    rows = rows.dropDuplicatesWithinWatermark(["symbol", "at"]).drop("at")
    return _start(rows, path, checkpoint, available_now, every)


def _start(rows, path, checkpoint, available_now, every) -> StreamingQuery:
    writer = (
        rows.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).outputMode("append")
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return writer.trigger(**trigger).start()


def advance(
    signal_rows: DataFrame, state: DataFrame | None, rules: BookRules = BOOK, rows: int = 16384
) -> tuple[DataFrame, DataFrame]:
    """Tracker rows of one batch and the state after it, from the state before it.

    The batch tracker does the work, so a symbol's batch is spread over ranges of ``rows`` rows.
    Smoothing is an affine step and stickiness a step among three states; both carry over a
    batch's start as one more row per symbol: the smoothed value so far, with the state it holds.
    A snapshot not newer than the last one seen changes nothing and is left out, as is a second
    one at the same time.
    """
    slim = signal_rows.select("symbol", "ts", "imbalance", "reliable")
    spare = F.struct("imbalance", "reliable")
    slim = slim.groupBy("symbol", "ts").agg(F.max(spare).alias("_s")).select("symbol", "ts", "_s.*")
    slim = slim.withColumns({"given": F.lit(None).cast("string"), "fresh": F.lit(True)})
    if state is not None:
        slim = slim.join(state.select("symbol", "last_ts"), "symbol", "left").where(
            F.col("last_ts").isNull() | (F.col("ts") > F.col("last_ts"))).drop("last_ts")
        seeds = state.where(F.col("ema").isNotNull()).select(
            "symbol", F.col("last_ts").alias("ts"), F.col("ema").alias("imbalance"), F.lit(True).alias("reliable"),
            F.col("held").alias("given"), F.lit(False).alias("fresh"))
        slim = slim.unionByName(seeds.join(slim.select("symbol").distinct(), "symbol", "left_semi"))
    out = keep(track_history(keep(slim), rules, rows, "given"))
    now = out.select("symbol", "ts", "reliable", "smoothed", "state")
    if state is not None:
        none = F.lit(None)
        quiet = state.select("symbol", F.col("last_ts").alias("ts"), F.col("ema").isNotNull().alias("reliable"),
                             F.col("ema").alias("smoothed"), F.coalesce("held", none.cast("string")).alias("state"))
        now = now.union(quiet)
    solid = F.when(F.col("reliable"), F.struct("ts", "smoothed", "state"))
    after = now.groupBy("symbol").agg(F.max(solid).alias("_s"), F.max("ts").alias("last_ts")).select(
        "symbol", F.col("_s.smoothed").alias("ema"), F.col("_s.state").alias("held"), "last_ts")
    fresh = out.where("fresh").select(*_TRACKED)
    return fresh, after


def track_batch(
    signal_rows: DataFrame, batch: int, path: str, states: str, rules: BookRules = BOOK, rows: int = 16384
) -> None:
    """Advance by one batch: rows to ``path/batch=N``, the state after it to ``states/batch=N``.

    Both folders are overwritten, so a batch that is run again after a failure leaves the same.
    States older than the one before are dropped.
    """
    spark = signal_rows.sparkSession
    before = spark.read.schema(STATE_SCHEMA).parquet(f"{states}/batch={batch - 1}") if batch else None
    with scratch():
        fresh, after = advance(keep(signal_rows), before, rules, rows)
        fresh.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        after.write.mode("overwrite").parquet(f"{states}/batch={batch}")
    if batch > 1:
        drop_folder(spark, f"{states}/batch={batch - 2}")


def track(
    books: DataFrame, path: str, checkpoint: str, rules: BookRules = BOOK,
    available_now: bool = False, every: str = "60 seconds", rows: int = 16384,
) -> StreamingQuery:
    """Tracker rows of a stream of books; the checkpoint holds the stream's place, its sibling the states."""
    def step(batch: DataFrame, number: int) -> None:
        track_batch(signals(batch, rules), number, path, f"{checkpoint}-states", rules, rows)

    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return books.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_tracked(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRACK_SCHEMA).parquet(path).select(*_TRACKED)


def per_bar_walls(signal_rows: DataFrame, width: str = "1 hour", delay: str = "2 minutes") -> DataFrame:
    """Mean wall count per symbol and closed time window."""
    return (
        signal_rows.withColumn("at", to_instant(F.col("ts"))).withWatermark("at", delay)
        .groupBy("symbol", F.window("at", width).alias("w"))
        .agg(F.avg(F.col("bid_walls") + F.col("ask_walls")).alias("wall_persistence"))
        .select("symbol", from_instant(F.col("w.end")).alias("ts"), "wall_persistence")
    )
