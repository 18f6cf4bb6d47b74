"""Backfills in steps of event time: no row is late, no step holds more than a few files.

A stream takes files as they landed, and files of a backfill landed in no order of time. Here a
table of the files' first and last times (the manifest) is cut into steps. A step is a span of
time that no file admitted later can reach into: it ends where the earliest file that is not yet
admitted begins. It reads the files that overlap it and takes from them the rows inside it.
So each step is complete when it runs, a watermark is not needed, and files with a common time
cost a second read rather than rows. The steps run as batches of a streaming query, whose
checkpoint says which are done.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.utils import AnalysisException

from tapeflow.functions.book import BOOK, BookRules
from tapeflow.functions.times import epoch_seconds, from_seconds
from tapeflow.operators.book import signals
from tapeflow.plans.tables import keep, scratch
from tapeflow.sources.bars import ticks_to_bars
from tapeflow.streaming.bars import TICK_SCHEMA
from tapeflow.streaming.books import BOOK_SCHEMA, track_batch

Step = Callable[[DataFrame, int], None]


def manifest(spark: SparkSession, path: str, schema: str, time: str = "ts") -> DataFrame:
    """(file, rows, first, last) of the Parquet files under ``path``; only the time column is read.

    Rows without a time can't be put in order; they are not counted and not admitted.
    """
    rows = spark.read.schema(schema).parquet(path).where(F.col(time).isNotNull())
    return rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(time).alias("first"), F.max(time).alias("last"))


def plan_steps(files: DataFrame, per_step: int, width_seconds: int | None = None) -> DataFrame:
    """(step, since, upto, files): half-open spans of time and the files that reach into them.

    The files' first times in order, every ``per_step``-th of them, are the cuts; with a width they are
    lowered to its multiples, so that no bar lies in two steps. The last span is open. All windows here
    run over the table of files.
    """
    if per_step < 1:
        raise ValueError("a step needs at least one file")
    turn = F.row_number().over(Window.orderBy("first", "file")) - 1
    cut: Column = F.col("first")
    if width_seconds:
        cut = from_seconds(F.floor(epoch_seconds(cut) / width_seconds) * width_seconds)
    cuts = files.withColumn("_turn", turn).where(F.col("_turn") % per_step == 0).select(cut.alias("since")).distinct()
    by_time = Window.orderBy("since")
    steps = cuts.select((F.row_number().over(by_time) - 1).cast("long").alias("step"), "since", F.lead("since").over(by_time).alias("upto"))
    # The steps that hold a file's first and last time: the last cut at or before each.
    ends = F.inline(F.array(*[F.struct(F.col(c).alias("at"), F.lit(c).alias("end")) for c in ("first", "last")]))
    marks = files.select("file", ends).unionByName(
        steps.select(F.col("since").alias("at"), F.col("step")), allowMissingColumns=True)
    upto_here = Window.orderBy("at", F.col("step").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    held = marks.withColumn("step", F.last("step", ignorenulls=True).over(upto_here)).where(F.col("file").isNotNull())
    spans = held.groupBy("file").agg(F.min("step").alias("lo"), F.max("step").alias("hi"))
    reach = spans.select("file", F.explode(F.sequence("lo", "hi")).alias("step"))
    reach = reach.groupBy("step").agg(F.sort_array(F.collect_list("file")).alias("files"))
    return steps.join(reach, "step")


def backfill(
    spark: SparkSession, path: str, schema: str, root: str, process: Step, per_step: int = 100,
    time: str = "ts", width_seconds: int | None = None,
) -> StreamingQuery:
    """Run ``process(rows, step)`` for every step of the files under ``path``, in order of time.

    ``root`` keeps the plan, the checkpoint and the count of rows of each step (``admitted``). Started again, it
    goes on after the last step that was finished; ``process`` must leave the same when a step is
    run twice. Files that land after the plan was made are left to the live stream.
    """
    plan = _stored(spark, f"{root}/plan", lambda: plan_steps(keep(manifest(spark, path, schema, time)), per_step, width_seconds))
    n = plan.count()
    # A ticket a step: the query's batches count the steps, whatever order the tickets come in.
    _stored(spark, f"{root}/tickets", lambda: spark.range(0, max(n, 1), 1, max(n, 1)))

    def run(_: DataFrame, number: int) -> None:
        step = plan.where(F.col("step") == number).first()
        if step is None:
            return
        rows = spark.read.schema(schema).parquet(*map(unquote, step["files"])).where(F.col(time) >= F.lit(step["since"]))
        if step["upto"] is not None:
            rows = rows.where(F.col(time) < F.lit(step["upto"]))
        with scratch():
            rows = keep(rows)
            process(rows, number)
            rows.agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{root}/admitted/step={number}")

    tickets = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{root}/tickets")
    return tickets.writeStream.foreachBatch(run).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()


def _stored(spark: SparkSession, folder: str, make: Callable[[], DataFrame]) -> DataFrame:
    try:
        return spark.read.parquet(folder)
    except AnalysisException:
        make().write.parquet(folder)
        return spark.read.parquet(folder)


def lost_rows(spark: SparkSession, path: str, schema: str, root: str, time: str = "ts") -> int:
    """Rows of the planned files that no step has admitted; 0 after a whole backfill."""
    planned = spark.read.parquet(f"{root}/plan").select(F.explode("files").alias("file")).distinct()
    there = manifest(spark, path, schema, time).join(planned, "file", "left_semi").agg(F.sum("rows")).first()[0] or 0
    return there - (spark.read.parquet(f"{root}/admitted").agg(F.sum("rows")).first()[0] or 0)


def newest(spark: SparkSession, path: str, schema: str, time: str = "ts") -> object:
    """The last time in the files; what a live stream's watermark would follow."""
    return manifest(spark, path, schema, time).agg(F.max("last")).first()[0]


def whole_seconds(width: str) -> int:
    """Seconds of a width such as ``1 hour``."""
    number, unit = width.split()
    scale = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}[unit.rstrip("s")]
    return math.floor(float(number) * scale)


def backfill_tracker(
    spark: SparkSession, path: str, out: str, root: str, rules: BookRules = BOOK, per_step: int = 100, rows: int = 16384
) -> StreamingQuery:
    """Tracker rows of landed books; a live ``track`` over the same states folder goes on from there."""
    def process(books: DataFrame, step: int) -> None:
        track_batch(signals(books, rules), step, out, f"{root}/states", rules, rows)

    return backfill(spark, path, BOOK_SCHEMA, root, process, per_step)


def backfill_records(
    spark: SparkSession, path: str, out: str, root: str, rules: BookRules = BOOK, per_step: int = 100
) -> StreamingQuery:
    """Signal rows of landed books, once per symbol and time: equal times always meet in one step."""
    def process(books: DataFrame, step: int) -> None:
        signals(books, rules).dropDuplicates(["symbol", "ts"]).write.mode("overwrite").parquet(f"{out}/batch={step}")

    return backfill(spark, path, BOOK_SCHEMA, root, process, per_step)


def backfill_bars(
    spark: SparkSession, path: str, out: str, root: str, width: str = "1 hour", delay: str = "2 minutes", per_step: int = 100
) -> StreamingQuery:
    """Bars of landed ticks. Steps end between bars; a bar that a watermark of ``delay`` would not have closed stays out."""
    seconds = whole_seconds(width)
    last = newest(spark, path, TICK_SCHEMA)

    def process(ticks: DataFrame, step: int) -> None:
        closed = epoch_seconds(F.col("ts")) + F.lit(seconds + whole_seconds(delay)) <= epoch_seconds(F.lit(last))
        ticks_to_bars(ticks, width).where(closed).write.mode("overwrite").parquet(f"{out}/batch={step}")

    return backfill(spark, path, TICK_SCHEMA, root, process, per_step, width_seconds=seconds)
