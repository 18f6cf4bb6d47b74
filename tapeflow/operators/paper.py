"""Resolution of logged predictions against later bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeflow.functions.numeric import change
from tapeflow.sources.upsert import upsert

#: Key of a logged prediction; ``month`` is the log's partition.
LOG_KEY = ("month", "symbol", "ts")
#: What resolving adds to a logged prediction.
OUTCOME = {"exit_price": "double", "actual_return": "double", "actual_label": "string", "success": "boolean"}


def log_predictions(spark: SparkSession, path: str, rows: DataFrame, version: str) -> bool:
    """Store pending predictions by month; a version is stored once, a prediction logged again replaces itself."""
    month = F.date_format("ts", "yyyy-MM")
    empty = {c: F.lit(None).cast(t) for c, t in OUTCOME.items()}
    return upsert(spark, path, rows.withColumn("month", month).withColumns(empty), LOG_KEY, "month", version)


def resolve_log(spark: SparkSession, path: str, schema: str, bars: DataFrame, as_of: Column, version: str) -> bool:
    """Write back what has come due: only months with a newly judged prediction are rewritten."""
    log = spark.read.schema(schema).parquet(path)
    pending = log.where(F.col("status") == "pending").drop(*OUTCOME)
    judged = resolve(pending, bars, as_of).where(F.col("status") != "pending")
    return upsert(spark, path, judged.select(*log.columns), LOG_KEY, "month", version)


def resolve(predictions: DataFrame, bars: DataFrame, as_of: Column) -> DataFrame:
    """Judge predictions whose horizon has passed; the rest stay pending.

    ``bars`` are daily. A target day without a bar but before the symbol's latest
    bar makes the prediction expired.
    """
    closes = bars.select("symbol", F.to_date("ts").alias("target_d"), F.col("close").alias("exit_price"))
    latest = bars.groupBy("symbol").agg(F.max(F.to_date("ts")).alias("latest_d"))
    due = F.col("resolution_ts") <= as_of
    p = predictions.withColumn("target_d", F.date_add(F.to_date("ts"), F.col("horizon_days")))
    p = p.join(closes, ["symbol", "target_d"], "left").join(latest, "symbol", "left")
    met = due & F.col("exit_price").isNotNull()
    status = (
        F.when(met, "resolved")
        .when(due & (F.col("target_d") < F.col("latest_d")), "expired")
        .otherwise("pending")
    )
    ret = F.when(met, change(F.col("exit_price"), F.col("entry_price")))
    p = p.withColumns({"status": status, "actual_return": ret}).withColumn(
        "exit_price", F.when(met, F.col("exit_price"))
    )
    label = F.when(F.col("actual_return") > F.col("buy_th"), "BUY").when(
        F.col("actual_return") < F.col("sell_th"), "SELL"
    ).otherwise("HOLD")
    p = p.withColumn("actual_label", F.when(F.col("status") == "resolved", label))
    return p.withColumn("success", F.col("actual_label") == F.col("consensus")).drop(
        "target_d", "latest_d"
    )


def accuracy(resolved: DataFrame, *keys: str) -> DataFrame:
    done = F.col("status") == "resolved"
    total, right = F.count_if(done), F.count_if(F.coalesce(F.col("success"), F.lit(False)))
    return resolved.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_predictions"),
        total.alias("total_resolved"),
        right.alias("correct_resolved"),
        F.coalesce(F.try_divide(right * 100.0, total), F.lit(0.0)).alias("accuracy_pct"),
        F.count_if(F.col("status") == "pending").alias("still_pending"),
    )
