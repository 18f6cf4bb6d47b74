"""A sealed segment whose every reading leaves a trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tapeflow.plans.tables import keep

ACCESS_SCHEMA = "reason string, rows bigint, first_ts timestamp_ntz, last_ts timestamp_ntz"


def open_holdout(df: DataFrame, sealed: Column, log: str, reason: str) -> DataFrame:
    """The sealed rows, stored, after one line was added to the access table under ``log``.

    The line holds what the reading really took, observed while the rows were written, so a reading can't be
    had without its trace: rows, first and last time. ``df`` needs ``ts``.
    """
    seen = Observation("holdout")
    rows = keep(df.where(sealed).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))
    took = seen.get
    line = [(reason, took["rows"], took["first_ts"], took["last_ts"])]
    df.sparkSession.createDataFrame(line, ACCESS_SCHEMA).write.mode("append").parquet(log)
    return rows


def accesses(spark: SparkSession, log: str) -> DataFrame:
    """How often each reason has opened the holdout, and the rows it read."""
    lines = spark.read.schema(ACCESS_SCHEMA).parquet(log)
    return lines.groupBy("reason").agg(
        F.count(F.lit(1)).alias("accesses"), F.sum("rows").alias("rows"), F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"))
