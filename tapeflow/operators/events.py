"""Macro-calendar features of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.plans.slices import over_slices


def event_days(calendar: DataFrame) -> DataFrame:
    """One row per event day. Among events of one day the first by name stands for it."""
    return calendar.groupBy("date").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.max("importance").alias("top"),
        F.min_by("importance", "name").alias("lead"),
        F.avg(F.col("actual") - F.col("forecast")).alias("surprise"),
    )


def next_event(days: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted day the next event day at or after it. Bounded by the calendar."""
    both = wanted.select("date", F.lit(True).alias("_want")).unionByName(
        days.select("date", F.struct(F.col("date").alias("next_date"), "lead").alias("_e")),
        allowMissingColumns=True,
    ).groupBy("date").agg(F.max("_want").alias("_want"), F.first("_e", True).alias("_e"))
    w = (
        Window.partitionBy(F.lit(0))
        .orderBy(F.col("date").desc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    known = both.withColumn("_n", F.last("_e", ignorenulls=True).over(w))
    return known.where(F.col("_want")).select("date", "_n.next_date", "_n.lead")


def add_events(bars: DataFrame, calendar: DataFrame | None, rows: int = 16384) -> DataFrame:
    """Days to the next event, its weight, events of the day, and yesterday's surprise.

    Planned dates are public, so looking ahead to them is no leak; outcomes show one
    bar later. Without a calendar the columns are neutral. Needs ``rn``.
    """
    if calendar is None:
        return bars.withColumns(
            {
                "bars_to_next_event": F.lit(-1.0),
                "last_event_surprise": F.lit(0.0),
                "event_importance": F.lit(0.0),
                "event_day_flag": F.lit(0).cast("long"),
            }
        )
    days = event_days(calendar)
    # A bar inside a day can only wait for the next midnight.
    midnight = F.col("ts") == F.to_date("ts").cast("timestamp_ntz")
    bars = bars.withColumn(
        "date", F.when(midnight, F.to_date("ts")).otherwise(F.date_add(F.to_date("ts"), 1))
    )
    ahead = next_event(days, bars.select("date").distinct())
    exact = days.select(F.col("date").cast("timestamp_ntz").alias("ts"), "n_events", "top", "surprise")
    joined = bars.join(ahead, "date", "left").join(exact, "ts", "left")
    wait = F.datediff("next_date", "date").cast("double")
    joined = joined.withColumns(
        {
            "bars_to_next_event": F.coalesce(wait, F.lit(-1.0)),
            "event_importance": F.coalesce("top", "lead", F.lit(0)).cast("double"),
            "event_day_flag": F.coalesce("n_events", F.lit(0)).cast("long"),
            "_s": F.coalesce("surprise", F.lit(0.0)),
        }
    )

    def shift(df, w):
        return df.withColumn("last_event_surprise", F.coalesce(F.lag("_s").over(w), F.lit(0.0)))

    out = over_slices(joined, ["symbol"], [shift], 1, rows=rows)
    return out.drop("date", "next_date", "lead", "n_events", "top", "surprise", "_s")
