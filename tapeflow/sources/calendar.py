"""Macro calendar: rule-based generation and the stored-calendar reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The planned events and how often they come.
EVENTS = (
    ("FOMC", 3, "six_weeks", 0),
    ("CPI", 3, "day_of_month", 12),
    ("PPI", 2, "day_of_month", 12),
    ("NFP", 3, "first_friday", 0),
    ("GDP", 3, "quarter_28th", 0),
    ("FOMC_Minutes", 2, "six_weeks", 21),
    ("Retail_Sales", 2, "day_of_month", 14),
    ("Unemployment_Claims", 2, "every_friday", 0),
)

CALENDAR_SCHEMA = (
    "date date, name string, country string, importance int, forecast double, actual double"
)


def _event_days(day: Column, rule: str, arg: int) -> Column:
    """The event date that ``day`` gives rise to, or NULL."""
    weekday = F.weekday(day)  # Monday is 0
    if rule == "day_of_month":
        return F.date_add(F.trunc(day, "month"), arg - 1)
    if rule == "first_friday":
        first = F.trunc(day, "month")
        return F.date_add(first, F.pmod(4 - F.weekday(first), F.lit(7)))
    if rule == "every_friday":
        return F.date_add(day, F.pmod(4 - weekday, F.lit(7)))
    if rule == "six_weeks":
        on = (F.pmod(F.weekofyear(day) - 1, F.lit(6)) == 0) & (weekday == 2)
        return F.when(on, F.date_add(day, arg))
    if rule == "quarter_28th":
        on = F.month(day).isin(1, 4, 7, 10) & (F.dayofmonth(day) == 28)
        return F.when(on, day)
    raise ValueError(f"unknown rule {rule!r}")


def static_calendar(span: DataFrame) -> DataFrame:
    """Planned events between ``first_day`` and ``last_day`` of a one-row frame.

    Every day of the span proposes each event once; the size is the number of days
    times the number of events, whatever the bars hold.
    """
    proposals = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.lit(weight).alias("importance"),
                _event_days(F.col("day"), rule, arg).alias("date"),
            )
            for name, weight, rule, arg in EVENTS
        ]
    )
    days = span.select(
        "first_day", "last_day",
        F.explode(F.sequence("first_day", "last_day")).alias("day"),
    )
    return (
        days.select("first_day", "last_day", F.inline(proposals))
        .where(F.col("date").between(F.col("first_day"), F.col("last_day")))
        .select("date", "name", F.lit("US").alias("country"), "importance")
        .distinct()
    )


def read_calendar(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    return in_range(spark.read.schema(CALENDAR_SCHEMA).json(path), start, end)


def in_range(calendar: DataFrame, start: str, end: str) -> DataFrame:
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    return calendar.where(F.col("date").between(lo, hi))
