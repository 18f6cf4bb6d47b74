"""As-of joins: by day (bounded by the calendar) and by time (any number of rows)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.plans.slices import running


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    on: str,
    value_cols: Sequence[str],
    bucket: Column,
    forward: bool = False,
    out: str = "match",
) -> DataFrame:
    """Attach the latest right row at or before (``forward``: next at or after) each left row.

    Both sides are merged and ordered per (key, time bucket); the last right row of
    earlier buckets is carried in. Right rows must be unique per (key, ``on``). The
    match is a struct, so a NULL value inside the latest right row stays NULL.
    """
    payload = F.struct(*[F.col(c) for c in value_cols])
    # At equal times a right row must come first in the walking direction.
    left_side, right_side = (0, 1) if forward else (1, 0)
    lcols = [c for c in left.columns if c not in keys and c != on]
    a = left.select(*keys, on, F.lit(left_side).alias("_side"), F.struct(*lcols).alias("_l"))
    b = right.select(*keys, on, F.lit(right_side).alias("_side"), payload.alias("_r"))
    both = a.unionByName(b, allowMissingColumns=True)
    known = running(
        both, keys, [on, "_side"], bucket,
        {out: ("next" if forward else "last", F.when(F.col("_side") == right_side, F.col("_r")))},
    )
    return known.where(F.col("_side") == left_side).select(*keys, on, "_l.*", out)


def keep_last_per_day(series: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key and day: the latest entry, NULL values included."""
    last = F.max_by(F.struct("value"), F.col(order)).alias("v")
    return series.groupBy(*keys, "d").agg(last).select(*keys, "d", "v.value")


def align_days(series: DataFrame, days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Value known on each requested day: latest series row at or before it.

    ``series`` (keys, d, value) and ``days`` (keys, d) hold one row per key and day,
    so a window partition is at most a calendar long, whatever the bars weigh.
    """
    marks = series.select(*keys, "d", F.struct("value").alias("_v"), F.lit(False).alias("_want"))
    wants = days.select(*keys, "d", F.lit(True).alias("_want"))
    both = marks.unionByName(wants, allowMissingColumns=True).groupBy(*keys, "d").agg(
        F.first("_v", ignorenulls=True).alias("_v"), F.max("_want").alias("_want")
    )
    w = Window.partitionBy(*keys).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    known = both.withColumn("_k", F.last("_v", ignorenulls=True).over(w))
    return known.where(F.col("_want")).select(*keys, "d", F.col("_k.value").alias("value"))


def bar_days(bars: DataFrame) -> DataFrame:
    return bars.select(F.to_date("ts").alias("d")).distinct()
