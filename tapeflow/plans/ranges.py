"""Ranges of a series with about the same number of rows, whatever the skew.

Buckets of time or quantity hold as many rows as happen to fall into them. Here Spark's range
partitioner samples the keys and the order and cuts where the rows are: a busy symbol or a burst
gets many ranges, quiet symbols share one. A range is numbered along the order, so it serves as
the ``bucket`` of ``number_rows`` and ``running``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.plans.slices import RN
from tapeflow.plans.tables import keep

RANGE = "_range"
ROWS = 16384
#: The range of a key that is short enough for one task.
WHOLE = -1


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = ROWS) -> DataFrame:
    """Stored rows with ``_range``, a number that grows along (keys, order); about ``rows`` rows in each.

    ``order`` must be unique per key. Pass a stored table: its rows are counted first. The result is
    written, since the sample that cuts the ranges may come out differently another time.
    """
    n = max(1, -(-df.count() // rows))
    cut = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    return keep(cut.withColumns({RANGE: F.spark_partition_id().cast("long"), "_at": F.monotonically_increasing_id()}))


def ranged_if_long(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = ROWS) -> DataFrame:
    """Rows with ``_range``: ``WHOLE`` for keys of at most ``rows`` rows, else as in ``ranged``.

    A short key needs no cutting, so its rows are neither shuffled nor written here. Long keys are at most
    one per ``rows`` rows, so their table is broadcast. Pass a stored table or a projection of one: it is
    read several times. Rows without a key are dropped.
    """
    df = df.na.drop(subset=list(keys))
    long = keep(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows).select(*keys))
    if not long.head(1):
        return df.withColumn(RANGE, F.lit(WHOLE).cast("long"))
    short = df.join(F.broadcast(long), list(keys), "left_anti").withColumn(RANGE, F.lit(WHOLE).cast("long"))
    cut = ranged(df.join(F.broadcast(long), list(keys), "left_semi"), keys, order, rows).drop("_at")
    return short.unionByName(cut)


def number_ranged(df: DataFrame, keys: Sequence[str], name: str = RN, total: str | None = None) -> DataFrame:
    """Position of each row of a ``ranged`` table within its key, from 0, and optionally the key's row count.

    Rows lie in order already, so a position is arithmetic on the row's place in its range; no window
    sorts rows again. The table of ranges is as small as it is short.
    """
    ends = df.groupBy(*keys, RANGE).agg(F.min("_at").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    cols = [(F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_lo")).alias("_off")]
    if total:
        cols.append(F.sum("_n").over(whole).alias(total))
    return df.join(ends.select(*keys, RANGE, *cols), [*keys, RANGE]).withColumn(
        name, F.col("_at") + F.col("_off")).drop("_off", "_at")
