"""Null-safe arithmetic. Missing is NULL everywhere; NaN and infinities never survive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def div(a: Column, b: Column) -> Column:
    """a / b in doubles, NULL when b is zero (ANSI division would raise)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def finite(c: Column) -> Column:
    """NULL in place of NaN and the infinities."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None).cast("double")).otherwise(c)


def clean_inf(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in cols})


def clip(c: Column, lo, hi) -> Column:
    """Bound a value; NULL stays NULL (``greatest``/``least`` alone would skip it)."""
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.when(c.isNotNull(), F.greatest(lo, F.least(hi, c)))


def zero_fill(c: Column) -> Column:
    return F.coalesce(finite(c), F.lit(0.0))


def change(c: Column, prev: Column) -> Column:
    """Relative change against an earlier value."""
    return div(c, prev) - F.lit(1.0)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation from moments over pairwise-complete rows.

    NULL instead of an error when one side is constant. That is told by its extremes: moments merged from
    many partitions leave a deviation of rounding errors for equal values.
    """
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    varies = (F.min(xs) < F.max(xs)) & (F.min(ys) < F.max(ys))
    return F.when(varies, div(F.covar_samp(xs, ys), F.stddev_samp(xs) * F.stddev_samp(ys)))
