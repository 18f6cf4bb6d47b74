"""Windowed building blocks that work over any window spec with a total row order.

A trailing value is NULL until enough non-null inputs are in the frame, so every
helper gates on ``count``. Exponential smoothing is written as a running weighted
sum, which Spark evaluates in one pass per window without leaving the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tapeflow.functions.numeric import div

# exp(650) keeps prices up to 1e20 times the largest weight inside a double.
_MAX_LOG_WEIGHT = 650.0


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def _gated(value: Column, x: Column, frame: WindowSpec, need: int) -> Column:
    return F.when(F.count(x).over(frame) >= need, value)


def roll_mean(x: Column, w: WindowSpec, n: int, need: int | None = None) -> Column:
    f = trailing(w, n)
    return _gated(F.avg(x).over(f), x, f, need or n)


def roll_sum(x: Column, w: WindowSpec, n: int) -> Column:
    f = trailing(w, n)
    return _gated(F.sum(x).over(f), x, f, n)


def roll_std(x: Column, w: WindowSpec, n: int, need: int | None = None) -> Column:
    f = trailing(w, n)
    return _gated(F.stddev_samp(x).over(f), x, f, need or n)


def roll_std_pop(x: Column, w: WindowSpec, n: int) -> Column:
    f = trailing(w, n)
    return _gated(F.stddev_pop(x).over(f), x, f, n)


def roll_var(x: Column, w: WindowSpec, n: int) -> Column:
    f = trailing(w, n)
    return _gated(F.var_samp(x).over(f), x, f, n)


def roll_cov(x: Column, y: Column, w: WindowSpec, n: int) -> Column:
    f = trailing(w, n)
    both = F.when(x.isNotNull() & y.isNotNull(), x)
    return _gated(F.covar_samp(x, y).over(f), both, f, n)


def roll_corr(x: Column, y: Column, w: WindowSpec, n: int) -> Column:
    f = trailing(w, n)
    ok = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(ok, x), F.when(ok, y)
    sd = F.stddev_samp(xs).over(f) * F.stddev_samp(ys).over(f)
    return _gated(div(F.covar_samp(xs, ys).over(f), sd), xs, f, n)


def roll_zscore(x: Column, w: WindowSpec, n: int, need: int | None = None) -> Column:
    f = trailing(w, n)
    return _gated(div(x - F.avg(x).over(f), F.stddev_samp(x).over(f)), x, f, need or n)


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1.0)


def ema_reach(alpha: float) -> int:
    """Rows after which an older value weighs less than 2**-64, i.e. nothing in a double."""
    return math.ceil(64 * math.log(2) / -math.log1p(-alpha))


def ema_span_limit(alpha: float) -> int:
    """Longest window partition (halo included) whose weights still fit in a double."""
    return math.floor(_MAX_LOG_WEIGHT / -math.log1p(-alpha))


def add_ema(
    df: DataFrame, w: WindowSpec, src: str, out: str, alpha: float, min_periods: int = 1
) -> DataFrame:
    """y[0] = x[0]; y[t] = alpha*x[t] + (1-alpha)*y[t-1], seeded at the first non-null x.

    y[t] * r**-t is a plain running sum of weighted inputs (r = 1 - alpha), so the
    recurrence needs no row loop. Inputs may be NULL only before the first value.
    """
    ratio = 1.0 - alpha
    seen, pos = f"_{out}_seen", f"_{out}_pos"
    df = df.withColumns(
        {seen: F.count(F.col(src)).over(so_far(w)), pos: F.row_number().over(w).cast("double")}
    )
    weight = F.when(F.col(seen) == 1, F.lit(1.0)).otherwise(F.lit(alpha))
    scaled = weight * F.col(src) * F.pow(F.lit(ratio), -F.col(pos))
    total = F.sum(scaled).over(so_far(w))
    value = F.when(
        F.col(src).isNotNull() & (F.col(seen) >= min_periods),
        total * F.pow(F.lit(ratio), F.col(pos)),
    )
    return df.withColumn(out, value).drop(seen, pos)
