"""Data checks as tables: one report row per symbol, failures routed to rejects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeflow.sources.bars import BAR_COLS

MAX_BAD_OHLC = 0.05
MAX_GAPS = 0.05
MAX_ZERO_VOLUME = 0.10


class SchemaError(ValueError):
    """A required column is missing."""


def check_columns(df: DataFrame, required: Sequence[str] = BAR_COLS) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise SchemaError(f"Missing required columns: {missing}")
    return df


def column_report(df: DataFrame, required: Sequence[str] = BAR_COLS) -> DataFrame:
    """(name, present, n_null) of every required column, from one pass over those there are."""
    missing = F.lit(None).cast("long")
    found = {c: F.count_if(F.col(c).isNull()) if c in df.columns else F.max(missing) for c in required}
    one = df.agg(*[v.alias(c) for c, v in found.items()])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.lit(c in df.columns).alias("present"), F.col(c).alias("n_null")) for c in required])))


def bad_ohlc():
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return (h < low) | (h < o) | (h < c) | (low > o) | (low > c)


def ohlcv_report(bars: DataFrame, min_rows: int = 252) -> DataFrame:
    """All checks in one grouped pass. Periods are days; partial aggregation does the work."""
    check_columns(bars)
    day = F.to_date("ts")
    grouped = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.count_if(bad_ohlc()).alias("ohlc_violations"),
        (F.datediff(F.max(day), F.min(day)) + 1).cast("long").alias("_span"),
        F.count_distinct(day).alias("_days"),
        F.count_if(F.col("volume") == 0).alias("zero_volume_rows"),
    )
    missing = F.col("_span") - F.col("_days")
    return grouped.withColumn("missing_periods", missing).withColumns(
        {
            "too_short": F.col("rows") < min_rows,
            "bad_ohlc": F.col("ohlc_violations") / F.col("rows") > MAX_BAD_OHLC,
            "gap_warning": F.col("missing_periods") / F.col("_span") > MAX_GAPS,
            "zero_volume_warning": F.col("zero_volume_rows") / F.col("rows") > MAX_ZERO_VOLUME,
        }
    ).drop("_span", "_days")


def missing_days(bars: DataFrame) -> DataFrame:
    """The absent days themselves: a full calendar per symbol minus the days seen.

    The calendar of a symbol is bounded by its span in days, not by its rows.
    """
    days = bars.select("symbol", F.to_date("ts").alias("d")).distinct()
    span = days.groupBy("symbol").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    full = span.select("symbol", F.explode(F.sequence("lo", "hi")).alias("d"))
    return full.join(days, ["symbol", "d"], "left_anti")


def rejects(report: DataFrame) -> DataFrame:
    """Symbols a build must leave out, with the reason."""
    reason = F.when(F.col("too_short"), "too_short").when(F.col("bad_ohlc"), "bad_ohlc")
    return report.withColumn("reason", reason).where(F.col("reason").isNotNull())


def accepted(bars: DataFrame, report: DataFrame) -> DataFrame:
    """Bars of the symbols that passed; the reject side is one row per failed symbol."""
    return bars.join(rejects(report).select("symbol"), "symbol", "left_anti")


def missing_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing and infinite counts over chosen columns, one pass."""
    absent = [c for c in cols if c not in df.columns]
    if absent:
        raise SchemaError(f"Missing feature columns: {absent}")
    null = sum((F.when(F.col(c).isNull() | F.isnan(c), 1).otherwise(0) for c in cols), F.lit(0))
    inf = sum((F.when(F.abs(c) == float("inf"), 1).otherwise(0) for c in cols), F.lit(0))
    return df.groupBy("symbol").agg(F.sum(null).alias("n_missing"), F.sum(inf).alias("n_inf"))


def complete_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


def trade_rejects(trades: DataFrame) -> DataFrame:
    """Trades no ledger may hold."""
    reason = (
        F.when(~F.col("side").isin("BUY", "SELL"), "side")
        .when(F.col("qty") <= 0, "qty")
        .when(F.col("price") <= 0, "price")
        .when(F.col("fee") < 0, "fee")
    )
    return trades.withColumn("reason", reason).where(F.col("reason").isNotNull())


def exact_quantiles(
    df: DataFrame, key: str, cols: Sequence[str], probs: Sequence[float], bins: int = 64
) -> DataFrame:
    """Exact linear-interpolated quantiles per (key, column) without gathering a key in one task.

    All columns go through one pass in long form. Values are counted first (equal
    values collapse before the shuffle), then placed in bins cut at approximate
    quantiles, so a running count by bin finds the wanted ranks exactly however many
    rows one key holds.
    """
    from tapeflow.plans.slices import running

    long = df.select(
        key,
        F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in cols])),
    )
    keys = [key, "name"]
    values = long.where(F.col("v").isNotNull()).groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    cuts = [i / bins for i in range(1, bins)]
    marks = values.groupBy(*keys).agg(
        F.percentile_approx("v", cuts, 1000).alias("_cuts"), F.sum("n").alias("_total")
    )
    binned = values.join(marks, keys)
    bin_no = F.aggregate("_cuts", F.lit(0), lambda a, c: a + F.when(c <= F.col("v"), 1).otherwise(0))
    ranked = running(binned, keys, ["v"], bin_no, {"upto": ("sum", F.col("n"))})
    start = F.col("upto") - F.col("n")

    def value_at(rank: Column) -> Column:
        return F.max(F.when((start <= rank) & (rank < F.col("upto")), F.col("v")))

    aggs = []
    for i, p in enumerate(probs):
        pos = (F.col("_total") - 1) * F.lit(float(p))
        lo, hi = value_at(F.floor(pos)), value_at(F.ceil(pos))
        aggs.append((lo + (hi - lo) * F.max(pos - F.floor(pos))).alias(f"q{i}"))
    return ranked.groupBy(*keys).agg(*aggs)


def winsorize(
    df: DataFrame, cols: Sequence[str], limits=(0.005, 0.995), key: str = "symbol"
) -> DataFrame:
    """Clip feature columns to their own quantiles where the lower one is smaller.

    The target is never among ``cols``. All limits of a key arrive in one joined row.
    """
    q = exact_quantiles(df, key, cols, limits)
    wide = q.groupBy(key).agg(
        *[F.max(F.when(F.col("name") == c, F.struct("q0", "q1"))).alias(f"_q_{c}") for c in cols]
    )

    def capped(c: str) -> Column:
        lo, hi = F.col(f"_q_{c}.q0"), F.col(f"_q_{c}.q1")
        inside = F.greatest(lo, F.least(hi, F.col(c)))
        return F.when(F.col(c).isNotNull() & (lo < hi), inside).otherwise(F.col(c))

    out = df.join(wide, key, "left").withColumns({c: capped(c) for c in cols})
    return out.drop(*[f"_q_{c}" for c in cols])
