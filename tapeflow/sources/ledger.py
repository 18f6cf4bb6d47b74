"""Append-only ledgers: trades with tombstones, and logged predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active_trades(trades: DataFrame, removed: DataFrame, keys: Sequence[str] = ("trade_id",)) -> DataFrame:
    """Trades without a tombstone; ``removed`` holds the keys of the trades taken back, one by one."""
    return trades.join(removed.select(*keys), list(keys), "left_anti")


def trades_of(trades: DataFrame, symbol: str | None = None) -> DataFrame:
    return trades if symbol is None else trades.where(F.col("symbol") == symbol)


def traded_symbols(trades: DataFrame) -> DataFrame:
    return trades.select("symbol").distinct()


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def prediction_rows(df: DataFrame, horizon_days: int | Column = 5) -> DataFrame:
    """Logged predictions(symbol, ts, entry_price, consensus, confidence, thresholds)."""
    days = F.lit(horizon_days) if isinstance(horizon_days, int) else horizon_days
    return df.withColumns(
        {
            "horizon_days": days.cast("int"),
            "resolution_ts": F.col("ts") + F.make_dt_interval(days.cast("int")),
            "status": F.lit("pending"),
        }
    )
