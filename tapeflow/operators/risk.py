"""Position sizing and leverage risk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeflow.functions.numeric import div

# Published shares of capital, margin and cost.
KELLY_SHARE, KELLY_FROM, SMALLEST, LARGEST = 0.25, 5, 0.1, 0.2
STOP = 0.05
MAINTENANCE, BEFORE_LIQUIDATION = 0.005, 0.002
TOP_LEVERAGE, FUNDING_A_YEAR = 10.0, 0.10


def kelly_sizes(
    trades: DataFrame, keys: Sequence[str], pnl: str = "pnl", share: float = KELLY_SHARE,
    need: int = KELLY_FROM, low: float = SMALLEST, high: float = LARGEST,
) -> DataFrame:
    """Bounded fraction of the Kelly stake from past trades; the maximum while too few.

    Break-even trades count towards the minimum but are no evidence.
    """
    p = F.col(pnl)
    g = trades.groupBy(*keys).agg(
        F.count(p).alias("n"),
        F.count_if(p > 0).alias("wins"),
        F.count_if(p < 0).alias("losses"),
        F.avg(F.when(p > 0, p)).alias("gain"),
        F.abs(F.avg(F.when(p < 0, p))).alias("loss"),
    )
    valid = F.col("wins") + F.col("losses")
    rate, b = div(F.col("wins"), valid), div(F.col("gain"), F.col("loss"))
    stake = div(rate * b - (1.0 - rate), b)
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), stake)) * share
    size = F.greatest(F.lit(low), F.least(F.lit(high), bounded))
    few = (F.col("n") < need) | (valid < need)
    empty = (F.col("wins") == 0) | (F.col("losses") == 0)
    out = F.when(few | empty | stake.isNull(), F.lit(high)).otherwise(size)
    return g.select(*keys, "n", out.alias("position_size"))


def stop_loss_hit(entry: Column, price: Column, pct: Column) -> Column:
    return (entry > 0) & (price <= entry * (1.0 - pct))


def dynamic_stop(atr_pct: Column, fixed: float = STOP) -> Column:
    """Three times the volatility between 1% and 15%; the fixed stop where it is unknown."""
    scaled = F.greatest(F.lit(0.01), F.least(F.lit(0.15), atr_pct * 3.0))
    return F.when(atr_pct > 0, scaled).otherwise(F.lit(fixed))


def liquidation_price(
    entry: Column, leverage: Column, side: Column, margin: float = MAINTENANCE
) -> Column:
    """Isolated-margin liquidation price; 0 for unusable input."""
    inv, m = div(F.lit(1.0), leverage), margin
    price = F.when(side == "long", entry * (1.0 - inv + m)).when(
        side == "short", entry * (1.0 + inv - m)
    )
    ok = (entry > 0) & (leverage > 0)
    return F.when(ok, F.greatest(F.lit(0.0), F.coalesce(price, F.lit(0.0)))).otherwise(0.0)


def is_liquidated(
    entry: Column, price: Column, leverage: Column, side: Column, margin: float = MAINTENANCE
) -> Column:
    liq = liquidation_price(entry, leverage, side, margin)
    hit = F.when(side == "long", price <= liq).otherwise(price >= liq)
    return F.when(liq <= 0, F.lit(False)).otherwise(hit)


def buffer_price(
    entry: Column, leverage: Column, side: Column, ahead: float = BEFORE_LIQUIDATION,
    margin: float = MAINTENANCE,
) -> Column:
    """Where to close before liquidation happens."""
    liq = liquidation_price(entry, leverage, side, margin)
    b = ahead
    return F.when(liq <= 0, 0.0).when(side == "long", liq * (1.0 + b)).otherwise(liq * (1.0 - b))


def max_leverage(volatility: Column, top: float = TOP_LEVERAGE) -> Column:
    """Leverage limit that falls as yearly volatility passes 40%."""
    yearly = F.greatest(volatility * F.lit(365.0**0.5), F.lit(0.01))
    fit = F.lit(top) * (0.40 / yearly)
    bounded = F.greatest(F.lit(1.0), F.least(F.lit(top), fit))
    return F.when(volatility > 0, bounded).otherwise(F.lit(top))


def funding_cost(value: Column, days: Column, yearly: float = FUNDING_A_YEAR) -> Column:
    return value * F.lit(yearly / 365.0) * days
