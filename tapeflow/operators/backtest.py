"""Strategy outcomes as tables: equity curves, trade logs, and one exit per signal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tapeflow.config import HORIZON
from tapeflow.functions.numeric import change, div
from tapeflow.operators.risk import dynamic_stop, stop_loss_hit
from tapeflow.plans.slices import RN, over_slices, rn_bucket, running

# Cost of a fill.
COMMISSION, SLIPPAGE = 0.001, 0.0005


def equity_metrics(
    curve: DataFrame, keys: Sequence[str], capital: float = 10000.0, rows: int = 16384
) -> DataFrame:
    """Total return, yearly Sharpe and deepest drawdown of curve(keys, rn, equity)."""

    def step(d, w):
        return d.withColumn("_ret", change(F.col("equity"), F.lag("equity").over(w)))

    df = over_slices(curve, keys, [step], 1, rows=rows)
    df = running(df, keys, [RN], rn_bucket(rows), {"_peak": ("max", F.col("equity"))})
    dd = div(F.col("equity") - F.col("_peak"), F.col("_peak"))
    sharpe = div(F.avg("_ret"), F.stddev_samp("_ret")) * F.lit(365.0**0.5)
    return df.groupBy(*keys).agg(
        ((F.max_by("equity", RN) - capital) / capital).alias("total_return"),
        F.max_by("equity", RN).alias("final_equity"),
        F.coalesce(sharpe, F.lit(0.0)).alias("sharpe"),
        F.coalesce(F.min(dd), F.lit(0.0)).alias("max_drawdown"),
    )


def trade_log_metrics(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Figures over log(action, pnl, commission). Entries and a final forced close earn no pnl."""
    closed = ~F.col("action").isin("BUY", "CLOSE")
    pnl = F.when(closed, F.col("pnl"))
    zero = F.lit(0.0)
    return log.where(F.col("action") != "CLOSE").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.count_if(closed).alias("n_closed"),
        F.coalesce(div(F.count_if(pnl > 0), F.count_if(closed)), zero).alias("win_rate"),
        F.coalesce(F.avg(pnl), zero).alias("avg_pnl"),
        F.coalesce(F.max(pnl), zero).alias("max_win"),
        F.coalesce(F.min(pnl), zero).alias("max_loss"),
        F.sum("commission").alias("total_costs"),
        F.count_if(F.col("action").isin("STOP", "LIQ_PREVENT_STOP")).alias("n_stop_losses"),
    )


def add_signal_outcomes(
    df: DataFrame, w: WindowSpec, h: int = HORIZON, commission: float = COMMISSION,
    slippage: float = SLIPPAGE,
) -> DataFrame:
    """Exit of a long opened at each bar: the first of stop, time limit or sell signal.

    Needs close, pred, sell_th and atr_pct; looks ``h`` rows ahead. ``exit_action``
    is NULL when the data end before the exit.
    """
    lead = {}
    for i in range(1, h + 1):
        lead |= {f"_{c}{i}": F.lead(c, i).over(w) for c in ("close", "pred", "sell_th", "atr_pct")}
    df = df.withColumns(lead).withColumn("entry_fill", F.col("close") * (1.0 + slippage))
    action, bars, price = (F.lit(None).cast(t) for t in ("string", "int", "double"))
    for i in range(h, 0, -1):
        px = F.col(f"_close{i}")
        stop = stop_loss_hit(F.col("entry_fill"), px, dynamic_stop(F.col(f"_atr_pct{i}")))
        sell = F.col(f"_pred{i}") < F.col(f"_sell_th{i}")
        if i == h:
            here = F.when(px.isNull(), F.lit(None)).when(stop, "STOP").otherwise("TIME_EXIT")
        else:
            here = F.when(stop, "STOP").when(sell, "SELL")
        hit = here.isNotNull()
        action, bars, price = (
            F.when(hit, now).otherwise(later)
            for now, later in ((here, action), (F.lit(i), bars), (px, price))
        )
    exit_fill = F.col("exit_price") * (1.0 - slippage)
    keep = (1.0 - commission) ** 2
    return (
        df.withColumns({"exit_action": action, "bars_held": bars, "exit_price": price})
        .withColumn("pnl", div(exit_fill, F.col("entry_fill")) * keep - 1.0)
        .drop(*lead)
    )


def best_candidates(df: DataFrame, on: Sequence[str] = ("ts",)) -> DataFrame:
    """The strongest symbol above its own threshold per time; ties go to the first by name.

    A max over a struct, so a crowded date combines before the shuffle.
    """
    best = F.min_by(
        F.struct("symbol", "pred", "close"), F.struct((-F.col("pred")).alias("p"), "symbol")
    )
    return (
        df.where(F.col("pred") > F.col("buy_th")).groupBy(*on).agg(best.alias("b")).select(*on, "b.*")
    )
