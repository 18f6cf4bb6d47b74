"""FIFO lot accounting over a trade ledger.

Input: trades(symbol, ts, seq, side, qty, price, fee, signal); ``seq`` keeps the input
order of trades at the same time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.functions.numeric import div
from tapeflow.functions.times import seconds_between
from tapeflow.plans.ranges import RANGE, ROWS, WHOLE, ranged_if_long
from tapeflow.plans.slices import running

EPS = 1e-12
_KEY = ["symbol"]


def with_running_quantity(trades: DataFrame, rows: int = ROWS) -> DataFrame:
    """Bought and sold so far per symbol, each trade included. One window orders about ``rows`` trades.

    Pass a stored table or a projection of one.
    """
    qty = F.col("qty")
    return running(
        ranged_if_long(trades, _KEY, ["ts", "seq"], rows), _KEY, ["ts", "seq"], RANGE,
        {
            "bought": ("sum", F.when(F.col("side") == "BUY", qty).otherwise(0.0)),
            "sold": ("sum", F.when(F.col("side") == "SELL", qty).otherwise(0.0)),
        },
    )


def oversold(run: DataFrame) -> DataFrame:
    """Symbols that sell more than they hold, with the first such time and the worst gap."""
    gap = F.col("sold") - F.col("bought")
    return run.where(gap > EPS).groupBy("symbol").agg(
        F.min("ts").alias("first_ts"), F.max(gap).alias("worst_gap")
    )


def _lots(run: DataFrame, rows: int) -> DataFrame:
    """Quantity pieces with the buy that supplies and the sell (if any) that takes each.

    Buys and sells are laid on one quantity axis. Every trade ends at an edge; the
    piece below an edge belongs to the first buy and the first sell ending at or
    beyond it, which is a "next known" value walking the axis from the top. The axis is cut
    where the edges are, so a symbol of very many tiny trades gets more ranges, not longer ones.
    """
    info = F.struct(
        "ts", "price", F.coalesce(div(F.col("fee"), F.col("qty")), F.lit(0.0)).alias("unit_fee"), "signal"
    )
    is_buy = F.col("side") == "BUY"
    # Sums of the same quantities in another order may differ in the last digits. A buy
    # and a sell may end at the same edge; the second of them has an empty piece.
    edge = F.round(F.when(is_buy, F.col("bought")).otherwise(F.col("sold")), 9)
    edges = run.select("symbol", edge.alias("edge"), is_buy.alias("_is_buy"), info.alias("_trade"))
    known = running(
        ranged_if_long(edges, _KEY, ["edge", "_is_buy"], rows), _KEY, ["edge", "_is_buy"], RANGE,
        {
            "buy": ("next", F.when(F.col("_is_buy"), F.col("_trade"))),
            "sell": ("next", F.when(~F.col("_is_buy"), F.col("_trade"))),
            "_from": ("before", F.col("edge")),
        },
    )
    piece = F.col("edge") - F.coalesce("_from", F.lit(0.0))
    return known.drop(RANGE).withColumn("qty", piece).where((F.col("qty") > EPS) & F.col("buy").isNotNull())


def match_fifo(run: DataFrame, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Closed lots and open lots from trades with running quantities.

    Symbols that oversell must be removed first, see ``without_oversold``. ``rows`` trades, about, are
    ordered by one task. Pass a stored table.
    """
    lots = _lots(run, rows)
    buy_cols = [
        F.col("buy.ts").alias("buy_ts"), F.col("buy.price").alias("buy_price"),
        F.col("buy.signal").alias("buy_signal"),
    ]
    closed = lots.where(F.col("sell").isNotNull()).select(
        "symbol", "qty", *buy_cols,
        F.col("sell.ts").alias("sell_ts"), F.col("sell.price").alias("sell_price"),
        F.col("sell.signal").alias("sell_signal"),
        (F.col("buy.unit_fee") * F.col("qty")).alias("buy_fee"),
        (F.col("sell.unit_fee") * F.col("qty")).alias("sell_fee"),
    )
    open_lots = lots.where(F.col("sell").isNull()).select(
        "symbol", "qty", *buy_cols, F.col("buy.unit_fee").alias("unit_fee")
    )
    return with_lot_results(closed), open_lots


def with_lot_results(closed: DataFrame) -> DataFrame:
    qty = F.col("qty")
    cost = F.col("buy_price") * qty + F.col("buy_fee")
    proceeds = F.col("sell_price") * qty - F.col("sell_fee")
    pct = F.coalesce(div(F.col("pnl"), F.abs(F.col("cost_basis"))) * 100.0, F.lit(0.0))
    seconds = seconds_between(F.col("buy_ts"), F.col("sell_ts"))
    return (
        closed.withColumns({"cost_basis": cost, "proceeds": proceeds})
        .withColumn("pnl", F.col("proceeds") - F.col("cost_basis"))
        .withColumns({"pnl_pct": pct, "hold_days": seconds / F.lit(86400.0)})
    )


def without_oversold(run: DataFrame) -> DataFrame:
    """Trades of symbols that never oversell.

    A symbol that lies in one piece is judged where it lies. Another is judged on its ranges' worst
    gaps, and the verdict goes back by range, so a busy symbol's trades are not brought together.
    """
    gap, in_one = F.col("sold") - F.col("bought"), F.col(RANGE) == WHOLE
    here = F.max(gap).over(Window.partitionBy("symbol", RANGE))
    short = run.where(in_one).withColumn("_gap", here).where(~(F.col("_gap") > EPS)).drop("_gap")
    long = run.where(~in_one)
    gaps = long.groupBy("symbol", RANGE).agg(F.max(gap).alias("_gap"))
    worst = F.max("_gap").over(Window.partitionBy("symbol"))
    good = gaps.withColumn("_worst", worst).where(~(F.col("_worst") > EPS)).select("symbol", RANGE)
    return short.unionByName(long.join(good, ["symbol", RANGE], "left_semi"))


def open_positions(open_lots: DataFrame) -> DataFrame:
    cost = F.col("qty") * F.col("buy_price") + F.col("qty") * F.col("unit_fee")
    g = open_lots.groupBy("symbol").agg(F.sum("qty").alias("qty"), F.sum(cost).alias("cost_basis"))
    avg = F.when(F.col("qty") > EPS, F.col("cost_basis") / F.col("qty")).otherwise(0.0)
    return g.withColumn("avg_price", avg)


def with_last_prices(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Unrealised result against prices(symbol, price); NULL without a price."""
    px = F.col("price")
    pct = F.when(F.col("avg_price") > 0, (px / F.col("avg_price") - 1.0) * 100.0).otherwise(
        F.when(px.isNotNull(), 0.0)
    )
    return positions.join(prices, "symbol", "left").withColumns(
        {"unrealized_pnl": (px - F.col("avg_price")) * F.col("qty"), "unrealized_pnl_pct": pct}
    )


def realized_total(closed: DataFrame) -> DataFrame:
    return closed.agg(F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("realized_pnl"))


def _rollup(closed: DataFrame, *keys) -> DataFrame:
    return closed.groupBy(*keys).agg(
        F.sum("pnl").alias("realized_pnl"),
        F.count(F.lit(1)).alias("n_closed"),
        (F.avg((F.col("pnl") > 0).cast("double")) * 100.0).alias("win_rate"),
        F.avg("pnl_pct").alias("avg_pnl_pct"),
        F.max("pnl").alias("best"),
        F.min("pnl").alias("worst"),
    )


def monthly_summary(closed: DataFrame) -> DataFrame:
    return _rollup(closed, F.date_format("sell_ts", "yyyy-MM").alias("month"))


def signal_alignment(closed: DataFrame) -> DataFrame:
    """Realised results by the signal recorded at entry."""
    out = _rollup(closed.where(F.col("buy_signal").isNotNull()), "buy_signal")
    return out.drop("best", "worst").withColumnRenamed("realized_pnl", "total_pnl")
