"""Features of one asset against a basket of others, aligned by day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.functions.numeric import change, clip, div, zero_fill
from tapeflow.functions.rolling import roll_corr, roll_zscore
from tapeflow.operators.asof import align_days, bar_days
from tapeflow.plans.slices import over_slices


def daily_reference(bars: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """Last bar of each day per reference symbol; at most a calendar of rows per symbol."""
    return (
        bars.where(F.col("symbol").isin(list(symbols)))
        .groupBy("symbol", F.to_date("ts").alias("d"))
        .agg(F.max_by(F.struct("close", "volume"), "ts").alias("b"))
        .select("symbol", "d", "b.close", "b.volume")
    )


def _with_return(ref: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("d")
    return ref.withColumn("ret", change(F.col("close"), F.lag("close").over(w)))


def ratio_change(ref: DataFrame, pair: str, bound: float = 0.5) -> DataFrame:
    """Clipped daily return of the ratio pair."""
    one = _with_return(ref.where(F.col("symbol") == pair))
    return one.select("d", clip(F.col("ret"), -bound, bound).alias("value"))


def volume_share(ref: DataFrame, basket: Sequence[str], lead: str, z: int = 60) -> DataFrame:
    """z-score of the lead asset's share of basket volume, on days all members trade."""
    if lead not in basket or len(basket) < 2:
        raise ValueError("volume share needs the lead and at least one other member")
    daily = ref.where(F.col("symbol").isin(list(basket))).groupBy("d").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("volume").alias("total"),
        F.sum(F.when(F.col("symbol") == lead, F.col("volume"))).alias("own"),
    )
    share = daily.where(F.col("n") == len(basket)).select(
        "d", F.lit(lead).alias("series"), div(F.col("own"), F.col("total")).alias("x")
    )
    w = Window.partitionBy("series").orderBy("d")
    return share.select("d", zero_fill(roll_zscore(F.col("x"), w, z)).alias("value"))


def basket_return(ref: DataFrame, basket: Sequence[str]) -> DataFrame:
    """Mean member return per day, absent members skipped."""
    rets = _with_return(ref.where(F.col("symbol").isin(list(basket))))
    return rets.groupBy("d").agg(F.avg("ret").alias("value"))


def add_cross_asset(
    bars: DataFrame, pair: str, basket: Sequence[str], lead: str,
    corr_window: int = 30, z: int = 60, rows: int = 16384,
) -> DataFrame:
    """Add the three cross-asset columns; missing values become zero. Needs ``rn``."""
    ref = daily_reference(bars, [pair, *basket])
    named = [
        ("eth_btc_chg", ratio_change(ref, pair)),
        ("btc_vol_share", volume_share(ref, basket, lead, z)),
        ("_basket", basket_return(ref, basket)),
    ]
    series = None
    for name, s in named:
        s = s.withColumn("name", F.lit(name))
        series = s if series is None else series.unionByName(s)
    names = [n for n, _ in named]
    days = bar_days(bars).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("name"), "d")
    wide = align_days(series, days, ["name"]).groupBy("d").pivot("name", names).agg(F.first("value"))
    joined = bars.withColumn("d", F.to_date("ts")).join(wide, "d", "left").drop("d")

    def corr(df, w):
        df = df.withColumn("_ret", change(F.col("close"), F.lag("close").over(w)))
        value = roll_corr(F.col("_ret"), F.col("_basket"), w, corr_window)
        return df.withColumn("mkt_corr", value).drop("_ret")

    out = over_slices(joined, ["symbol"], [corr], corr_window + 1, rows=rows).drop("_basket")
    return out.withColumns(
        {c: zero_fill(F.col(c)) for c in ("eth_btc_chg", "btc_vol_share", "mkt_corr")}
    )
