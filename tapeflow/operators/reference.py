"""External daily series as leak-free features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.config import REFERENCE_NAMES
from tapeflow.functions.numeric import change, clip, zero_fill
from tapeflow.functions.rolling import roll_zscore
from tapeflow.operators.asof import align_days, bar_days

# Rows of the z-score and the bound of each feature.
Z_ROWS = 30
BOUNDS = {"move": 0.1, "oi_chg": 0.5, "funding_rate": 0.01, "onchain_z": 5.0}


def transform(
    series: DataFrame, keys: Sequence[str] = ("name",), z_rows: int = Z_ROWS,
    bounds: dict[str, float] = BOUNDS,
) -> DataFrame:
    """Level series(name, d, value) to scale-free features, each by its own rule.

    A series holds one row per day, so its window is at most a calendar long.
    """
    w = Window.partitionBy(*keys).orderBy("d")
    v, name = F.col("value"), F.col("name")
    move = change(v, F.lag("value").over(w))
    z = roll_zscore(v, w, z_rows)
    feat = (
        F.when(
            name.isin("dxy_chg", "stable_dom_chg", "liquidity_chg"),
            clip(move, -bounds["move"], bounds["move"]),
        )
        .when(name == "oi_chg", clip(move, -bounds["oi_chg"], bounds["oi_chg"]))
        .when(name == "funding_rate", clip(v, -bounds["funding_rate"], bounds["funding_rate"]))
        .when(name == "onchain_z", clip(z, -bounds["onchain_z"], bounds["onchain_z"]))
        .when(name == "fear_greed", clip((v - 50.0) / 50.0, -1.0, 1.0))
    )
    return series.withColumn("value", feat)


def add_reference(
    bars: DataFrame, series: DataFrame, shift: int = 1,
    by_symbol: bool = False,
) -> DataFrame:
    """Seven reference columns; the value of one row of a series shows on the next.

    The shift counts rows of the series, not days. A series that is absent gives
    zeros. ``by_symbol`` joins series that carry their own symbol.
    """
    if shift < 1:
        raise ValueError("shift must be at least 1 to avoid a same-day leak")
    keys = ["name", "symbol"] if by_symbol else ["name"]
    w = Window.partitionBy(*keys).orderBy("d")
    feats = transform(series, keys).withColumn("value", F.lag("value", shift).over(w))
    names = F.explode(F.array(*[F.lit(n) for n in REFERENCE_NAMES])).alias("name")
    if by_symbol:
        days = bars.select("symbol", F.to_date("ts").alias("d")).distinct()
    else:
        days = bar_days(bars)
    days = days.select(names, *[k for k in keys if k != "name"], "d")
    at = [k for k in keys if k != "name"] + ["d"]
    wide = (
        align_days(feats, days, keys)
        .groupBy(*at)
        .pivot("name", list(REFERENCE_NAMES))
        .agg(F.first("value"))
    )
    out = bars.withColumn("d", F.to_date("ts")).join(wide, at, "left").drop("d")
    return out.withColumns({n: zero_fill(F.col(n)) for n in REFERENCE_NAMES})
