"""Microstructure measures from bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from tapeflow.functions.numeric import change, div, zero_fill
from tapeflow.functions.rolling import (
    roll_cov,
    roll_mean,
    roll_sum,
    roll_var,
    roll_zscore,
    trailing,
)

# Published look-backs in bars.
AMIHUD_WINDOW = 5
AMIHUD_Z_WINDOW = 60
KYLE_WINDOW = 20
ROLL_SPREAD_WINDOW = 20
VOLUME_WINDOW = 20
VWAP_WINDOW = 20


def add_volume_delta(df: DataFrame, w: WindowSpec, window: int = VOLUME_WINDOW) -> DataFrame:
    """Volume signed by where the close sits in the bar, as a trailing z-score."""
    h, low, c = F.col("high"), F.col("low"), F.col("close")
    place = F.coalesce(div((c - low) - (h - c), h - low), F.lit(0.0))
    df = df.withColumn("_vd", place * F.col("volume"))
    return df.withColumn("vol_delta", zero_fill(roll_zscore(F.col("_vd"), w, window))).drop("_vd")


def add_amihud(
    df: DataFrame, w: WindowSpec, window: int = AMIHUD_WINDOW, z: int = AMIHUD_Z_WINDOW
) -> DataFrame:
    """Price move per traded value, averaged, then as a trailing z-score."""
    ret = F.abs(change(F.col("close"), F.lag("close").over(w)))
    df = df.withColumn("_illiq", div(ret, F.col("close") * F.col("volume")) * 1e9)
    df = df.withColumn("amihud_raw", roll_mean(F.col("_illiq"), w, window))
    score = zero_fill(roll_zscore(F.col("amihud_raw"), w, z))
    return df.withColumn("amihud_illiq", score).drop("_illiq")


def add_roll_spread(
    df: DataFrame, w: WindowSpec, window: int = ROLL_SPREAD_WINDOW
) -> DataFrame:
    """Effective spread from the serial covariance of price changes."""
    df = df.withColumn("_dp", F.col("close") - F.lag("close").over(w))
    df = df.withColumn("_dp1", F.lag("_dp").over(w))
    pairs = w.rowsBetween(-(window - 2), 0)
    full = F.count("_dp").over(trailing(w, window)) == window
    cov = F.when(full, F.covar_samp("_dp1", "_dp").over(pairs))
    spread = 2.0 * F.sqrt(F.abs(F.least(cov, F.lit(0.0))))
    out = F.when(cov.isNotNull(), div(spread, F.col("close")))
    return df.withColumn("roll_spread", out).drop("_dp", "_dp1")


def add_kyle_lambda(df: DataFrame, w: WindowSpec, window: int = KYLE_WINDOW) -> DataFrame:
    """Return per unit of signed volume."""
    df = df.withColumn("_r", change(F.col("close"), F.lag("close").over(w)))
    df = df.withColumn("_sv", F.signum("_r") * F.col("volume"))
    lam = div(roll_cov(F.col("_r"), F.col("_sv"), w, window), roll_var(F.col("volume"), w, window))
    return df.withColumn("kyle_lambda", lam).drop("_r", "_sv")


def add_vwap_distance(df: DataFrame, w: WindowSpec, window: int = VWAP_WINDOW) -> DataFrame:
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    df = df.withColumn("_pv", typical * F.col("volume"))
    vwap = div(roll_sum(F.col("_pv"), w, window), roll_sum(F.col("volume"), w, window))
    return df.withColumn("vwap_dist", div(F.col("close") - vwap, vwap)).drop("_pv")


def add_range(df: DataFrame, w: WindowSpec | None = None) -> DataFrame:
    return df.withColumn("hl_range", div(F.col("high") - F.col("low"), F.col("close")))


STEPS = (
    add_volume_delta, add_amihud, add_roll_spread, add_kyle_lambda, add_vwap_distance, add_range,
)
BACK = AMIHUD_Z_WINDOW + AMIHUD_WINDOW + 1


def add_micro(df: DataFrame, w: WindowSpec) -> DataFrame:
    for step in STEPS:
        df = step(df, w)
    return df.drop("amihud_raw")
