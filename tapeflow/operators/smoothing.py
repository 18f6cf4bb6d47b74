"""Causal smoothing: trailing polynomial fit and exponential average."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tapeflow.functions.numeric import div
from tapeflow.functions.rolling import add_ema, span_alpha

# Published look-backs in bars.
EMA_SPAN = 10
SAVGOL_ORDER = 3
SAVGOL_WINDOW = 11


def savgol_taps(window: int, order: int, deriv: int = 0) -> list[float]:
    """Weights, oldest first, of the polynomial fit's value or slope at the newest bar."""
    if order >= window:
        raise ValueError(f"order ({order}) must be below window ({window})")
    if deriv > order:
        return [0.0] * window
    # Powers of the bar's offset from the newest bar; row `deriv` of the
    # pseudo-inverse is that Taylor coefficient.
    offsets = np.arange(window) - (window - 1)
    basis = np.vander(offsets, order + 1, increasing=True).astype(float)
    taps = np.linalg.pinv(basis)[deriv] * float(np.prod(range(1, deriv + 1)))
    return [float(t) for t in taps]


def savgol(
    x: str, w: WindowSpec, window: int = SAVGOL_WINDOW, order: int = SAVGOL_ORDER,
    deriv: int = 0,
) -> Column:
    """A fixed set of lags times literal weights; NULL until the window is full."""
    total = F.lit(0.0)
    for back, tap in enumerate(reversed(savgol_taps(window, order, deriv))):
        total = total + F.lit(tap) * F.lag(x, back).over(w)
    return total


def add_savgol_slope(df: DataFrame, w: WindowSpec) -> DataFrame:
    return df.withColumn("savgol_slope", div(savgol("close", w, deriv=1), F.col("close")))


def add_ema_slope(df: DataFrame, w: WindowSpec, span: int = EMA_SPAN) -> DataFrame:
    df = add_ema(df, w, "close", "_e", span_alpha(span))
    slope = div(F.col("_e") - F.lag("_e").over(w), F.col("close"))
    return df.withColumn("ema_slope", slope).drop("_e")


def add_smoothing(df: DataFrame, w: WindowSpec) -> DataFrame:
    return add_ema_slope(add_savgol_slope(df, w), w)
