"""Technical indicators. Each step takes (df, w) where w orders the bars of a symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from tapeflow.config import HORIZON
from tapeflow.functions.numeric import change, div
from tapeflow.functions.rolling import (
    add_ema,
    ema_reach,
    ema_span_limit,
    roll_mean,
    roll_std_pop,
    span_alpha,
)
from tapeflow.plans.slices import RN, over_slices, rn_bucket, running

# Published look-backs in bars.
ATR_WINDOW = 14
BB_DEV = 2.0
BB_WINDOW = 20
EMA_SPAN = 10
EMA_WINDOW = 20
MACD_FAST = 12
MACD_SIGNAL = 9
MACD_SLOW = 26
RSI_WINDOW = 14
SMA_WINDOW = 50
VOLUME_WINDOW = 20


def _lag(col: str, w: WindowSpec, k: int = 1):
    return F.lag(col, k).over(w)


def add_returns(df: DataFrame, w: WindowSpec) -> DataFrame:
    return df.withColumns(
        {f"ret_{k}d": change(F.col("close"), _lag("close", w, k)) for k in (1, 5, 10)}
    )


def add_rsi(df: DataFrame, w: WindowSpec, window: int = RSI_WINDOW) -> DataFrame:
    """Relative strength in 0..1 with Wilder smoothing; the first bar counts as no move."""
    step = F.coalesce(F.col("close") - _lag("close", w), F.lit(0.0))
    df = df.withColumn("_d", step).withColumns(
        {"_up": F.greatest(F.col("_d"), F.lit(0.0)), "_dn": F.greatest(-F.col("_d"), F.lit(0.0))}
    )
    df = add_ema(df, w, "_up", "_su", 1.0 / window, min_periods=window)
    df = add_ema(df, w, "_dn", "_sd", 1.0 / window, min_periods=window)
    rs = div(F.col("_su"), F.col("_sd"))
    rsi = F.when(F.col("_sd") == 0, F.lit(1.0)).otherwise(1.0 - div(F.lit(1.0), 1.0 + rs))
    return df.withColumn("rsi", rsi).drop("_d", "_up", "_dn", "_su", "_sd")


def add_macd(
    df: DataFrame, w: WindowSpec, fast: int = MACD_FAST, slow: int = MACD_SLOW,
    signal: int = MACD_SIGNAL,
) -> DataFrame:
    """MACD histogram over price; the signal line starts once the slow average exists."""
    df = add_ema(df, w, "close", "_ef", span_alpha(fast), min_periods=fast)
    df = add_ema(df, w, "close", "_es", span_alpha(slow), min_periods=slow)
    df = df.withColumn("_macd", F.col("_ef") - F.col("_es"))
    df = add_ema(df, w, "_macd", "_sig", span_alpha(signal), min_periods=signal)
    out = div(F.col("_macd") - F.col("_sig"), F.col("close"))
    return df.withColumn("macd_diff", out).drop("_ef", "_es", "_macd", "_sig")


def add_bollinger(
    df: DataFrame, w: WindowSpec, window: int = BB_WINDOW, dev: float = BB_DEV
) -> DataFrame:
    """Position inside the bands: 0 at the lower band, 1 at the upper."""
    mid = roll_mean(F.col("close"), w, window)
    half = roll_std_pop(F.col("close"), w, window) * dev
    return df.withColumn("bb_pband", div(F.col("close") - (mid - half), 2.0 * half))


def add_atr(df: DataFrame, w: WindowSpec, window: int = ATR_WINDOW) -> DataFrame:
    """Wilder average true range over price; zero until the seed bar, as published."""
    prev = _lag("close", w)
    tr = F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)
    )
    df = df.withColumn("_tr", tr)
    seed = F.avg("_tr").over(w.rowsBetween(-(window - 1), 0))
    df = df.withColumn(
        "_x",
        F.when(F.col(RN) == window - 1, seed).when(F.col(RN) >= window, F.col("_tr")),
    )
    df = add_ema(df, w, "_x", "_atr", 1.0 / window)
    atr = F.coalesce(F.col("_atr"), F.lit(0.0))
    return df.withColumn("atr_pct", div(atr, F.col("close"))).drop("_tr", "_x", "_atr")


def add_volume(df: DataFrame, w: WindowSpec, window: int = VOLUME_WINDOW) -> DataFrame:
    vol = F.col("volume")
    return df.withColumns(
        {
            "vol_chg": change(vol, _lag("volume", w)),
            "vol_ratio": div(vol, roll_mean(vol, w, window)),
        }
    )


def add_sma_distance(df: DataFrame, w: WindowSpec, window: int = SMA_WINDOW) -> DataFrame:
    sma = roll_mean(F.col("close"), w, window)
    return df.withColumn("_sma", sma).withColumn(
        "sma50_dist", div(F.col("close") - F.col("_sma"), F.col("_sma"))
    )


def add_ma_distances(df: DataFrame, w: WindowSpec) -> DataFrame:
    df = add_sma_distance(df, w)
    df = add_ema(df, w, "close", "_ema", span_alpha(EMA_WINDOW), min_periods=EMA_WINDOW)
    return df.withColumns(
        {
            "ema20_dist": div(F.col("close") - F.col("_ema"), F.col("_ema")),
            "ema_sma_dist": div(F.col("_ema") - F.col("_sma"), F.col("_sma")),
        }
    ).drop("_ema", "_sma")


def add_target(df: DataFrame, w: WindowSpec, h: int = HORIZON) -> DataFrame:
    """Return over the next h bars; NULL for the last h."""
    return df.withColumn("target", change(F.lead("close", h).over(w), F.col("close")))


# Depth of the deepest chain (slow average feeding the signal line) and the slice
# length that keeps the fastest smoother's weights inside a double.
SMOOTH_BACK = max(
    ema_reach(span_alpha(MACD_SLOW)) + ema_reach(span_alpha(MACD_SIGNAL)),
    ema_reach(1.0 / RSI_WINDOW) + 8,
    ema_reach(1.0 / ATR_WINDOW) + ATR_WINDOW,
    ema_reach(span_alpha(EMA_WINDOW)) + 1,
)
SMOOTH_ROWS = min(
    ema_span_limit(span_alpha(s)) for s in (MACD_SIGNAL, MACD_FAST, EMA_SPAN)
) - SMOOTH_BACK - 1


def mark_swings(df: DataFrame, w: WindowSpec, k: int = 3, rsi: str = "rsi") -> DataFrame:
    """Confirmed swing highs and lows, k bars late: struct(price, rsi) or NULL."""
    full = w.rowsBetween(-2 * k, 0)
    before, after = w.rowsBetween(-2 * k, -k - 1), w.rowsBetween(-k + 1, 0)
    ready = (F.count("high").over(full) == 2 * k + 1) & (F.count(rsi).over(full) == 2 * k + 1)
    low_ready = ready & (F.count("low").over(full) == 2 * k + 1)
    hi, lo, mid = _lag("high", w, k), _lag("low", w, k), _lag(rsi, w, k)
    # The first of several equal extremes counts, hence strict before and loose after.
    peak = ready & (hi > F.max("high").over(before)) & (hi >= F.max("high").over(after))
    dip = low_ready & (lo < F.min("low").over(before)) & (lo <= F.min("low").over(after))
    return df.withColumns(
        {
            "_peak": F.when(peak, F.struct(hi.alias("price"), mid.alias("rsi"))),
            "_dip": F.when(dip, F.struct(lo.alias("price"), mid.alias("rsi"))),
        }
    )


def add_rsi_divergence(
    df: DataFrame, keys=("symbol",), k: int = 3, hold_bars: int = 5, rsi: str = "rsi",
    marked: bool = False, rows: int = 16384,
) -> DataFrame:
    """Price makes a new swing extreme that RSI does not confirm, held for some bars.

    The previous swing may lie any distance back, so it is carried across slices.
    """
    if not marked:
        df = over_slices(df, keys, [lambda d, w: mark_swings(d, w, k, rsi)], 2 * k, rows=rows)
    df = running(
        df, keys, [RN], rn_bucket(rows),
        {"_peak0": ("before", F.col("_peak")), "_dip0": ("before", F.col("_dip"))},
    )
    bear = (F.col("_peak.price") > F.col("_peak0.price")) & (F.col("_peak.rsi") < F.col("_peak0.rsi"))
    bull = (F.col("_dip.price") < F.col("_dip0.price")) & (F.col("_dip.rsi") > F.col("_dip0.rsi"))
    one = F.lit(1.0)
    df = df.withColumns(
        {
            "_bear": F.when(bear, one).otherwise(0.0),
            "_bull": F.when(bull, one).otherwise(0.0),
        }
    ).drop("_peak", "_dip", "_peak0", "_dip0")

    def hold(d, w):
        f = w.rowsBetween(-(hold_bars - 1), 0)
        return d.withColumns(
            {"rsi_bull_div": F.max("_bull").over(f), "rsi_bear_div": F.max("_bear").over(f)}
        )

    return over_slices(df, keys, [hold], max(hold_bars - 1, 0), rows=rows).drop("_bear", "_bull")
