"""Order-book signals per snapshot, state over time, and features per bar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tapeflow.functions.book import BOOK, BookRules
from tapeflow.functions import book as ob
from tapeflow.functions.numeric import div, zero_fill
from tapeflow.functions.rolling import add_ema, ema_reach, ema_span_limit, roll_zscore
from tapeflow.operators.asof import asof_join
from tapeflow.plans.ranges import RANGE, ranged
from tapeflow.plans.slices import RN, number_rows, over_slices, rn_bucket, running, time_bucket


def signals(books: DataFrame, rules: BookRules = BOOK) -> DataFrame:
    """One signal row per snapshot with the published roundings. A pure projection.

    Each walk over a side's levels happens once: sums, best level and walls first,
    everything else from those scalars.
    """
    scalars = books.select(
        "symbol", "ts",
        ob.side_volume("bids", rules.imbalance_levels).alias("_bv"),
        ob.side_volume("asks", rules.imbalance_levels).alias("_av"),
        F.size(F.coalesce("bids", F.array())).alias("_nb"),
        F.size(F.coalesce("asks", F.array())).alias("_na"),
        F.try_element_at("bids", F.lit(1)).alias("_b"),
        F.try_element_at("asks", F.lit(1)).alias("_a"),
        F.size(ob.walls("bids", rules)).cast("long").alias("bid_walls"),
        F.size(ob.walls("asks", rules)).cast("long").alias("ask_walls"),
    )
    bv, av, b, a = (F.col(c) for c in ("_bv", "_av", "_b", "_a"))
    derived = scalars.withColumns(
        {
            "_raw": ob.imbalance_of(bv, av),
            "_mid": ob.mid_of(b.price, a.price),
            "_ok": ob.reliable_of(bv, av, F.col("_nb"), F.col("_na"), rules),
        }
    )
    mid, raw = F.col("_mid"), F.col("_raw")
    derived = derived.withColumn("_mp", ob.microprice_of(b, a, mid))
    skew = F.when(mid > 0, div(F.col("_mp") - mid, mid)).otherwise(F.lit(0.0))
    return derived.select(
        "symbol", "ts",
        ob.pressure(raw, rules).alias("state"),
        F.round(raw, 4).alias("imbalance"),
        F.round(ob.confidence(raw), 1).alias("confidence"),
        F.round(ob.rel_spread_of(b.price, a.price, mid), 6).alias("rel_spread"),
        F.round(mid, 2).alias("mid_price"),
        F.round("_mp", 2).alias("microprice"),
        F.round(skew, 6).alias("micro_skew"),
        "bid_walls", "ask_walls", F.col("_ok").alias("reliable"),
    )


def add_hysteresis(
    df: DataFrame, value: str, out: str = "state", keys: Sequence[str] = ("symbol",),
    rules: BookRules = BOOK, rows: int = 16384, given: str | None = None,
) -> DataFrame:
    """Enter a directional state past ``enter``, keep it until inside ``leave``.

    A value beyond +/-enter or within +/-leave fixes the state whatever came before.
    In between, a state survives only if no value on the other side followed the
    fixing one. So the state needs three "last seen" positions, which carry over
    slices. Needs ``rn``. A row's ``given`` state, if any, holds whatever its value.
    """
    v = F.col(value)
    fixed = (
        F.when(v > rules.enter, F.lit(1))
        .when(v < -rules.enter, F.lit(-1))
        .when(F.abs(v) <= rules.leave, F.lit(0))
    )
    if given is not None:
        code = F.when(F.col(given) == "BUY PRESSURE", 1).when(F.col(given) == "SELL PRESSURE", -1)
        fixed = F.when(F.col(given).isNotNull(), F.coalesce(code, F.lit(0))).otherwise(fixed)
    soft_up = (v > rules.leave) & (v <= rules.enter)
    soft_down = (v < -rules.leave) & (v >= -rules.enter)
    at = F.col(RN)
    df = running(
        df, keys, [RN], rn_bucket(rows),
        {
            "_fix": ("last", F.when(fixed.isNotNull(), F.struct(fixed.alias("to"), at.alias("at")))),
            "_up": ("max", F.when(soft_up, at)),
            "_down": ("max", F.when(soft_down, at)),
        },
    )
    since = lambda c: F.coalesce(F.col(c) > F.col("_fix.at"), F.lit(False))
    state = (
        F.when((F.col("_fix.to") == 1) & ~since("_down"), "BUY PRESSURE")
        .when((F.col("_fix.to") == -1) & ~since("_up"), "SELL PRESSURE")
        .otherwise("BALANCED")
    )
    return df.withColumn(out, state).drop("_fix", "_up", "_down")


def track(signal_rows: DataFrame, rules: BookRules = BOOK, rows: int = 16384, given: str | None = None) -> DataFrame:
    """The tracker over a history: smoothed imbalance and sticky state per symbol.

    Unreliable snapshots read THIN BOOK, keep the last smoothed value and change
    nothing. One task orders about ``rows`` snapshots, whatever share of them one symbol or
    one day holds. ``given`` names a column with the state a row is known to have, see
    ``add_hysteresis``. Pass a stored table.
    """
    keys = ["symbol"]
    signal_rows = ranged(signal_rows, keys, ["ts"], rows).drop("_at")
    state = [] if given is None else [given]
    solid = number_rows(
        signal_rows.where(F.col("reliable")).select("symbol", "ts", "imbalance", RANGE, *state),
        keys, ["ts"], F.col(RANGE),
    ).drop(RANGE)
    back = ema_reach(rules.alpha) if rules.alpha < 1 else 1
    span = max(ema_span_limit(rules.alpha) - back - 1, 1) if rules.alpha < 1 else 16384

    def smooth(df: DataFrame, w: WindowSpec) -> DataFrame:
        if rules.alpha == 1:
            return df.withColumn("ema", F.col("imbalance"))
        return add_ema(df, w, "imbalance", "ema", rules.alpha)

    solid = over_slices(solid, keys, [smooth], back, rows=span)
    solid = add_hysteresis(solid, "ema", "held", keys, rules, given=given)
    joined = signal_rows.withColumnRenamed("imbalance", "raw_imbalance").join(
        solid.select("symbol", "ts", "ema", "held"), ["symbol", "ts"], "left"
    )
    known = running(joined, keys, ["ts"], F.col(RANGE), {"_ema": ("last", F.col("ema"))})
    ok = F.col("reliable")
    return known.withColumns(
        {
            "state": F.when(ok, F.col("held")).otherwise("THIN BOOK"),
            "smoothed": F.coalesce("_ema", F.lit(0.0)),
            "imbalance": F.round(F.coalesce("_ema", F.lit(0.0)), 4),
            "confidence": F.when(ok, F.round(ob.confidence(F.col("ema")), 1)).otherwise(0.0),
        }
    ).drop("ema", "held", "_ema", RANGE)


def bar_spans(bars: DataFrame, rows: int = 16384) -> DataFrame:
    """Each bar owns the time after the previous bar up to itself. Needs ``rn``.

    The first bar is given the length of the gap to the second.
    """

    def step(df, w):
        prev, nxt = F.lag("ts").over(w), F.lead("ts").over(w)
        first = F.col("ts") - (nxt - F.col("ts"))
        return df.withColumn("span_start", F.coalesce(prev, first))

    slim = bars.select("symbol", "ts", RN)
    return over_slices(slim, ["symbol"], [step], 1, 1, rows).drop(RN)


def assign_to_bars(
    history: DataFrame, bars: DataFrame, bucket: Column | None = None
) -> DataFrame:
    """Snapshots with the bar they belong to; those outside every bar drop out."""
    spans = bar_spans(bars).withColumn("bar_ts", F.col("ts"))
    bucket = time_bucket(F.col("ts"), 1.0) if bucket is None else bucket
    met = asof_join(
        history, spans, ["symbol"], "ts", ["bar_ts", "span_start"], bucket, forward=True
    )
    inside = F.col("ts") > F.col("match.span_start")
    return met.where(inside).withColumn("bar_ts", F.col("match.bar_ts")).drop("match")


def _last_known(col: str) -> Column:
    return F.max(F.when(F.col(col).isNotNull(), F.struct("ts", col))).getField(col).alias(col)


def add_book_features(
    bars: DataFrame, history: DataFrame | None, window: int = 20, rows: int = 16384
) -> DataFrame:
    """Four order-book columns per bar from the snapshots inside it. Needs ``rn``."""
    names = ["depth_imbalance", "wall_persistence", "microprice_drift", "spread_regime"]
    if history is None:
        return bars.withColumns({c: F.lit(0.0) for c in names})
    per_bar = (
        assign_to_bars(history, bars)
        .groupBy("symbol", F.col("bar_ts").alias("ts"))
        .agg(
            _last_known("imbalance"), _last_known("micro_skew"), _last_known("rel_spread"),
            F.avg(F.col("bid_walls") + F.col("ask_walls")).alias("_walls"),
        )
    )
    joined = bars.join(per_bar, ["symbol", "ts"], "left")

    def step(df, w):
        drift = F.col("micro_skew") - F.lag("micro_skew").over(w)
        regime = roll_zscore(F.col("rel_spread"), w, window, need=3)
        return df.withColumns(
            {
                "depth_imbalance": zero_fill(F.col("imbalance")),
                "wall_persistence": zero_fill(F.col("_walls")),
                "microprice_drift": zero_fill(drift),
                "spread_regime": zero_fill(regime),
            }
        )

    out = over_slices(joined, ["symbol"], [step], window, rows=rows)
    return out.drop("imbalance", "micro_skew", "rel_spread", "_walls")
