"""Bars, validation, technical, microstructure and smoothing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeflow.config import MICRO
from tapeflow.operators import micro, smoothing, technical
from tapeflow.plans.slices import over_slices
from tapeflow.queries.registry import (
    DAILY, HOURLY, ORD, daily, gate, hourly, query, r, rs, show, win, zscore,
)

KEYS = ["symbol"]


def _bounded(bars, step, back, ahead=0):
    return over_slices(bars, KEYS, [step], back, ahead)


def _smooth(bars, *steps):
    return over_slices(bars, KEYS, steps, technical.SMOOTH_BACK, rows=technical.SMOOTH_ROWS)


@query("returns", f"""WITH {HOURLY} SELECT symbol, ts,
  {rs(**{f'ret_{k}d': f'close / nullif(lag(close, {k}) OVER {ORD}, 0) - 1' for k in (1, 5, 10)})}
  FROM hourly""")
def returns(spark, sf):
    df = _bounded(hourly(spark, sf), technical.add_returns, 10)
    return show(df, "ret_1d", "ret_5d", "ret_10d")


# The recursion walks every symbol bar by bar: an independent form of the smoother.
def _ema_sql(src_cte: str, x: str, alpha: str, seed_rn: int = 0) -> str:
    return f"""WITH RECURSIVE {src_cte},
  walk AS (
    SELECT symbol, ts, rn, {x} AS y FROM src WHERE rn = {seed_rn}
    UNION ALL
    SELECT s.symbol, s.ts, s.rn, ({alpha}) * s.{x} + (1 - ({alpha})) * w.y
    FROM walk w JOIN src s ON s.symbol = w.symbol AND s.rn = w.rn + 1)"""


_NUM = f"row_number() OVER {ORD} - 1 AS rn"


@query("ema", _ema_sql(f"{DAILY}, src AS (SELECT *, {_NUM} FROM daily)", "close", "2.0/11")
       + f" SELECT symbol, ts, {r('y')} AS ema FROM walk")
def ema(spark, sf):
    from tapeflow.functions.rolling import add_ema, span_alpha

    df = _smooth(daily(spark, sf), lambda d, w: add_ema(d, w, "close", "ema", span_alpha(10)))
    return show(df, "ema")


RSI_CTE = f"""{HOURLY},
  steps AS (SELECT *, {_NUM}, coalesce(close - lag(close) OVER {ORD}, 0) AS d FROM hourly),
  src AS (SELECT symbol, ts, rn, greatest(d, 0) AS up, greatest(-d, 0) AS dn, high, low, close,
                 volume FROM steps),
  walk AS (
    SELECT symbol, rn, up AS su, dn AS sd FROM src WHERE rn = 0
    UNION ALL
    SELECT s.symbol, s.rn, s.up / 14.0 + (1 - 1 / 14.0) * w.su, s.dn / 14.0 + (1 - 1 / 14.0) * w.sd
    FROM walk w JOIN src s ON s.symbol = w.symbol AND s.rn = w.rn + 1),
  rsi AS (SELECT s.symbol, s.ts, s.rn, s.high, s.low, s.close, CASE WHEN w.rn < 13 THEN NULL
            WHEN sd = 0 THEN 1.0 ELSE 1 - 1 / (1 + su / sd) END AS rsi
          FROM walk w JOIN src s ON s.symbol = w.symbol AND s.rn = w.rn)"""


@query("rsi", f"WITH RECURSIVE {RSI_CTE} SELECT symbol, ts, {r('rsi')} AS rsi FROM rsi")
def rsi(spark, sf):
    return show(_smooth(hourly(spark, sf), technical.add_rsi), "rsi")


def _swing(price: str, cmp: str, far: str) -> str:
    """Confirmed swing at lag 3 in SQL: strict before, loose after."""
    return f"""lag({price}, 3) OVER o {cmp} {far}({price}) OVER (o ROWS BETWEEN 6 PRECEDING AND 4 PRECEDING)
       AND lag({price}, 3) OVER o {cmp}= {far}({price}) OVER (o ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
       AND count(rsi) OVER (o ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) = 7"""


@query("rsi_divergence", f"""WITH RECURSIVE {RSI_CTE},
  marks AS (SELECT *, lag(high, 3) OVER o AS ph, lag(low, 3) OVER o AS pl, lag(rsi, 3) OVER o AS pr,
      {_swing('high', '>', 'max')} AS is_peak, {_swing('low', '<', 'min')} AS is_dip
    FROM rsi WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
  peaks AS (SELECT symbol, ts, ph > lag(ph) OVER {ORD} AND pr < lag(pr) OVER {ORD} AS hit
            FROM marks WHERE is_peak),
  dips AS (SELECT symbol, ts, pl < lag(pl) OVER {ORD} AND pr > lag(pr) OVER {ORD} AS hit
           FROM marks WHERE is_dip),
  flags AS (SELECT m.symbol, m.ts, CASE WHEN d.hit THEN 1.0 ELSE 0.0 END AS bull,
                   CASE WHEN p.hit THEN 1.0 ELSE 0.0 END AS bear
            FROM marks m LEFT JOIN peaks p USING (symbol, ts) LEFT JOIN dips d USING (symbol, ts))
  SELECT symbol, ts, (max(bull) OVER {win(5)})::DOUBLE AS rsi_bull_div,
         (max(bear) OVER {win(5)})::DOUBLE AS rsi_bear_div FROM flags""")
def rsi_divergence(spark, sf):
    steps = (technical.add_rsi, technical.mark_swings)
    df = technical.add_rsi_divergence(_smooth(hourly(spark, sf), *steps), marked=True)
    return df.select("symbol", "ts", "rsi_bull_div", "rsi_bear_div")


@query("macd", f"""WITH RECURSIVE {DAILY}, src AS (SELECT *, {_NUM} FROM daily),
  walk AS (
    SELECT symbol, rn, close AS f, close AS s FROM src WHERE rn = 0
    UNION ALL
    SELECT b.symbol, b.rn, b.close * (2.0/13) + w.f * (1 - 2.0/13),
           b.close * (2.0/27) + w.s * (1 - 2.0/27)
    FROM walk w JOIN src b ON b.symbol = w.symbol AND b.rn = w.rn + 1),
  line AS (SELECT symbol, rn, f - s AS m FROM walk WHERE rn >= 25),
  sig AS (
    SELECT symbol, rn, m, m AS y FROM line WHERE rn = 25
    UNION ALL
    SELECT l.symbol, l.rn, l.m, l.m * 0.2 + g.y * 0.8
    FROM sig g JOIN line l ON l.symbol = g.symbol AND l.rn = g.rn + 1)
  SELECT b.symbol, b.ts, CASE WHEN b.rn >= 33 THEN {r('(g.m - g.y) / b.close')} END AS macd_diff
  FROM src b LEFT JOIN sig g ON g.symbol = b.symbol AND g.rn = b.rn""")
def macd(spark, sf):
    return show(_smooth(daily(spark, sf), technical.add_macd), "macd_diff")


@query("bollinger", f"""WITH {HOURLY}, b AS (SELECT *, {gate('avg', 'close', 20)} AS m,
    {gate('stddev_pop', 'close', 20)} AS s FROM hourly)
  SELECT symbol, ts, {r('(close - (m - 2 * s)) / nullif(4 * s, 0)')} AS bb_pband FROM b""")
def bollinger(spark, sf):
    return show(_bounded(hourly(spark, sf), technical.add_bollinger, 20), "bb_pband")


ATR_CTE = f"""{HOURLY},
  tr AS (SELECT *, {_NUM}, greatest(high - low, abs(high - lag(close) OVER {ORD}),
                abs(low - lag(close) OVER {ORD})) AS t FROM hourly),
  src AS (SELECT *, avg(t) OVER {win(14)} AS seed FROM tr),
  walk AS (
    SELECT symbol, rn, seed AS y FROM src WHERE rn = 13
    UNION ALL
    SELECT s.symbol, s.rn, (w.y * 13 + s.t) / 14
    FROM walk w JOIN src s ON s.symbol = w.symbol AND s.rn = w.rn + 1),
  atr AS (SELECT s.*, coalesce(w.y, 0) / s.close AS atr_pct
          FROM src s LEFT JOIN walk w ON w.symbol = s.symbol AND w.rn = s.rn)"""


@query("atr", f"WITH RECURSIVE {ATR_CTE} SELECT symbol, ts, {r('atr_pct')} AS atr_pct FROM atr")
def atr(spark, sf):
    return show(_smooth(hourly(spark, sf), technical.add_atr), "atr_pct")


@query("volume_features", f"""WITH {HOURLY} SELECT symbol, ts,
  {rs(vol_chg=f'volume / nullif(lag(volume) OVER {ORD}, 0) - 1',
      vol_ratio=f"volume / nullif({gate('avg', 'volume', 20)}, 0)")} FROM hourly""")
def volume_features(spark, sf):
    return show(_bounded(hourly(spark, sf), technical.add_volume, 20), "vol_chg", "vol_ratio")


@query("ma_distances", f"""WITH RECURSIVE {DAILY}, src AS (SELECT *, {_NUM}, {gate('avg', 'close', 50)} AS sma FROM daily),
  walk AS (SELECT symbol, rn, close AS y FROM src WHERE rn = 0
    UNION ALL SELECT b.symbol, b.rn, b.close * (2.0/21) + w.y * (1 - 2.0/21)
    FROM walk w JOIN src b ON b.symbol = w.symbol AND b.rn = w.rn + 1),
  e AS (SELECT b.*, CASE WHEN b.rn >= 19 THEN w.y END AS ema
        FROM src b JOIN walk w ON w.symbol = b.symbol AND w.rn = b.rn)
  SELECT symbol, ts, {rs(ema20_dist='(close - ema) / ema', sma50_dist='(close - sma) / sma',
                         ema_sma_dist='(ema - sma) / sma')} FROM e""")
def ma_distances(spark, sf):
    df = _smooth(daily(spark, sf), technical.add_ma_distances)
    return show(df, "ema20_dist", "sma50_dist", "ema_sma_dist")


@query("forward_target", f"""WITH {DAILY} SELECT symbol, ts,
  {r(f'lead(close, 5) OVER {ORD} / nullif(close, 0) - 1')} AS target FROM daily""")
def forward_target(spark, sf):
    return show(_bounded(daily(spark, sf), technical.add_target, 0, ahead=5), "target")


# --- microstructure --------------------------------------------------------------

@query("volume_delta", f"""WITH {HOURLY}, d AS (SELECT *,
    coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume AS vd FROM hourly)
  SELECT symbol, ts, {r(f"coalesce({zscore('vd', 20)}, 0)")} AS vol_delta FROM d""")
def volume_delta(spark, sf):
    return show(_bounded(hourly(spark, sf), micro.add_volume_delta, 20), "vol_delta")


AMIHUD_CTE = f"""{HOURLY}, i AS (SELECT *, abs(close / nullif(lag(close) OVER {ORD}, 0) - 1)
      / nullif(close * volume, 0) * 1e9 AS x FROM hourly),
  a AS (SELECT *, {gate('avg', 'x', 5)} AS raw FROM i)"""


@query("amihud", f"""WITH {AMIHUD_CTE} SELECT symbol, ts, round(raw, 2) + 0.0 AS amihud_raw,
  {r(f"coalesce({zscore('raw', 60)}, 0)")} AS amihud_illiq FROM a""")
def amihud(spark, sf):
    df = _bounded(hourly(spark, sf), micro.add_amihud, 66)
    return df.select(
        "symbol", "ts", (F.round("amihud_raw", 2) + 0.0).alias("amihud_raw"),
        (F.round("amihud_illiq", 6) + 0.0).alias("amihud_illiq"),
    )


@query("roll_spread", f"""WITH {HOURLY}, d AS (SELECT *, close - lag(close) OVER {ORD} AS dp FROM hourly),
  e AS (SELECT *, lag(dp) OVER {ORD} AS dp1 FROM d),
  c AS (SELECT *, CASE WHEN count(dp) OVER {win(20)} = 20 THEN covar_samp(dp1, dp) OVER {win(19)} END AS cov FROM e)
  SELECT symbol, ts, CASE WHEN cov IS NOT NULL THEN {r('2 * sqrt(abs(least(cov, 0))) / close')} END AS roll_spread FROM c""")
def roll_spread(spark, sf):
    return show(_bounded(hourly(spark, sf), micro.add_roll_spread, 22), "roll_spread")


@query("kyle_lambda", f"""WITH {HOURLY}, d AS (SELECT *, close / nullif(lag(close) OVER {ORD}, 0) - 1 AS ret FROM hourly),
  e AS (SELECT *, sign(ret) * volume AS sv FROM d)
  SELECT symbol, ts, {r(f"CASE WHEN count(ret) OVER {win(20)} = 20 THEN covar_samp(ret, sv) OVER {win(20)} END / nullif(var_samp(volume) OVER {win(20)}, 0)")} AS kyle_lambda
  FROM e""")
def kyle_lambda(spark, sf):
    return show(_bounded(hourly(spark, sf), micro.add_kyle_lambda, 21), "kyle_lambda")


VWAP = (f"CASE WHEN count(*) OVER {win(20)} = 20 THEN "
        f"sum((high + low + close) / 3 * volume) OVER {win(20)} / nullif(sum(volume) OVER {win(20)}, 0) END")


@query("vwap_distance", f"""WITH {HOURLY}, v AS (SELECT *, {VWAP} AS vwap FROM hourly)
  SELECT symbol, ts, {r('(close - vwap) / vwap')} AS vwap_dist FROM v""")
def vwap_distance(spark, sf):
    return show(_bounded(hourly(spark, sf), micro.add_vwap_distance, 20), "vwap_dist")


@query("bar_range", f"WITH {HOURLY} SELECT symbol, ts, {r('(high - low) / nullif(close, 0)')} AS hl_range FROM hourly")
def bar_range(spark, sf):
    from tapeflow.sources import tables

    return show(micro.add_range(tables.hourly_bars(spark, sf)), "hl_range")


def _savgol_sql(deriv: int) -> str:
    taps = smoothing.savgol_taps(11, 3, deriv)
    return " + ".join(
        f"({t!r}) * lag(close, {10 - i}) OVER {ORD}" for i, t in enumerate(taps)
    )


@query("savgol", f"""WITH {DAILY}, s AS (SELECT symbol, ts, close, {_savgol_sql(0)} AS level,
    {_savgol_sql(1)} AS slope FROM daily)
  SELECT symbol, ts, {r('level / close')} AS savgol_level, {r('slope / close')} AS savgol_slope FROM s""")
def savgol(spark, sf):
    def step(d, w):
        d = d.withColumn("savgol_level", smoothing.savgol("close", w) / F.col("close"))
        return smoothing.add_savgol_slope(d, w)

    return show(_bounded(daily(spark, sf), step, 11), "savgol_level", "savgol_slope")


@query("ema_slope", _ema_sql(f"{DAILY}, src AS (SELECT *, {_NUM} FROM daily)", "close", "2.0/11")
       + f""", j AS (SELECT w.symbol, w.ts, w.y, s.close FROM walk w JOIN src s USING (symbol, rn))
       SELECT symbol, ts, {r(f'(y - lag(y) OVER {ORD}) / close')} AS ema_slope FROM j""")
def ema_slope(spark, sf):
    return show(_smooth(daily(spark, sf), smoothing.add_ema_slope), "ema_slope")


MICRO_CTE = f"""{AMIHUD_CTE}, m0 AS (SELECT *, {VWAP} AS vwap, coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume AS vd,
    close - lag(close) OVER {ORD} AS dp, close / nullif(lag(close) OVER {ORD}, 0) - 1 AS r1, {gate('avg', 'close', 20)} AS m20, {gate('stddev_pop', 'close', 20)} AS s20,
    {gate('avg', 'close', 50)} AS m50 FROM a),
  m1 AS (SELECT *, lag(dp) OVER {ORD} AS dp1, sign(r1) * volume AS sv FROM m0),
  m2 AS (SELECT *, CASE WHEN count(dp) OVER {win(20)} = 20 THEN covar_samp(dp1, dp) OVER {win(19)} END AS cov FROM m1),
  m3 AS (SELECT symbol, ts, r1 AS ret_1d, close / nullif(lag(close, 5) OVER {ORD}, 0) - 1 AS ret_5d, close / nullif(lag(close, 10) OVER {ORD}, 0) - 1 AS ret_10d,
    (close - (m20 - 2 * s20)) / nullif(4 * s20, 0) AS bb_pband, volume / nullif(lag(volume) OVER {ORD}, 0) - 1 AS vol_chg,
    volume / nullif({gate('avg', 'volume', 20)}, 0) AS vol_ratio, (close - m50) / m50 AS sma50_dist,
    coalesce({zscore('vd', 20)}, 0) AS vol_delta, coalesce({zscore('raw', 60)}, 0) AS amihud_illiq,
    CASE WHEN cov IS NOT NULL THEN 2 * sqrt(abs(least(cov, 0))) / close END AS roll_spread,
    CASE WHEN count(r1) OVER {win(20)} = 20 THEN covar_samp(r1, sv) OVER {win(20)} END / nullif(var_samp(volume) OVER {win(20)}, 0) AS kyle_lambda,
    (close - vwap) / vwap AS vwap_dist, (high - low) / nullif(close, 0) AS hl_range, lead(close, 5) OVER {ORD} / nullif(close, 0) - 1 AS target FROM m2)"""


@query("micro_features", f"WITH {MICRO_CTE} SELECT symbol, ts, {rs(**{c: c for c in MICRO})} FROM m3")
def micro_features(spark, sf):
    return show(_bounded(hourly(spark, sf), micro.add_micro, micro.BACK), *MICRO)
