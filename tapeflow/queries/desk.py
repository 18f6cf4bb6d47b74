"""Pair trading, backtest tables, risk, portfolio accounting and prediction resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeflow.operators import backtest, pairs, paper, portfolio, risk, signals
from tapeflow.plans.tables import keep
from tapeflow.plans.slices import RN, number_rows, over_slices, rn_bucket, running, time_bucket
from tapeflow.queries.registry import BRAND, DAILY, ORD, query, r, r6, rs, show
from tapeflow.queries.strategy import BASE, TH, base, preds
from tapeflow.sources import ledger, tables
from tapeflow.sources.store import scratch_folder

# --- pairs: every brand against the first ------------------------------------------------
PAIRS = [(f"Brand#{i}", "Brand#1") for i in range(2, 26)]
ALIGN = f"""{BRAND}, al0 AS (SELECT y.symbol || '~' || x.symbol AS pair, y.ts, y.close AS y, x.close AS x FROM brand y
    JOIN brand x ON x.ts = y.ts AND x.symbol = 'Brand#1' AND y.symbol <> 'Brand#1'),
  al AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY ts) - 1 AS rn, count(*) OVER (PARTITION BY pair) AS n FROM al0)"""


def _aligned(spark, sf):
    rows = pairs.align_pairs(keep(tables.brand_bars(spark, sf)), PAIRS)
    return keep(number_rows(rows, ["pair"], ["ts"], time_bucket(F.col("ts"), 3650.0), total="n"))


@query("pair_alignment", f"WITH {ALIGN} SELECT pair, ts, rn, {rs(y='y', x='x')} FROM al")
def pair_alignment(spark, sf):
    return show(_aligned(spark, sf), "y", "x", keys=("pair", "ts", "rn"))


def _fit_sql(keys, src):
    return f"""SELECT {keys}, count(*) AS n_train, regr_slope(y, x) AS beta, regr_intercept(y, x) AS alpha FROM {src} GROUP BY ALL"""


PFOLD = f"""{ALIGN}, pf AS (SELECT DISTINCT pair, n, f FROM (SELECT DISTINCT pair, n FROM al), LATERAL (SELECT unnest(generate_series(0, (n - 400) // 100)) AS f)),
  ptrain AS (SELECT al.pair, f AS fold_id, rn, y, x FROM al JOIN pf ON al.pair = pf.pair AND rn >= f * 100 AND rn < f * 100 + 299),
  pfit0 AS ({_fit_sql('pair, fold_id', 'ptrain')}),
  pfit AS (SELECT f.*, avg(y - (alpha + beta * x)) AS mu, stddev_pop(y - (alpha + beta * x)) AS sd FROM ptrain t JOIN pfit0 f USING (pair, fold_id) GROUP BY ALL),
  ptest AS (SELECT al.pair, f AS fold_id, rn, y - (alpha + beta * x) AS spread, (y - (alpha + beta * x) - mu) / sd AS z
    FROM al JOIN pf ON al.pair = pf.pair AND rn >= f * 100 + 300 AND rn < f * 100 + 400 JOIN pfit ON pfit.pair = al.pair AND fold_id = f)"""


def _folds(spark, sf):
    from tapeflow.operators.splits import add_folds

    return add_folds(_aligned(spark, sf), 300, 100, None, 1)


@query("hedge_ratio", f"WITH {PFOLD} SELECT pair, fold_id, n_train, {rs(beta='beta', alpha='alpha')} FROM pfit")
def hedge_ratio(spark, sf):
    fit = pairs.hedge_fit(_folds(spark, sf).where("part = 'train'"), ["pair", "fold_id"])
    return show(fit, "beta", "alpha", keys=("pair", "fold_id", "n_train"))


def _tested(spark, sf):
    f = _folds(spark, sf)
    fit = pairs.hedge_fit(f.where("part = 'train'"), ["pair", "fold_id"])
    return pairs.add_spread(f.where("part = 'test'"), fit, ["pair", "fold_id"])


@query("pair_spread", f"WITH {PFOLD} SELECT pair, fold_id, rn, {r('spread')} AS spread FROM ptest")
def pair_spread(spark, sf):
    return show(_tested(spark, sf), "spread", keys=("pair", "fold_id", "rn"))


@query("pair_zscore", f"WITH {PFOLD} SELECT pair, fold_id, rn, {r('z')} AS z FROM ptest")
def pair_zscore(spark, sf):
    return show(_tested(spark, sf), "z", keys=("pair", "fold_id", "rn"))


def _walk_sql(name, src, keys, entry="entry", leave="leave"):
    """Replays the position rule bar by bar. ``src`` needs keys, k (from 1), z, spread."""
    on = " AND ".join(f"s.{k} = w.{k}" for k in keys)
    cols, scols = ", ".join(keys), ", ".join(f"s.{k}" for k in keys)
    return f"""{name} AS (
    SELECT {cols}, k, CASE WHEN z > {entry} THEN -1.0 WHEN z < -{entry} THEN 1.0 ELSE 0.0 END::DOUBLE AS position FROM {src} WHERE k = 1
    UNION ALL SELECT {scols}, s.k, CASE WHEN w.position = 0 THEN CASE WHEN s.z > s.{entry} THEN -1.0 WHEN s.z < -s.{entry} THEN 1.0 ELSE 0.0 END
      WHEN abs(s.z) < s.{leave} THEN 0.0 ELSE w.position END::DOUBLE FROM {name} w JOIN {src} s ON {on} AND s.k = w.k + 1)"""


def _trades_sql(src, walk, keys, out):
    """Gaps and islands over the replayed positions."""
    cols, part = ", ".join(keys), f"PARTITION BY {', '.join(keys)}"
    return f"""{out}0 AS (SELECT s.*, position, coalesce(position * (lead(spread) OVER (PARTITION BY {', '.join('s.' + k for k in keys)} ORDER BY s.k) - spread), 0) AS pnl
      FROM {src} s JOIN {walk} USING ({cols}, k)),
    {out}1 AS (SELECT *, position <> 0 AND position <> coalesce(lag(position) OVER ({part} ORDER BY k), 0) AS starts FROM {out}0),
    {out}2 AS (SELECT *, sum(starts::INT) OVER ({part} ORDER BY k) AS run FROM {out}1),
    {out} AS (SELECT {cols}, run, sum(pnl) - 0.5 AS trade_pnl, count(*) AS bars, min(rn) AS trade_rn FROM {out}2 WHERE position <> 0 GROUP BY {cols}, run)"""


LONG = f"""{ALIGN}, lf0 AS ({_fit_sql('pair', 'al')}), lf AS (SELECT f.*, avg(y - (alpha + beta * x)) AS mu, stddev_pop(y - (alpha + beta * x)) AS sd
    FROM al JOIN lf0 f USING (pair) GROUP BY ALL),
  ls AS (SELECT pair, rn, rn + 1 AS k, y - (alpha + beta * x) AS spread, (y - (alpha + beta * x) - mu) / sd AS z, 1.0::DOUBLE AS entry, 0.25::DOUBLE AS leave
    FROM al JOIN lf USING (pair)), {_walk_sql('lw', 'ls', ['pair'])}"""


def _long(spark, sf):
    rows = _aligned(spark, sf)
    scored = pairs.add_spread(rows, pairs.hedge_fit(rows, ["pair"]), ["pair"]).select("pair", RN, "spread", "z")
    return pairs.add_positions(keep(scored), ["pair"], 1.0, 0.25, rows=256)


@query("pair_positions", f"WITH RECURSIVE {LONG} SELECT pair, k - 1 AS rn, position + 0.0 AS position FROM lw")
def pair_positions(spark, sf):
    """The unbounded form, carried over slices of 256 rows."""
    return _long(spark, sf).select("pair", RN, (F.col("position") + 0.0).alias("position"))


@query("pair_trades", f"WITH RECURSIVE {LONG}, {_trades_sql('ls', 'lw', ['pair'], 'lt')} SELECT pair, trade_rn, bars, {r('trade_pnl')} AS trade_pnl FROM lt")
def pair_trades(spark, sf):
    pos = pairs.add_pair_pnl(_long(spark, sf), ["pair"])
    return show(pairs.trades(pos, ["pair"], 0.5), "trade_pnl", keys=("pair", "trade_rn", "bars"))


GRIDV = [(1.5, 0.5), (2.0, 0.5), (1.0, 0.25)]
_GV = "(VALUES " + ", ".join(f"({e}::DOUBLE, {x}::DOUBLE, {i})" for i, (e, x) in enumerate(GRIDV)) + ") g(entry, leave, gi)"
WFT = f"""{PFOLD}, gt AS (SELECT *, row_number() OVER (PARTITION BY pair, fold_id, gi ORDER BY rn) AS k FROM ptest, {_GV}),
  {_walk_sql('gw', 'gt', ['pair', 'fold_id', 'gi'])}, {_trades_sql('gt', 'gw', ['pair', 'fold_id', 'gi'], 'wt')}"""


def _wft(spark, sf):
    return pairs.walk_forward_trades(_aligned(spark, sf), 300, 100, None, GRIDV, 0.5, 1)


@query("pair_walk_forward", f"""WITH RECURSIVE {WFT} SELECT pair, fold_id, g.entry, g.leave, trade_rn, bars, {r('trade_pnl')} AS trade_pnl
  FROM wt JOIN {_GV} USING (gi)""")
def pair_walk_forward(spark, sf):
    return show(_wft(spark, sf), "trade_pnl", keys=("pair", "fold_id", "entry", "leave", "trade_rn", "bars"))


_PSTAT = """count(*) AS n_trades, count(*) FILTER (WHERE trade_pnl > 0) AS wins, avg((trade_pnl > 0)::INT) AS win_rate,
    sum(trade_pnl) AS total_pnl, coalesce(avg(trade_pnl) / nullif(stddev_samp(trade_pnl), 0), 0) AS sharpe"""


def _tail_sql(w, n):
    return f"(SELECT sum(exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + {n} * ln(0.5))) FROM (SELECT unnest(range({w}, {n} + 1)) AS i))"


@query("pair_trade_stats", f"""WITH RECURSIVE {WFT}, ws AS (SELECT pair, gi, {_PSTAT} FROM wt GROUP BY 1, 2)
  SELECT pair, g.entry, g.leave, n_trades, wins, {rs(win_rate='win_rate', total_pnl='total_pnl', sharpe='sharpe', p_value=_tail_sql('wins', 'n_trades'))} FROM ws JOIN {_GV} USING (gi)""")
def pair_trade_stats(spark, sf):
    s = pairs.with_p_value(pairs.trade_stats(_wft(spark, sf), ["pair", "entry", "leave"]))
    return show(s, "win_rate", "total_pnl", "sharpe", "p_value", keys=("pair", "entry", "leave", "n_trades", "wins"))


JUDGE = f"""{ALIGN}, e AS (SELECT *, floor(n * 0.8::DOUBLE)::BIGINT AS edge FROM al),
  jf AS (SELECT DISTINCT pair, f FROM (SELECT DISTINCT pair, edge FROM e), LATERAL (SELECT unnest(generate_series(0, (edge - 160) // 40)) AS f)),
  jt AS (SELECT e.pair, f AS fold_id, y, x FROM e JOIN jf ON e.pair = jf.pair AND rn >= f * 40 AND rn < f * 40 + 119),
  jfit0 AS ({_fit_sql('pair, fold_id', 'jt')}), jfit AS (SELECT f.*, avg(y - (alpha + beta * x)) AS mu, stddev_pop(y - (alpha + beta * x)) AS sd FROM jt JOIN jfit0 f USING (pair, fold_id) GROUP BY ALL),
  js AS (SELECT e.pair, f AS fold_id, rn, y - (alpha + beta * x) AS spread, (y - (alpha + beta * x) - mu) / sd AS z FROM e
    JOIN jf ON e.pair = jf.pair AND rn >= f * 40 + 120 AND rn < f * 40 + 160 JOIN jfit ON jfit.pair = e.pair AND fold_id = f),
  jg AS (SELECT *, row_number() OVER (PARTITION BY pair, fold_id, gi ORDER BY rn) AS k FROM js, {_GV}),
  {_walk_sql('jw', 'jg', ['pair', 'fold_id', 'gi'])}, {_trades_sql('jg', 'jw', ['pair', 'fold_id', 'gi'], 'jtr')},
  jbest AS (SELECT pair, gi FROM (SELECT pair, gi, sum(trade_pnl) AS total_pnl FROM jtr GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY pair ORDER BY total_pnl DESC, gi) = 1),
  jall AS (SELECT p.pair, coalesce(gi, 0) AS gi FROM (SELECT DISTINCT pair FROM e WHERE edge >= 160) p LEFT JOIN jbest USING (pair)),
  hf0 AS (SELECT pair, regr_slope(y, x) AS beta, regr_intercept(y, x) AS alpha FROM e WHERE rn < edge GROUP BY 1),
  hf AS (SELECT pair, beta, alpha, avg(y - (alpha + beta * x)) AS mu, stddev_pop(y - (alpha + beta * x)) AS sd FROM e JOIN hf0 USING (pair) WHERE rn < edge GROUP BY ALL),
  hs AS (SELECT e.pair, rn, rn - edge + 1 AS k, y - (alpha + beta * x) AS spread, (y - (alpha + beta * x) - mu) / sd AS z, g.entry, g.leave FROM e JOIN hf USING (pair)
    JOIN jall USING (pair) JOIN {_GV} USING (gi) WHERE rn >= edge),
  {_walk_sql('hw', 'hs', ['pair'])}, {_trades_sql('hs', 'hw', ['pair'], 'ht')},
  hst AS (SELECT pair, {_PSTAT} FROM ht GROUP BY 1),
  hall AS (SELECT b.pair, g.entry, g.leave, coalesce(n_trades, 0) AS n_trades, coalesce(wins, 0) AS wins, coalesce(win_rate, 0) AS win_rate,
    coalesce(total_pnl, 0) AS total_pnl, coalesce(sharpe, 0) AS sharpe FROM jall b JOIN {_GV} USING (gi) LEFT JOIN hst USING (pair))"""


@query("pair_judgement", f"""WITH RECURSIVE {JUDGE}, hp AS (SELECT *, CASE WHEN n_trades = 0 THEN 1 ELSE {_tail_sql('wins', 'n_trades')} END AS p FROM hall)
  SELECT pair, entry, leave, n_trades, wins, {rs(win_rate='win_rate', total_pnl='total_pnl', sharpe='sharpe', p_value='p', deflated_p='1 - pow(1 - p, 3)')} FROM hp""")
def pair_judgement(spark, sf):
    out = pairs.judge_pairs(_aligned(spark, sf), GRIDV, 120, 40, 0.5, 1, "total_pnl")
    out = out.withColumns({c: F.col(c).cast("long") for c in ("n_trades", "wins")})
    return show(out, "win_rate", "total_pnl", "sharpe", "p_value", "deflated_p", keys=("pair", "entry", "leave", "n_trades", "wins"))


@query("adf_moments", f"""WITH {ALIGN}, mf AS ({_fit_sql('pair', 'al')}), ms AS (SELECT pair, rn, y - (alpha + beta * x) AS v FROM al JOIN mf USING (pair)),
  md AS (SELECT *, lag(v) OVER (PARTITION BY pair ORDER BY rn) AS l, v - lag(v) OVER (PARTITION BY pair ORDER BY rn) AS d FROM ms),
  mk AS (SELECT a.pair, k.k, coalesce(sum(a.d * b.d), 0) AS c, coalesce(sum(a.l * b.d), 0) AS x FROM md a JOIN (SELECT unnest(range(7)) AS k) k ON true
    LEFT JOIN md b ON b.pair = a.pair AND b.rn = a.rn - k.k GROUP BY ALL)
  SELECT pair, k::INT AS k, {rs(c='c / c0', x='x / c0')} FROM (SELECT *, first_value(c) OVER (PARTITION BY pair ORDER BY k) AS c0 FROM mk)""")
def adf_moments(spark, sf):
    """Sums of products of spread differences k apart, and of levels with the difference k before, as shares of the first."""
    rows = _aligned(spark, sf)
    spread = pairs.add_spread(rows, pairs.hedge_fit(rows, ["pair"]), ["pair"]).select("pair", RN, "spread")
    sums = pairs.adf_moments(keep(spread), ["pair"], "spread", 6, 256)
    c0 = F.col("first")
    long = sums.select("pair", F.col("c")[0].alias("first"), F.posexplode(F.arrays_zip("c", "x")).alias("k", "s"))
    return show(long.select("pair", "k", (F.col("s.c") / c0).alias("c"), (F.col("s.x") / c0).alias("x")), "c", "x", keys=("pair", "k"))


@query("cointegration")
def cointegration(spark, sf):
    return pairs.engle_granger(_aligned(spark, sf))


# --- backtest ------------------------------------------------------------------------------
_GAIN = "20 * sign(pred) * greatest(-1, least(1, coalesce(target, 0)))"
EQUITY = f"""{BASE}, eq AS (SELECT symbol, model, rn, ts, 10000 + sum({_GAIN}) OVER (PARTITION BY symbol, model ORDER BY ts) AS equity FROM preds),
  eq1 AS (SELECT *, equity / lag(equity) OVER (PARTITION BY symbol, model ORDER BY ts) - 1 AS ret, max(equity) OVER (PARTITION BY symbol, model ORDER BY ts) AS peak FROM eq)"""


def _equity(spark, sf):
    bound = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce("target", F.lit(0.0))))
    p = preds(spark, sf).withColumn("gain", F.signum("pred") * bound * 20.0)
    out = running(p, ["symbol", "model"], [RN], rn_bucket(256), {"total": ("sum", F.col("gain"))})
    return out.select("symbol", "model", RN, (F.col("total") + 10000.0).alias("equity"))


@query("equity_metrics", f"""WITH {EQUITY} SELECT symbol, model, {rs(total_return='(last(equity ORDER BY ts) - 10000) / 10000', final_equity='last(equity ORDER BY ts)',
  sharpe='coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(365), 0)', max_drawdown='min((equity - peak) / peak)')} FROM eq1 GROUP BY 1, 2""")
def equity_metrics(spark, sf):
    out = backtest.equity_metrics(_equity(spark, sf), ["symbol", "model"], rows=256)
    return show(out, "total_return", "final_equity", "sharpe", "max_drawdown", keys=("symbol", "model"))


LOG = """tl AS (SELECT l_linestatus AS model, CASE WHEN l_quantity = 50 THEN 'CLOSE' WHEN l_returnflag = 'A' THEN 'BUY'
    WHEN l_returnflag = 'N' THEN CASE WHEN l_quantity < 10 THEN 'STOP' ELSE 'SELL' END ELSE 'TIME_EXIT' END AS action, l_discount - 0.05 AS pnl, l_tax AS commission FROM lineitem)"""


@query("trade_log_metrics", f"""WITH {LOG} SELECT model, count(*) AS n_trades, count(*) FILTER (WHERE action <> 'BUY') AS n_closed,
  {rs(win_rate="count(*) FILTER (WHERE action <> 'BUY' AND pnl > 0) / nullif(count(*) FILTER (WHERE action <> 'BUY'), 0)", avg_pnl="avg(pnl) FILTER (WHERE action <> 'BUY')",
      max_win="max(pnl) FILTER (WHERE action <> 'BUY')", max_loss="min(pnl) FILTER (WHERE action <> 'BUY')", total_costs='sum(commission)')},
  count(*) FILTER (WHERE action = 'STOP') AS n_stop_losses FROM tl WHERE action <> 'CLOSE' GROUP BY 1""")
def trade_log_metrics(spark, sf):
    q, flag = F.col("l_quantity"), F.col("l_returnflag")
    action = F.when(q == 50, "CLOSE").when(flag == "A", "BUY").when(flag == "N", F.when(q < 10, "STOP").otherwise("SELL")).otherwise("TIME_EXIT")
    log = tables.table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("model"), action.alias("action"),
                                                     (F.col("l_discount") - 0.05).alias("pnl"), F.col("l_tax").alias("commission"))
    out = backtest.trade_log_metrics(log, ["model"])
    return show(out, "win_rate", "avg_pnl", "max_win", "max_loss", "total_costs", keys=("model", "n_trades", "n_closed", "n_stop_losses"))


OUTCOME = f"""{TH}, path AS (SELECT a.symbol, a.model, a.ts, a.rn, a.close * 1.0005 AS fill, f.rn - a.rn AS i, f.close AS px,
      CASE WHEN f.close <= a.close * 1.0005 * (1 - CASE WHEN f.atr_pct > 0 THEN greatest(0.01, least(0.15, f.atr_pct * 3)) ELSE 0.05 END) THEN 'STOP'
        WHEN f.rn - a.rn >= 5 THEN 'TIME_EXIT' WHEN f.pred < f.s THEN 'SELL' END AS act
    FROM th a JOIN th f ON f.symbol = a.symbol AND f.model = a.model AND f.rn BETWEEN a.rn + 1 AND a.rn + 5 WHERE a.pred > a.b),
  outcome AS (SELECT symbol, model, ts, arg_min(act, i) AS exit_action, min(i) AS bars_held, arg_min(px, i) * 0.9995 / any_value(fill) * 0.999 * 0.999 - 1 AS pnl
    FROM path WHERE act IS NOT NULL GROUP BY 1, 2, 3)"""


def _outcomes(spark, sf):
    b, s = signals.dynamic_thresholds(F.col("atr_pct"))
    p = preds(spark, sf).withColumns({"buy_th": b, "sell_th": s})
    out = over_slices(p, ["symbol", "model"], [backtest.add_signal_outcomes], 0, 5)
    return out.where((F.col("pred") > F.col("buy_th")) & F.col("exit_action").isNotNull())


@query("signal_outcomes", f"WITH {OUTCOME} SELECT symbol, model, ts, exit_action, bars_held::INT AS bars_held, {r('pnl')} AS pnl FROM outcome")
def signal_outcomes(spark, sf):
    return show(_outcomes(spark, sf), "pnl", keys=("symbol", "model", "ts", "exit_action", "bars_held"))


@query("best_candidates", f"""WITH {TH} SELECT ts, model, symbol, {rs(pred='pred', close='close')} FROM th WHERE pred > b
  QUALIFY row_number() OVER (PARTITION BY ts, model ORDER BY pred DESC, symbol) = 1""")
def best_candidates(spark, sf):
    b, s = signals.dynamic_thresholds(F.col("atr_pct"))
    p = preds(spark, sf).withColumns({"buy_th": b, "sell_th": s})
    return show(backtest.best_candidates(p, ["ts", "model"]), "pred", "close", keys=("ts", "model", "symbol"))


# --- risk -------------------------------------------------------------------------------------


@query("kelly_sizes", f"""WITH {OUTCOME}, k AS (SELECT symbol, model, count(*) AS n, count(*) FILTER (WHERE pnl > 0) AS w, count(*) FILTER (WHERE pnl < 0) AS l,
    avg(pnl) FILTER (WHERE pnl > 0) / abs(avg(pnl) FILTER (WHERE pnl < 0)) AS b FROM outcome GROUP BY 1, 2)
  SELECT symbol, model, n, {r('''CASE WHEN w + l < 5 OR w = 0 OR l = 0 THEN 0.2 ELSE greatest(0.1, least(0.2,
    greatest(0, least(1, (w / (w + l) * b - (1 - w / (w + l))) / b)) * 0.25)) END''')} AS position_size FROM k""")
def kelly_sizes(spark, sf):
    return show(risk.kelly_sizes(_outcomes(spark, sf), ["symbol", "model"]), "position_size", keys=("symbol", "model", "n"))


@query("stop_loss", f"WITH {BASE} SELECT symbol, ts, close <= open * (1 - 0.05) AS stopped FROM base")
def stop_loss(spark, sf):
    hit = risk.stop_loss_hit(F.col("open"), F.col("close"), F.lit(0.05))
    return tables.hourly_bars(spark, sf).select("symbol", "ts", hit.alias("stopped"))


_LEV = "greatest(1, least(10, volume))"
_SIDE = "CASE WHEN close > open THEN 'long' ELSE 'short' END"
_LIQ = f"greatest(0, CASE WHEN close > open THEN open * (1 - 1 / {_LEV} + 0.005) ELSE open * (1 + 1 / {_LEV} - 0.005) END)"


@query("liquidation", f"""WITH {BASE}, q AS (SELECT *, {_LIQ} AS liq, {_SIDE} AS side FROM base)
  SELECT symbol, ts, side, {rs(liquidation_price='liq', buffer_price="CASE WHEN liq <= 0 THEN 0 WHEN side = 'long' THEN liq * (1 + 0.002) ELSE liq * (1 - 0.002) END")},
    CASE WHEN liq <= 0 THEN false WHEN side = 'long' THEN low <= liq ELSE low >= liq END AS liquidated FROM q""")
def liquidation(spark, sf):
    lev = F.greatest(F.lit(1.0), F.least(F.lit(10.0), F.col("volume")))
    side = F.when(F.col("close") > F.col("open"), "long").otherwise("short")
    e = F.col("open")
    return tables.hourly_bars(spark, sf).select(
        "symbol", "ts", side.alias("side"), r6(risk.liquidation_price(e, lev, side)).alias("liquidation_price"),
        r6(risk.buffer_price(e, lev, side)).alias("buffer_price"), risk.is_liquidated(e, F.col("low"), lev, side).alias("liquidated"))


@query("leverage_limits", f"""WITH {BASE} SELECT symbol, ts, {rs(max_leverage='CASE WHEN rg > 0 THEN greatest(1, least(10, 10 * (0.4 / greatest(rg * sqrt(365), 0.01)))) ELSE 10 END',
  funding='close * volume * (0.1 / 365) * 3')} FROM base""")
def leverage_limits(spark, sf):
    b = base(spark, sf)
    return b.select("symbol", "ts", r6(risk.max_leverage(F.col("hl_range"))).alias("max_leverage"),
                    r6(risk.funding_cost(F.col("close") * F.col("volume"), F.lit(3.0))).alias("funding"))


# --- portfolio: the oracle matches lots by overlapping quantity intervals -------------------------
_TORD = "ts, l_orderkey, l_linenumber, l_partkey"
TRADES = f"""tr AS (SELECT 'S' || l_suppkey AS symbol, l_shipdate AS ts, l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
    l_quantity AS qty, l_extendedprice / l_quantity AS price, l_extendedprice * l_tax * 0.001 AS fee,
    CASE WHEN l_returnflag = 'A' THEN 'BUY' WHEN l_linestatus = 'O' THEN 'HOLD' END AS signal FROM lineitem),
  cum AS (SELECT *, sum(CASE WHEN side = 'BUY' THEN qty ELSE 0 END) OVER w AS bought, sum(CASE WHEN side = 'SELL' THEN qty ELSE 0 END) OVER w AS sold
    FROM tr WINDOW w AS (PARTITION BY symbol ORDER BY {_TORD} ROWS UNBOUNDED PRECEDING)),
  bad AS (SELECT symbol, min(ts) AS first_ts, max(sold - bought) AS worst_gap FROM cum WHERE sold - bought > 1e-12 GROUP BY 1),
  good AS (SELECT * FROM cum WHERE symbol NOT IN (SELECT symbol FROM bad)),
  buys AS (SELECT *, bought - qty AS lo, bought AS hi FROM good WHERE side = 'BUY'), sells AS (SELECT *, sold - qty AS lo, sold AS hi FROM good WHERE side = 'SELL'),
  lots AS (SELECT b.symbol, least(b.hi, s.hi) - greatest(b.lo, s.lo) AS qty, b.ts AS buy_ts, b.price AS buy_price, b.signal AS buy_signal, s.ts AS sell_ts,
      s.price AS sell_price, b.fee / b.qty AS bf, s.fee / s.qty AS sf FROM buys b JOIN sells s ON s.symbol = b.symbol AND s.lo < b.hi AND b.lo < s.hi),
  closed AS (SELECT *, buy_price * qty + bf * qty AS cost, sell_price * qty - sf * qty AS proceeds, sell_price * qty - sf * qty - (buy_price * qty + bf * qty) AS pnl FROM lots),
  tot AS (SELECT symbol, max(sold) AS sold FROM good GROUP BY 1),
  opened AS (SELECT b.symbol, b.hi - greatest(b.lo, t.sold) AS qty, b.price, b.fee / b.qty AS bf FROM buys b JOIN tot t USING (symbol) WHERE b.hi > t.sold)"""


def _run(spark, sf):
    return portfolio.with_running_quantity(tables.trades(spark, sf).drop("order_id", "line"))


def _good(spark, sf):
    return keep(portfolio.without_oversold(_run(spark, sf)).drop("seq"))


def _closed(spark, sf):
    return portfolio.match_fifo(_good(spark, sf))[0]


@query("fifo_lots", f"""WITH {TRADES} SELECT symbol, qty, buy_ts, sell_ts, {rs(buy_price='buy_price', sell_price='sell_price', buy_fee='bf * qty', sell_fee='sf * qty')} FROM lots""")
def fifo_lots(spark, sf):
    return show(_closed(spark, sf), "buy_price", "sell_price", "buy_fee", "sell_fee", keys=("symbol", "qty", "buy_ts", "sell_ts"))


@query("oversold_symbols", f"WITH {TRADES} SELECT symbol, first_ts, worst_gap FROM bad")
def oversold_symbols(spark, sf):
    return portfolio.oversold(_run(spark, sf))


@query("lot_results", f"""WITH {TRADES} SELECT symbol, buy_ts, sell_ts, qty, {rs(cost_basis='cost', proceeds='proceeds', pnl='pnl', pnl_pct='pnl / abs(cost) * 100')},
  epoch(sell_ts - buy_ts) / 86400 AS hold_days FROM closed""")
def lot_results(spark, sf):
    return show(_closed(spark, sf), "cost_basis", "proceeds", "pnl", "pnl_pct", keys=("symbol", "buy_ts", "sell_ts", "qty", "hold_days"))


OPEN = f"""{TRADES}, pos AS (SELECT symbol, sum(qty) AS qty, sum(qty * price + qty * bf) AS cost FROM opened GROUP BY 1)"""


def _open(spark, sf):
    return portfolio.open_positions(portfolio.match_fifo(_good(spark, sf))[1])


@query("open_positions", f"WITH {OPEN} SELECT symbol, qty, {rs(cost_basis='cost', avg_price='cost / qty')} FROM pos")
def open_positions(spark, sf):
    return show(_open(spark, sf), "cost_basis", "avg_price", keys=("symbol", "qty"))


@query("unrealized_pnl", f"""WITH {OPEN}, px AS (SELECT symbol, last(price ORDER BY {_TORD}) AS price FROM tr GROUP BY 1)
  SELECT symbol, {rs(unrealized_pnl='(price - cost / qty) * qty', unrealized_pnl_pct='(price / (cost / qty) - 1) * 100')} FROM pos LEFT JOIN px USING (symbol)""")
def unrealized_pnl(spark, sf):
    """Valued at the last price of any trade."""
    px = tables.trades(spark, sf).groupBy("symbol").agg(F.max_by("price", F.struct("ts", "seq")).alias("price"))
    return show(portfolio.with_last_prices(_open(spark, sf), px), "unrealized_pnl", "unrealized_pnl_pct", keys=("symbol",))


@query("realized_total", f"WITH {TRADES} SELECT round(sum(pnl), 3) AS realized_pnl FROM closed")
def realized_total(spark, sf):
    return portfolio.realized_total(_closed(spark, sf)).select(F.round("realized_pnl", 3).alias("realized_pnl"))


@query("monthly_summary", f"""WITH {TRADES} SELECT strftime(sell_ts, '%Y-%m') AS month, count(*) AS n_closed, {rs(realized_pnl='sum(pnl)', win_rate='avg((pnl > 0)::INT) * 100',
  avg_pnl_pct='avg(pnl / abs(cost) * 100)', best='max(pnl)', worst='min(pnl)')} FROM closed GROUP BY 1""")
def monthly_summary(spark, sf):
    return show(portfolio.monthly_summary(_closed(spark, sf)), "realized_pnl", "win_rate", "avg_pnl_pct", "best", "worst", keys=("month", "n_closed"))


@query("signal_alignment", f"""WITH {TRADES} SELECT buy_signal, count(*) AS n_closed, round(sum(pnl), 3) AS total_pnl, {rs(win_rate='avg((pnl > 0)::INT) * 100',
  avg_pnl_pct='avg(pnl / abs(cost) * 100)')} FROM closed WHERE buy_signal IS NOT NULL GROUP BY 1""")
def signal_alignment(spark, sf):
    out = portfolio.signal_alignment(_closed(spark, sf))
    return out.select("buy_signal", "n_closed", F.round("total_pnl", 3).alias("total_pnl"), r6(F.col("win_rate")).alias("win_rate"),
                      r6(F.col("avg_pnl_pct")).alias("avg_pnl_pct"))


# --- prediction log ----------------------------------------------------------------------------------
PLOG = f"""{DAILY}, pl AS (SELECT symbol, ts, close AS entry, ts + INTERVAL 5 DAY AS resolution_ts, CASE WHEN close > open THEN 'BUY' WHEN close < open THEN 'SELL' ELSE 'HOLD' END AS consensus FROM daily),
  lt AS (SELECT symbol, max(ts) AS latest FROM daily GROUP BY 1),
  rs0 AS (SELECT p.*, t.close AS exit_price, latest FROM pl p LEFT JOIN daily t ON t.symbol = p.symbol AND t.ts = p.ts + INTERVAL 5 DAY JOIN lt ON lt.symbol = p.symbol),
  rs1 AS (SELECT *, resolution_ts <= TIMESTAMP '2001-07-20' AS due FROM rs0),
  rs2 AS (SELECT *, CASE WHEN due AND exit_price IS NOT NULL THEN 'resolved' WHEN due AND resolution_ts < latest THEN 'expired' ELSE 'pending' END AS status,
    CASE WHEN due THEN exit_price / entry - 1 END AS ret FROM rs1),
  rs3 AS (SELECT *, CASE WHEN status <> 'resolved' THEN NULL WHEN ret > 0.02 THEN 'BUY' WHEN ret < -0.02 THEN 'SELL' ELSE 'HOLD' END AS actual FROM rs2)"""


def _log(spark, sf):
    c, o = F.col("close"), F.col("open")
    rows = tables.daily_bars(spark, sf).select("symbol", "ts", c.alias("entry_price"),
        F.when(c > o, "BUY").when(c < o, "SELL").otherwise("HOLD").alias("consensus"),
        F.lit(0.02).alias("buy_th"), F.lit(-0.02).alias("sell_th"))
    return ledger.prediction_rows(rows, 5)


@query("prediction_log", f"WITH {PLOG} SELECT symbol, ts, resolution_ts, consensus, entry AS entry_price FROM pl")
def prediction_log(spark, sf):
    return _log(spark, sf).select("symbol", "ts", "resolution_ts", "consensus", "entry_price")


def _resolved(spark, sf):
    return paper.resolve(_log(spark, sf), tables.daily_bars(spark, sf), F.lit("2001-07-20 00:00:00").cast("timestamp_ntz"))


@query("prediction_resolution", f"WITH {PLOG} SELECT symbol, ts, status, actual AS actual_label, {r('ret')} AS actual_return, coalesce(actual = consensus, false) AS success FROM rs3")
def prediction_resolution(spark, sf):
    return _resolved(spark, sf).select("symbol", "ts", "status", "actual_label", r6(F.col("actual_return")).alias("actual_return"),
                                       F.coalesce("success", F.lit(False)).alias("success"))


@query("stored_resolution", f"WITH {PLOG} SELECT symbol, ts, status, actual AS actual_label, {r('ret')} AS actual_return, coalesce(actual = consensus, false) AS success FROM rs3")
def stored_resolution(spark, sf):
    """The log is stored, judged early, judged at the day, and judged again: results are written back once."""
    folder, bars = scratch_folder(spark), keep(tables.daily_bars(spark, sf))
    rows = _log(spark, sf)
    paper.log_predictions(spark, folder, rows, "logged")
    schema = spark.read.parquet(folder).schema
    for day in ("1998-01-01", "2001-07-20", "2001-07-20"):
        paper.resolve_log(spark, folder, schema, bars, F.lit(f"{day} 00:00:00").cast("timestamp_ntz"), f"judged {day}")
    out = spark.read.schema(schema).parquet(folder)
    return out.select("symbol", "ts", "status", "actual_label", r6(F.col("actual_return")).alias("actual_return"),
                      F.coalesce("success", F.lit(False)).alias("success"))


@query("live_accuracy", f"""WITH {PLOG} SELECT symbol, count(*) AS total_predictions, count(*) FILTER (WHERE status = 'resolved') AS total_resolved,
  count(*) FILTER (WHERE actual = consensus) AS correct_resolved, {r("count(*) FILTER (WHERE actual = consensus) * 100.0 / nullif(count(*) FILTER (WHERE status = 'resolved'), 0)")} AS accuracy_pct,
  count(*) FILTER (WHERE status = 'pending') AS still_pending FROM rs3 GROUP BY 1""")
def live_accuracy(spark, sf):
    out = paper.accuracy(_resolved(spark, sf), "symbol")
    return show(out, "accuracy_pct", keys=("symbol", "total_predictions", "total_resolved", "correct_resolved", "still_pending"))
