"""Hand-computed cases, causality, scale invariance and fits against numpy."""

import datetime as dt
import random

import numpy as np
import pytest
from conftest import day
from pyspark.sql import functions as F

from tapeflow import config
from tapeflow.functions.book import BookRules
from tapeflow.functions import book as ob
from tapeflow.functions.stats import binomial_tail, breakeven_win_rate, deflate
from tapeflow.functions.text import score_text
from tapeflow.operators import book, ev, events, fold_models, holdout, metrics, micro, models, news, pairs, paper, portfolio, reference
from tapeflow.operators import risk, signals, smoothing, social, splits, technical, validate
from tapeflow.plans.features import bar_features, select_features
from tapeflow.plans.slices import RN, number_rows, over_slices, time_bucket
from tapeflow.plans.tables import keep
from tapeflow.sources import calendar, ledger, texts

BARS = "symbol string, ts timestamp_ntz, rn bigint, open double, high double, low double, close double, volume double"


def make_bars(n, seed=0, symbol="s", scale=1.0):
    rng = random.Random(seed)
    rows, p = [], 100.0
    for i in range(n):
        o, p = p, p * (1 + rng.uniform(-0.03, 0.03))
        hi, lo = max(o, p) * (1 + rng.uniform(0, 0.01)), min(o, p) * (1 - rng.uniform(0, 0.01))
        rows.append((symbol, day(i), i, o * scale, hi * scale, lo * scale, p * scale, float(rng.randint(100, 900))))
    return rows


SPEC = config.FeatureSpec(micro=True, smooth=True)


def table(df, cols):
    return {r[RN]: [r[c] for c in cols] for r in df.collect()}


COLS = [c for c in SPEC.columns() if not c.startswith("rsi_b")]


def test_features_do_not_see_the_future(frame):
    bars = make_bars(160)
    full = table(bar_features(frame(bars, BARS), SPEC), COLS)
    part = table(bar_features(frame(bars[:120], BARS), SPEC), COLS)
    for i in range(120):
        for a, b in zip(part[i], full[i]):
            assert (a is None) == (b is None)
            assert a is None or a == pytest.approx(b, rel=1e-12, abs=1e-14)


def test_features_do_not_depend_on_price_scale(frame):
    a = table(bar_features(frame(make_bars(120), BARS), SPEC), COLS)
    b = table(bar_features(frame(make_bars(120, scale=1000.0), BARS), SPEC), COLS)
    skip = {COLS.index(c) for c in ("kyle_lambda",)}
    for i in range(120):
        for j, (x, y) in enumerate(zip(a[i], b[i])):
            if j not in skip:
                assert (x is None) == (y is None)
                assert x is None or x == pytest.approx(y, rel=1e-6, abs=1e-9), (i, COLS[j])


def test_features_do_not_depend_on_partitioning(spark, frame):
    bars = frame(make_bars(150) + make_bars(40, 3, "t"), BARS, 7)
    want = None
    for parts in ("1", "4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = sorted(map(tuple, bar_features(bars, SPEC).select("symbol", RN, *COLS).collect()), key=lambda t: t[:2])
        want = want or got
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_one_exchange_and_no_python_in_bar_features(frame):
    plan = bar_features(frame(make_bars(30), BARS), SPEC)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") == 1
    assert plan.count("Sort [symbol") == 1
    assert "Python" not in plan and "Pandas" not in plan


def test_missing_column_is_an_error(frame):
    df = frame(make_bars(5), BARS)
    with pytest.raises(validate.SchemaError):
        validate.check_columns(df.drop("low"))
    with pytest.raises(validate.SchemaError):
        select_features(df, config.FeatureSpec())


@pytest.mark.parametrize("deriv", [0, 1, 2])
def test_savgol_is_the_trailing_polynomial_fit(frame, deriv):
    rng = random.Random(2)
    x = [rng.uniform(1, 9) for _ in range(30)]
    df = frame([("s", i, v) for i, v in enumerate(x)], "symbol string, rn bigint, x double")
    out = over_slices(df, ["symbol"], [lambda d, w: d.withColumn("y", smoothing.savgol("x", w, deriv=deriv))], 11)
    got = [r["y"] for r in sorted(out.collect(), key=lambda r: r[RN])]
    assert got[:10] == [None] * 10
    for i in range(10, 30):
        poly = np.poly1d(np.polyfit(np.arange(-10, 1), x[i - 10: i + 1], 3))
        assert got[i] == pytest.approx(float(np.polyder(poly, deriv)(0)) if deriv else float(poly(0)), abs=1e-9)


def test_warm_up_lengths(frame):
    got = table(bar_features(frame(make_bars(70), BARS), config.FeatureSpec()), ["rsi", "macd_diff", "bb_pband", "atr_pct", "sma50_dist"])
    first = [next(i for i in range(70) if got[i][j] is not None) for j in range(5)]
    assert first == [13, 33, 19, 0, 49]
    assert got[12][3] == 0.0 and got[13][3] > 0


def test_constant_prices_give_null_not_errors(frame):
    rows = [("s", day(i), i, 5.0, 5.0, 5.0, 5.0, 0.0) for i in range(80)]
    out = table(bar_features(frame(rows, BARS), SPEC), ["rsi", "bb_pband", "vol_chg", "vol_delta", "kyle_lambda", "amihud_illiq"])
    assert out[79] == [1.0, None, None, 0.0, None, 0.0]


# --- order book ----------------------------------------------------------------------------
BOOK = "symbol string, ts timestamp_ntz, bids array<struct<price:double,size:double>>, asks array<struct<price:double,size:double>>"


def test_book_basics(frame):
    rows = [("full", day(0), [(100.0, 5.0)], [(102.0, 3.0)]), ("bid", day(0), [(100.0, 5.0)], []),
            ("ask", day(0), [], [(102.0, 3.0)]), ("none", day(0), [], []), ("null", day(0), None, None)]
    out = frame(rows, BOOK).select("symbol", ob.mid_price().alias("mid"), ob.imbalance().alias("imb"), ob.abs_spread().alias("sp"),
                                   ob.microprice().alias("mp"), ob.reliable().alias("ok"), ob.rel_spread().alias("rel"))
    got = {r["symbol"]: r for r in out.collect()}
    assert [got[s]["mid"] for s in ("full", "bid", "ask", "none", "null")] == [101.0, 100.0, 102.0, 0.0, 0.0]
    assert got["full"]["imb"] == 0.25 and got["bid"]["imb"] == 1.0 and got["none"]["imb"] == 0.0
    assert got["full"]["sp"] == 2.0 and got["bid"]["sp"] == 0.0 and got["none"]["rel"] == 0.0
    assert got["full"]["mp"] == pytest.approx((100 * 3 + 102 * 5) / 8)
    assert not any(r["ok"] for r in got.values())


def test_walls_and_reliability(frame):
    deep = [(100.0 - i, 1.0) for i in range(9)] + [(90.0, 50.0)]
    thin = [(101.0 + i, 0.01) for i in range(10)]
    out = frame([("s", day(0), deep, thin)], BOOK).select(F.size(ob.walls("bids")).alias("w"), ob.reliable().alias("ok")).first()
    assert (out["w"], out["ok"]) == (1, False)


def test_tracker_holds_through_thin_books(frame):
    rows = [("s", day(i), v, ok) for i, (v, ok) in enumerate([(0.5, True), (-1.0, False), (0.5, True), (-0.5, True)])]
    rows = [(s, t, "x", v, ok) for s, t, v, ok in rows]
    out = book.track(frame(rows, "symbol string, ts timestamp_ntz, state string, imbalance double, reliable boolean"))
    got = [(r["state"], round(r["smoothed"], 6)) for r in sorted(out.collect(), key=lambda r: r["ts"])]
    assert got == [("BUY PRESSURE", 0.5), ("THIN BOOK", 0.5), ("BUY PRESSURE", 0.5), ("BUY PRESSURE", 0.2)]


# --- calendar, news, social, reference ---------------------------------------------------------


def bars_only(frame, n):
    return frame([("s", day(i), i, 10.0 + i) for i in range(n)], "symbol string, ts timestamp_ntz, rn bigint, close double")


CAL = "date date, name string, importance int, forecast double, actual double"


def test_surprise_shows_one_bar_later(frame):
    d = lambda i: (dt.date(2024, 1, 1) + dt.timedelta(days=i))
    cal = frame([(d(10), "CPI", 3, 3.1, 3.4), (d(20), "CPI", 2, 3.2, 2.9)], CAL)
    got = {r[RN]: r for r in events.add_events(bars_only(frame, 30), cal).collect()}
    assert [round(got[i]["last_event_surprise"], 6) for i in (10, 11, 12, 21)] == [0.0, 0.3, 0.0, -0.3]
    assert [got[i]["bars_to_next_event"] for i in (0, 10, 11, 20, 21)] == [10.0, 0.0, 9.0, 0.0, -1.0]
    assert [got[i]["event_importance"] for i in (0, 10, 11, 25)] == [3.0, 3.0, 2.0, 0.0]
    assert [got[i]["event_day_flag"] for i in (9, 10)] == [0, 1]


def test_neutral_columns_without_side_tables(frame):
    b = bars_only(frame, 3)
    assert events.add_events(b, None).first()["bars_to_next_event"] == -1.0
    assert social.add_social(b, None).first()["social_volume_z"] == 0.0
    assert book.add_book_features(b, None).first()["depth_imbalance"] == 0.0


def test_news_of_a_day_shows_the_next(frame):
    items = frame([(dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(10)], "d date, sentiment double")
    got = {r["d"].day - 1: r["sentiment_avg"] for r in news.daily_sentiment(items).collect()}
    assert got[0] is None and [got[i] for i in range(1, 10)] == [float(i - 1) for i in range(1, 10)]


def test_posts_show_one_bar_later(frame):
    posts = frame([(day(15, 9), "surge rally"), (day(15, 10), "surge")], "ts timestamp_ntz, text string")
    got = {r[RN]: r["social_sentiment_avg"] for r in social.add_social(bars_only(frame, 30), posts).collect()}
    assert (got[15], got[16], got[17]) == (0.0, 1.0, 0.0)


def test_reference_row_shows_on_the_next_day(frame):
    series = frame([("fear_greed", dt.date(2024, 1, 1) + dt.timedelta(days=i), 10.0 + i) for i in range(20)], "name string, d date, value double")
    got = {r[RN]: r for r in reference.add_reference(bars_only(frame, 20), series).collect()}
    assert got[5]["fear_greed"] == pytest.approx((14.0 - 50) / 50) and got[0]["fear_greed"] == 0.0
    assert got[5]["dxy_chg"] == 0.0
    with pytest.raises(ValueError):
        reference.add_reference(bars_only(frame, 2), series, shift=0)


def test_static_calendar_rules(frame):
    span = frame([(dt.date(2024, 1, 1), dt.date(2024, 3, 31))], "first_day date, last_day date")
    got = {(r["name"], r["date"]) for r in calendar.static_calendar(span).collect()}
    assert ("NFP", dt.date(2024, 1, 5)) in got and ("CPI", dt.date(2024, 2, 12)) in got
    assert ("GDP", dt.date(2024, 1, 28)) in got and ("Retail_Sales", dt.date(2024, 3, 14)) in got
    assert {d.weekday() for n, d in got if n == "Unemployment_Claims"} == {4}


def test_text_score_reads_the_whole_text(frame):
    long = "word " * 5000 + "surge"
    rows = [("a", "Rally! Surge..."), ("b", "crash and surge"), ("c", ""), ("d", None), ("e", long)]
    got = {r["k"]: r["s"] for r in frame(rows, "k string, t string").select("k", score_text(F.col("t")).alias("s")).collect()}
    assert got == {"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.0, "e": 1.0}


def test_news_landing(frame):
    rows = [("2024-01-05T10:00:00Z", "T", "S", "rss", 1), ("bad", "U", "S", "rss", 2),
            ("5 Jan 2024 08:00:00 +0000", None, "S", "rss", 3)]
    out = texts.land_news(frame(rows, "published string, title string, summary string, source string, seq int"))
    assert {(r["seq"], r["text"], r["d"]) for r in out.collect()} == {(1, "T. S", dt.date(2024, 1, 5)), (3, ". S", dt.date(2024, 1, 5))}
    cut = texts.land_news(frame([("2024-01-05", "T", "x" * 900, "rss", 1)], "published string, title string, summary string, source string, seq int"), 512)
    assert len(cut.first()["text"]) == 512


# --- signals, splits, statistics ------------------------------------------------------------------


def test_binomial_and_deflation(spark):
    assert binomial_tail([59], [100])[0] == pytest.approx(0.0443130, abs=1e-7)
    assert binomial_tail([70], [100])[0] == pytest.approx(3.92507e-5, rel=1e-5)
    assert binomial_tail([50], [100])[0] == pytest.approx(0.5397946, abs=1e-7)
    assert list(binomial_tail([0, 3, 0], [0, 3, 7])) == pytest.approx([1.0, 0.125, 1.0])
    big = binomial_tail([500_400], [1_000_000])[0]
    assert 0.2 < big < 0.22
    row = spark.range(1).select(deflate(F.lit(0.0443130), F.lit(30)).alias("d"), breakeven_win_rate(F.lit(1.5)).alias("b")).first()
    assert row["d"] == pytest.approx(0.743274, abs=1e-5) and row["b"] == pytest.approx(0.4)


def test_cpcv_geometry(frame):
    assert [splits.n_paths(*a) for a in ((6, 2), (10, 2), (6, 3))] == [5, 9, 10]
    n = 100
    df = frame([("s", i, n) for i in range(n)], "symbol string, rn bigint, n bigint")
    roles = splits.add_cpcv_roles(df, 5, 1, 5, 3).where("combo_id = 2").collect()
    got = {r[RN]: r["role"] for r in roles}
    assert {i for i, r in got.items() if r == "test"} == set(range(40, 60))
    assert {i for i, r in got.items() if r == "purged"} == {35, 36, 37, 38, 39, 60, 61, 62}
    for size in (7, 23, 101):
        groups = {i: g * size // 6 for i, g in enumerate(range(7))}
        d = splits.add_group(frame([("s", i, size) for i in range(size)], "symbol string, rn bigint, n bigint"), 6)
        for r in d.collect():
            g = r["group_id"]
            assert groups[g] <= r[RN] < groups[g + 1]


def test_segments_leave_a_gap(frame):
    df = frame([("s", i, 1000) for i in range(1000)], "symbol string, rn bigint, n bigint")
    count = lambda d: {r["segment"]: r["c"] for r in d.groupBy("segment").agg(F.count(F.lit(1)).alias("c")).collect()}
    assert count(splits.add_segments(df, 0.6, 0.2, 0)) == {"train": 600, "val": 200, "test": 200}
    assert count(splits.add_segments(df, 0.6, 0.2, 5)) == {"train": 595, "val": 195, "test": 200, "purged": 10}
    assert count(splits.add_segments(df, 0.6, 0.2, 5, pass_on=True)) == {"train": 595, "val": 200, "test": 205}


def test_vote_ties_and_thresholds(frame):
    rows = [("s", "a", "SELL", 10.0, 0.1), ("s", "b", "BUY", 20.0, 0.2), ("t", "a", "HOLD", 1.0, 0.0), ("t", "b", "SELL", 1.0, 0.0)]
    out = {r["symbol"]: r["consensus"] for r in signals.majority_vote(
        frame(rows, "symbol string, model string, signal string, confidence double, pred double")).collect()}
    assert out == {"s": "BUY", "t": "SELL"}
    b, s = signals.dynamic_thresholds(F.col("a"))
    th = [tuple(r) for r in frame([(1, 0.05), (2, 0.0), (3, None), (4, float("nan"))], "i int, a double").orderBy("i").select(b, s).collect()]
    assert th == [(pytest.approx(0.005), pytest.approx(-0.005))] + [(0.02, -0.02)] * 3


def test_signal_confidence(frame):
    rows = [(1, 0.03, 0.02, -0.02), (2, -0.10, 0.02, -0.02), (3, 0.01, 0.02, -0.02), (4, -0.01, 0.02, -0.04)]
    out = signals.add_signal(frame(rows, "i int, pred double, buy_th double, sell_th double")).orderBy("i").collect()
    assert [(r["signal"], round(r["confidence"], 6)) for r in out] == [("BUY", 25.0), ("SELL", 99.0), ("HOLD", 25.0), ("HOLD", 37.5)]


def test_kelly(frame):
    few = [("few", 0.1)] * 4
    mixed = [("mix", 0.1)] * 6 + [("mix", -0.05)] * 4
    wins = [("win", 0.1)] * 9
    out = {r["k"]: r["position_size"] for r in risk.kelly_sizes(frame(few + mixed + wins, "k string, pnl double"), ["k"]).collect()}
    f = (0.6 * 2 - 0.4) / 2 * 0.25
    assert out["few"] == 0.2 and out["win"] == 0.2 and out["mix"] == pytest.approx(max(0.1, min(0.2, f)))


def test_liquidation(spark):
    e, lev = F.lit(100.0), F.lit(10.0)
    r = spark.range(1).select(risk.liquidation_price(e, lev, F.lit("long")).alias("l"), risk.liquidation_price(e, lev, F.lit("short")).alias("s"),
                              risk.liquidation_price(e, F.lit(0.0), F.lit("long")).alias("z"), risk.is_liquidated(e, F.lit(90.0), lev, F.lit("long")).alias("hit"),
                              risk.max_leverage(F.lit(0.0)).alias("m")).first()
    assert (r["l"], r["s"], r["z"], r["hit"], r["m"]) == (pytest.approx(90.5), pytest.approx(109.5), 0.0, True, 10.0)


def test_monthly_summary(frame):
    rows = [("x", day(0), 0, "BUY", 1.0, 100.0, 0.0, None), ("x", day(1), 1, "SELL", 1.0, 110.0, 0.0, None),
            ("x", day(2), 2, "BUY", 1.0, 100.0, 0.0, None), ("x", day(40), 3, "SELL", 1.0, 90.0, 0.0, None)]
    run = portfolio.with_running_quantity(frame(rows, "symbol string, ts timestamp_ntz, seq int, side string, qty double, price double, fee double, signal string"))
    out = {r["month"]: (r["realized_pnl"], r["win_rate"]) for r in portfolio.monthly_summary(portfolio.match_fifo(run)[0]).collect()}
    assert out == {"2024-01": (10.0, 100.0), "2024-02": (-10.0, 0.0)}


def test_predictions_resolve_expire_or_wait(frame):
    bars = frame([("s", day(i), float(i + 1)) for i in (0, 5, 6, 20)], "symbol string, ts timestamp_ntz, close double")
    p = frame([("s", day(i), 1.0, "BUY", 0.02, -0.02) for i in (0, 2, 18)],
              "symbol string, ts timestamp_ntz, entry_price double, consensus string, buy_th double, sell_th double")
    out = paper.resolve(ledger.prediction_rows(p, 5), bars, F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"))
    got = {r["ts"]: (r["status"], r["success"]) for r in out.collect()}
    assert got == {day(0): ("resolved", True), day(2): ("expired", None), day(18): ("pending", None)}


# --- fits ------------------------------------------------------------------------------------------


def ridge_by_hand(x, y, alpha):
    mu, sd = x.mean(0), x.std(0)
    z = (x - mu) / sd
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / sd
    return w, y.mean() - w @ mu


def data(n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) * [1.0, 30.0] + [2.0, -5.0]
    return x, x @ [0.5, -0.02] + rng.normal(size=n)


def test_ridge_folds_from_block_moments(frame):
    x, y = data()
    df = frame([("s", i, 400, float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y))],
               "symbol string, rn bigint, n bigint, a double, b double, y double")
    sums = models.fold_moments(df, ["symbol"], ["a", "b"], "y", 120, 40, None, 5)
    fits = {r["fold_id"]: r for r in models.fit_ridge(sums, ["symbol", "fold_id"], ["a", "b"], "y", 2.0).collect()}
    assert sorted(fits) == list(range(7))
    for f, r in fits.items():
        rows = slice(f * 40, f * 40 + 115)
        w, c = ridge_by_hand(x[rows], y[rows], 2.0)
        assert r["n_train"] == 115
        assert r["coef"] == pytest.approx(list(w), rel=1e-8) and r["intercept"] == pytest.approx(c, rel=1e-8)


def test_ridge_on_spark_ml_equals_the_moment_fit(frame):
    x, y = data(200, 1)
    df = frame([(i, float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y))], "i int, a double, b double, y double")
    w, c = ridge_by_hand(x, y, 1.0)
    got = {r["i"]: r["pred"] for r in models.fit_linear(df, ["a", "b"], "y", 1.0)(df).collect()}
    assert [got[i] for i in range(200)] == pytest.approx(list(x @ w + c), rel=1e-6, abs=1e-8)


def test_alpha_search_needs_no_rows(frame):
    x, y = data(300, 2)
    df = frame([("s", i, float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y))], "symbol string, i int, a double, b double, y double")
    part = lambda c: models.moments(df.where(c), ["symbol"], ["a", "b"], "y")
    r = models.search_ridge(part("i < 200"), part("i >= 200"), ["symbol"], ["a", "b"], "y").first()
    scores = []
    for alpha in models.alpha_grid():
        w, c = ridge_by_hand(x[:200], y[:200], alpha)
        scores.append(float(np.sqrt(np.mean((y[200:] - x[200:] @ w - c) ** 2))))
    assert r["alpha"] == pytest.approx(models.alpha_grid()[int(np.argmin(scores))])
    assert r["val_rmse"] == pytest.approx(min(scores), rel=1e-9)


def test_single_class_meta_model_trusts_every_call(frame):
    df = frame([(1.0, 1), (2.0, 1)], "a double, meta_label int")
    assert {r["prob_correct"] for r in models.fit_meta(df, ["a"])(df).collect()} == {1.0}


def adf_by_hand(s, lag):
    dy = np.diff(s)
    cols = [np.ones(len(dy) - lag), s[lag:-1]] + [dy[lag - i: len(dy) - i] for i in range(1, lag + 1)]
    x, t = np.column_stack(cols), dy[lag:]
    b = np.linalg.lstsq(x, t, rcond=None)[0]
    res = t - x @ b
    se = np.sqrt(res @ res / (len(t) - x.shape[1]) * np.diag(np.linalg.inv(x.T @ x)))
    return b[1] / se[1], len(t)


@pytest.mark.parametrize("rows", [50, 10_000])
def test_adf_over_slices(frame, rows):
    rng = np.random.default_rng(4)
    walk, pull = np.cumsum(rng.normal(size=300)), np.zeros(300)
    for i in range(1, 300):
        pull[i] = 0.7 * pull[i - 1] + rng.normal()
    series = {"walk": walk, "pull": pull}
    df = frame([(k, i, float(v)) for k, s in series.items() for i, v in enumerate(s)], "k string, rn bigint, v double")
    got = {r["k"]: r for r in pairs.adf_statistic(df, ["k"], "v", 6, rows).collect()}
    for k, s in series.items():
        stat, nobs = adf_by_hand(s, 6)
        assert got[k]["stat"] == pytest.approx(stat, rel=1e-7) and got[k]["nobs"] == nobs
    assert got["pull"]["stat"] < pairs.ADF_CRITICAL[0.05] < got["walk"]["stat"]


def test_planted_cointegration_is_found(frame):
    rng = np.random.default_rng(7)
    x = 100 + np.cumsum(rng.normal(size=500))
    e = np.zeros(500)
    for i in range(1, 500):
        e[i] = 0.9 * e[i - 1] + rng.normal() * 0.3
    other = 100 + np.cumsum(rng.normal(size=500))
    rows = [("true", i, float(0.65 * x[i] + e[i]), float(x[i])) for i in range(500)]
    rows += [("none", i, float(other[i]), float(x[i])) for i in range(500)]
    df = keep(frame(rows, "pair string, rn bigint, y double, x double"))
    got = {r["pair"]: r for r in pairs.engle_granger(df, 4).collect()}
    assert got["true"]["cointegrated"] and not got["none"]["cointegrated"]
    assert got["true"]["beta"] == pytest.approx(0.65, abs=0.1)


def test_a_tiny_residual_keeps_its_digits(frame):
    """The residual is a ten-millionth of the price level; folds fit it as numpy does."""
    rng = np.random.default_rng(3)
    x = 1000 + np.cumsum(rng.normal(size=400))
    y = 1.7 * x + 40 + rng.normal(size=400) * 1e-4
    df = frame([("p", i, float(y[i]), float(x[i])) for i in range(400)], "pair string, rn bigint, y double, x double")
    parts = df.withColumn("fold_id", F.floor(F.col("rn") / 100))
    whole = pairs.hedge_fit(df, ["pair"]).first()
    got = {r["fold_id"]: r for r in pairs.hedge_fit(pairs.pivot_on(parts), ["pair", "fold_id"]).collect()}
    for fit, at in [(whole, slice(0, 400)), *((got[k], slice(100 * k, 100 * k + 100)) for k in range(4))]:
        a, b = x[at] - x[at].mean(), y[at] - y[at].mean()
        beta = a @ b / (a @ a)
        assert fit["beta"] == pytest.approx(beta, rel=1e-9)
        assert fit["spread_std"] == pytest.approx((b - beta * a).std(), rel=1e-6)


def test_lags_of_different_pairs_share_a_pass(frame):
    rng = np.random.default_rng(5)
    series = {"short": np.cumsum(rng.normal(size=9)), "mid": np.cumsum(rng.normal(size=120)), "long": np.cumsum(rng.normal(size=700))}
    df = keep(frame([(k, i, float(v)) for k, s in series.items() for i, v in enumerate(s)], "k string, rn bigint, v double"))
    got = {r["k"]: r for r in pairs.adf_statistic(df, ["k"], "v", pairs.lag_of(F.col("n")), 64, most=19).collect()}
    for k, s in series.items():
        lag = pairs.schwert_lag(len(s))
        stat, nobs = adf_by_hand(s, lag)
        assert (got[k]["used_lag"], got[k]["nobs"]) == (lag, nobs) and got[k]["stat"] == pytest.approx(stat, rel=1e-8)


# --- fits of many folds ------------------------------------------------------------------------------


def softmax_by_hand(x, y, c=1.0):
    """Newton on one fold, with dense matrices; returns raw coefficients by class."""
    mean, sd = x.mean(0), x.std(0)
    sd[sd == 0] = 1
    z = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    present = np.unique(y)
    w = np.array([len(y) / (len(present) * (y == k).sum()) for k in y])
    d, t = z.shape[1], np.zeros((3, z.shape[1]))
    for _ in range(100):
        logits = np.where(np.isin(np.arange(3), present), z @ t.T, -np.inf)
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        pen = np.tile(np.r_[0, np.ones(d - 1)], 3) / c
        g = ((p - np.eye(3)[y]) * w[:, None]).T @ z
        h = np.diag(pen)
        for a in range(3):
            for b in range(3):
                h[a * d:(a + 1) * d, b * d:(b + 1) * d] += (z * (w * p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ z
        used = np.repeat(np.isin(np.arange(3), present), d)
        move = np.zeros(3 * d)
        move[used] = np.linalg.lstsq(h[np.ix_(used, used)], (g.ravel() + pen * t.ravel())[used], rcond=None)[0]
        t -= move.reshape(3, d)
        if np.abs(move).max() < 1e-12:
            break
    return p


def test_softmax_fits_equal_a_loop_over_folds(frame):
    rng = np.random.default_rng(11)
    folds, rows = {}, []
    for k, n in (("a", 90), ("b", 260), ("two", 80)):
        x = rng.normal(size=(n, 3)) * [1, 20, 0.01] + [0, 500, 3]
        score = x[:, 0] + (x[:, 1] - 500) / 20 + rng.normal(size=n)
        y = np.where(score > 0.7, 2, np.where(score < -0.7, 0, 1)) if k != "two" else np.where(score > 0, 2, 0)
        folds[k] = (x, y)
        rows += [(k, i, *map(float, x[i]), int(y[i])) for i in range(n)]
    cols = ["u", "v", "w"]
    df = keep(frame(rows, "k string, rn bigint, u double, v double, w double, label int"))
    fits = keep(fold_models.fit_softmax(df, ["k"], cols, block_rows=50))
    out = {}
    for r in fold_models.predict_softmax(df, fits, ["k"], cols).collect():
        out.setdefault(r["k"], {})[r["rn"]] = (r["proba"], r["pred_class"])
    for k, (x, y) in folds.items():
        want = softmax_by_hand(x, y)
        got = np.array([out[k][i][0] for i in range(len(y))])
        assert np.allclose(got, want, atol=1e-7), k
        assert [out[k][i][1] for i in range(len(y))] == want.argmax(1).tolist()
        assert (got[:, 1] == 0).all() == (k == "two")


def test_swept_variants_equal_their_own_fits(frame):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 4)) + [0, 5, -3, 0]
    y = x @ [1, 0.5, 0, -1] + rng.normal(size=200)
    cols = ["a", "b", "c", "d"]
    df = keep(frame([("s", *map(float, r), float(t)) for r, t in zip(x, y)], "k string, a double, b double, c double, d double, y double"))
    variants = {"one": ["c"], "two": ["d", "a"], "all": cols}
    got = {(r["variant"], r["alpha"]): r for r in fold_models.sweep_ridge(
        models.moments(df, ["k"], cols, "y"), ["k"], cols, "y", variants, (1.0, 50.0)).collect()}
    for (name, alpha), r in got.items():
        own = [cols.index(c) for c in variants[name]]
        z = (x[:, own] - x[:, own].mean(0)) / x[:, own].std(0)
        w = np.linalg.solve(z.T @ z + alpha * np.eye(len(own)), z.T @ (y - y.mean())) / x[:, own].std(0)
        full = np.zeros(4)
        full[own] = w
        assert np.allclose(r["coef"], full, atol=1e-9) and r["n_features"] == len(own)
        res = y - y.mean() - (x[:, own] - x[:, own].mean(0)) @ w
        assert r["train_r2"] == pytest.approx(1 - res @ res / ((y - y.mean()) @ (y - y.mean())), abs=1e-9)
    assert len(got) == 6


def test_published_bands_of_fitted_walk_forward_models(frame):
    """On random walks hit rates lie near a half, and R2 and directional accuracy within the published bands."""
    from tapeflow.queries import learning

    rng, rows = np.random.default_rng(8), []
    for s in ("a", "b"):
        close = 30000 * np.exp(np.cumsum(rng.standard_t(5, 700) * 0.01))
        first = np.r_[close[0], close[:-1]]
        for i in range(700):
            hi, lo = max(first[i], close[i]) * (1 + rng.random() * 0.005), min(first[i], close[i]) * (1 - rng.random() * 0.005)
            rows.append((s, day(i // 24, i % 24), first[i], hi, lo, close[i], float(np.exp(rng.normal(10, 1)))))
    bars = frame([tuple(map(lambda v: float(v) if isinstance(v, np.floating) else v, r)) for r in rows],
                 "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    d = learning.matrix_of(number_rows(keep(bars), ["symbol"], ["ts"], time_bucket(F.col("ts"), 365.0)))
    hits = learning.softmax_scores(d).agg(F.avg("hit_rate").alias("h"), F.count("*").alias("n")).first()
    assert hits["n"] == 10 and 0.40 < hits["h"] < 0.60
    folds = learning.ridge_scores(d).agg(F.avg("dir_acc").alias("d"), F.max("r2").alias("r")).first()
    assert 0.30 < folds["d"] < 0.70 and folds["r"] < 0.30
    table = metrics.ablation_table(learning.variant_folds(d), ["symbol", "n_features"], ["symbol"]).collect()
    assert {(r["variant"], r["n_features"]) for r in table} == {
        ("technical", 14), ("technical+micro", 20), ("technical+smooth", 16), ("technical+micro+smooth", 22)}
    assert all(r["n_windows"] == 5 for r in table)


@pytest.mark.parametrize("losses, patience, want", [
    ([5, 4, 3, 3, 3, 2], 2, 3), ([5, 4, 3, 3, 3, 2], 3, 6), ([1, 2, 3], 20, 1), ([3, 2, 1], 1, 3), ([2, 2, 2, 2], 2, 1)])
def test_patience_rule(losses, patience, want):
    assert models.best_round(losses, patience) == want


def test_boosting_is_cut_at_the_round_of_its_curve(frame):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    rows = [(i, *map(float, x[i]), float(x[i, 0] + rng.normal() * 2)) for i in range(400)]
    d = keep(frame(rows, "i int, a double, b double, c double, y double"))
    losses, cols = [], ["a", "b", "c"]
    model = models.fit_boosted(d.where("i < 250"), cols, "y", d.where("i >= 250"), max_iter=60, patience=6, step=0.3, curve=losses)
    assert len(model.trees) == models.best_round(losses, 6) < len(losses)
    # The cut model's own loss is the curve's at that round: a shorter fit begins a longer one.
    own = model.evaluateEachIteration(models.assemble(d.where("i >= 250"), cols), "squared")
    assert own == pytest.approx(losses[: len(own)])
    log = models.search_boosted(d.where("i < 250"), d.where("i >= 250"), cols, "y", trials=4, first=2)
    assert [(r[1], r[2]) for r in log] == [(0, 2)] * 4 + [(1, 4)] * 2 + [(2, 8)]
    assert [r[-1] for r in log] == [False] * 6 + [True]
    assert {r[0] for r in log if r[1] == 1} == {r[0] for r in sorted(log[:4], key=lambda r: r[6])[:2]}


def test_holdout_reads_leave_a_trace(spark, frame, tmp_path):
    df = frame([("s", day(i), i) for i in range(10)], "symbol string, ts timestamp_ntz, rn int")
    log = str(tmp_path / "log")
    for k in (1, 2):
        assert holdout.open_holdout(df, F.col("rn") >= 8, log, "why").count() == 2
        line = holdout.accesses(spark, log).first()
        assert (line["accesses"], line["rows"], line["first_ts"], line["last_ts"]) == (k, 2 * k, day(8), day(9))


def test_only_testing_combinations_are_made(frame):
    df = frame([("s", i, 103) for i in range(103)], "symbol string, rn bigint, n bigint")
    roles = splits.add_cpcv_roles(df, 6, 2, 5, 3).where("role = 'test'").select("rn", "combo_id", "path_id")
    tests = splits.add_cpcv_tests(df, 6, 2)
    assert tests.count() == 103 * 5
    assert sorted(map(tuple, tests.select("rn", "combo_id", "path_id").collect())) == sorted(map(tuple, roles.collect()))


def test_every_family_of_the_full_table_has_values(spark):
    """Side tables are of the bars' own month and symbols: no family is a column of one number."""
    from tapeflow.queries import matrix

    cols = matrix.EVERYTHING.columns()
    df = keep(matrix.all_families(spark, "/root/testdata/sf0.01"))
    kinds = df.agg(*[F.count_distinct(c).alias(c) for c in cols]).first().asDict()
    # Two scores look back 60 days, further than the month of bars: they are still neutral.
    assert len(cols) == len(kinds) and {c for c, n in kinds.items() if n < 2} == {"btc_vol_share", "onchain_z"}


# --- expected value from added tables ------------------------------------------------------------------


def test_outcome_sums_give_the_statistics_of_trades(frame):
    rng = np.random.default_rng(9)
    fwd = [*np.round(rng.normal(size=60), 3), 0.0, 0.0]
    df = frame([("s", i % 3, float(f)) for i, f in enumerate(fwd)], "symbol string, cell int, fwd double")
    calls = {0: 2, 1: 0, 2: 1}
    sums = ev.outcome_sums(df, ["symbol", "cell"])
    called = sums.withColumn("pred_class", F.when(F.col("cell") == 0, 2).when(F.col("cell") == 1, 0).otherwise(1))
    got = ev.stats_of_sums(called, ["symbol"], 0.01).first()
    trades = [(f, calls[i % 3]) for i, f in enumerate(fwd) if calls[i % 3] != 1]
    won = [abs(f) for f, c in trades if (c == 2 and f > 0) or (c == 0 and f < 0)]
    lost = [abs(f) for f, c in trades if not ((c == 2 and f > 0) or (c == 0 and f < 0))]
    ret = np.array([*won, *(-v for v in lost)]) - 0.01
    assert (got["n_trades"], got["wins"]) == (len(trades), len(won))
    assert got["avg_gain"] == pytest.approx(np.mean(won)) and got["avg_loss"] == pytest.approx(np.mean(lost))
    assert got["mean_ev"] == pytest.approx(ret.mean()) and got["sharpe"] == pytest.approx(ret.mean() / ret.std(ddof=1))
    same = ev.outcome_sums(frame([("s", 0, 0.5)] * 3, "symbol string, cell int, fwd double"), ["symbol"])
    assert ev.stats_of_sums(same.withColumn("pred_class", F.lit(2)), ["symbol"], 0.0).first()["sharpe"] == 0.0


# --- configuration ------------------------------------------------------------------------------------


def test_a_state_that_can_not_be_left_is_refused():
    with pytest.raises(ValueError):
        BookRules(enter=0.3, leave=0.4)
    assert BookRules(wall_levels=80).depth == 80


def test_bad_arguments_are_refused(frame):
    with pytest.raises(ValueError):
        splits.n_paths(4, 4)
    with pytest.raises(ValueError):
        smoothing.savgol_taps(5, 5)
    with pytest.raises(ValueError):
        splits.purged_end(F.lit(0), F.lit(1), F.lit(1), -1)
    assert len(micro.STEPS) == len(config.MICRO) and technical.SMOOTH_ROWS > 1000


def test_each_pair_takes_the_lag_of_its_own_length(frame):
    import random

    r, rows = random.Random(5), []
    for pair, n in (("long", 300), ("short", 90)):
        x = 0.0
        for i in range(n):
            x += r.gauss(0, 1)
            rows.append((pair, i, 0.5 * x + r.gauss(0, 1), x))
    df = keep(frame(rows, "pair string, rn bigint, y double, x double"))
    got = {g["pair"]: (g["used_lag"], g["nobs"]) for g in pairs.engle_granger(df).collect()}
    want = {p: pairs.schwert_lag(n) for p, n in (("long", 300), ("short", 90))}
    assert got == {p: (lag, n - 1 - lag) for (p, lag), n in zip(want.items(), (300, 90))}
    with pytest.raises(Exception, match="fewer than 8"):
        pairs.engle_granger(df.where("rn < 7")).collect()


def test_crossed_thresholds_are_refused(frame):
    df = frame([("p", 0, 1.0)], "pair string, rn bigint, z double")
    with pytest.raises(Exception, match="leave is above entry"):
        pairs.add_positions(df, ["pair"], 1.0, 2.0).collect()


def test_posts_count_for_their_own_symbol(frame, spark):
    bars = bars_only(frame, 30)
    symbol = bars.first()["symbol"]
    days = [r["d"] for r in bars.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()]
    rows = [(s, dt.datetime.combine(d, dt.time(1)), t) for d in days for s, t in ((symbol, "good"), ("other", "bad"))]
    posts = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, text string")
    lexicon = {"good": 1.0, "bad": -1.0}
    moods = {r["symbol"]: r["mood"] for r in social.daily_posts(posts, lexicon=lexicon).collect()}
    assert moods[symbol] > 0 > moods["other"]
    seen = social.add_social(bars, posts, lexicon=lexicon).agg(F.min("social_sentiment_avg"), F.max("social_sentiment_avg")).first()
    assert seen[0] == 0.0 and seen[1] == moods[symbol]


def test_boosted_classes_find_plain_bands(spark):
    d = spark.range(300).select((F.col("id") % 30).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("z"))
    d = d.withColumn("label", F.when(F.col("x") < 10, 0.0).when(F.col("x") < 20, 1.0).otherwise(2.0))
    score = models.fit_boosted_classes(d, ["x", "z"], val=d, max_iter=8)
    out = score(d)
    assert out.columns == [*d.columns, "pred_class"]
    assert out.where("pred_class <> label").count() == 0


def test_boosted_classes_grow_no_tree_twice(spark, monkeypatch):
    d = keep(spark.range(300).select(F.rand(1).alias("x"), F.rand(2).alias("z"), F.col("id")).withColumn(
        "label", F.when(F.rand(3) < 0.7, F.floor(F.col("x") * 3)).otherwise(F.floor(F.rand(4) * 3)).cast("double")))
    fitted, fit = [], models.GBTClassifier.fit
    monkeypatch.setattr(models.GBTClassifier, "fit", lambda self, df: fitted.append(fit(self, df)) or fitted[-1])
    train, val = d.where("id < 200"), d.where("id >= 200")
    scored = models.fit_boosted_classes(train, ["x", "z"], val=val, max_iter=30, patience=3)(val)
    got = {r["id"]: r["pred_class"] for r in scored.collect()}
    assert [len(m.trees) for m in fitted] == [30] * 3
    want, cut = {}, []
    for k in range(3):
        y = models.assemble(val, ["x", "z"]).withColumn("_y", (F.col("label") == k).cast("double"))
        t = models.assemble(train, ["x", "z"]).withColumn("_y", (F.col("label") == k).cast("double"))
        gbt = models.GBTClassifier(featuresCol="features", labelCol="_y", maxDepth=3, stepSize=0.05, subsamplingRate=0.8,
                                   featureSubsetStrategy="0.8", minInstancesPerNode=5, seed=models.SEED)
        cut.append(models.best_round(gbt.setMaxIter(30).fit(t).evaluateEachIteration(y), 3))
        for r in gbt.setMaxIter(cut[-1]).fit(t).transform(y).collect():
            want.setdefault(r["id"], []).append(r["probability"][1])
    assert min(cut) < 30 and got == {i: max(range(3), key=lambda k: (p[k], -k)) for i, p in want.items()}
