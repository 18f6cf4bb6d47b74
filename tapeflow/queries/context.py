"""As-of joins, cross-asset, reference, calendar, news, social and order-book queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeflow.config import CROSS_ASSET, MACRO_EVENTS, NEWS, ORDER_BOOK, REFERENCE_NAMES, SOCIAL
from tapeflow.functions import book as ob
from tapeflow.functions.numeric import safe_corr
from tapeflow.functions.times import epoch_millis
from tapeflow.operators import asof, book, cross_asset, events, news, reference, social, technical
from tapeflow.plans.slices import number_rows, over_slices, time_bucket
from tapeflow.queries.intake import CAL, POSTS
from tapeflow.queries.registry import (
    DAILY, HOURLY, ORD, daily, hourly, query, r, r6, rs, show, win, zscore,
)
from tapeflow.plans.tables import keep
from tapeflow.sources import snapshots, tables
from tapeflow.sources.store import scratch_folder

# --- as-of ----------------------------------------------------------------------------


def _ticks(spark, sf):
    return tables.table(spark, sf, "events").select(F.col("event_type").alias("symbol"), "ts", "event_id", "value")


def _asof_sql(op):
    return f"""WITH {HOURLY} SELECT e.event_id, e.event_type AS symbol, h.ts AS bar_ts, h.close AS bar_close
      FROM events e ASOF LEFT JOIN hourly h ON e.event_type = h.symbol AND e.ts {op} h.ts"""


def _asof(spark, sf, forward):
    """A task sorts the ticks of one bar's width; earlier bars come in through the bucket ends."""
    bars = tables.hourly_bars(spark, sf).withColumn("bar_ts", F.col("ts"))
    out = asof.asof_join(_ticks(spark, sf), bars, ["symbol"], "ts", ["bar_ts", "close"],
                         time_bucket(F.col("ts"), 1.0 / 24.0), forward=forward)
    return out.select("event_id", "symbol", F.col("match.bar_ts").alias("bar_ts"),
                      F.col("match.close").alias("bar_close"))


@query("asof_backward", _asof_sql(">="))
def asof_backward(spark, sf):
    return _asof(spark, sf, False)


@query("asof_forward", _asof_sql("<="))
def asof_forward(spark, sf):
    return _asof(spark, sf, True)


_NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in REFERENCE_NAMES) + "]"
REF = f"""raw_ref AS (SELECT {_NAMES_SQL}[o_custkey % 7 + 1] AS name, o_orderdate::DATE AS d,
    avg(o_totalprice) AS v FROM orders GROUP BY 1, 2),
  ref AS (SELECT name, d, CASE name WHEN 'fear_greed' THEN v / 5000 WHEN 'funding_rate' THEN v / 2.5e7 - 0.01
    ELSE v + 1e6 END AS value FROM raw_ref)"""


@query("align_by_day", f"""WITH {DAILY}, {REF}, s AS (SELECT d, CASE WHEN value > 1300000 THEN NULL ELSE value END AS value
    FROM ref WHERE name = 'oi_chg'), b AS (SELECT DISTINCT ts::DATE AS d FROM daily)
  SELECT b.d::TIMESTAMP AS d, {r('s.value')} AS value FROM b ASOF LEFT JOIN s ON b.d >= s.d""")
def align_by_day(spark, sf):
    """A NULL value on the latest known day stays NULL."""
    s = tables.reference_levels(spark, sf).where("name = 'oi_chg'").withColumn(
        "value", F.when(F.col("value") <= 1300000, F.col("value")))
    days = asof.bar_days(tables.daily_bars(spark, sf)).withColumn("name", F.lit("oi_chg"))
    out = asof.align_days(s, days, ["name"])
    return out.select(F.col("d").cast("timestamp_ntz").alias("d"), r6(F.col("value")).alias("value"))


# --- cross-asset ------------------------------------------------------------------------
PAIR, BASKET, LEAD = "5-LOW", ("1-URGENT", "2-HIGH", "3-MEDIUM"), "1-URGENT"
_IN = "('1-URGENT', '2-HIGH', '3-MEDIUM')"
CROSS = f"""{DAILY},
  rets AS (SELECT *, ts::DATE AS d, close / nullif(lag(close) OVER {ORD}, 0) - 1 AS ret FROM daily),
  pair AS (SELECT d, greatest(-0.5, least(0.5, ret)) AS v, ret IS NULL AS none FROM rets WHERE symbol = '{PAIR}'),
  shares AS (SELECT d, sum(volume) FILTER (WHERE symbol = '{LEAD}') / nullif(sum(volume), 0) AS x
    FROM rets WHERE symbol IN {_IN} GROUP BY 1 HAVING count(*) = 3),
  sharez AS (SELECT d, coalesce({zscore('x', 60, part='true').replace('ORDER BY ts', 'ORDER BY d')}, 0) AS v FROM shares),
  basket AS (SELECT d, avg(ret) AS v FROM rets WHERE symbol IN {_IN} GROUP BY 1)"""


@query("ratio_change", f"""WITH {CROSS} SELECT b.symbol, b.ts, {r('coalesce(CASE WHEN p.none THEN NULL ELSE p.v END, 0)')} AS eth_btc_chg
  FROM daily b ASOF LEFT JOIN pair p ON b.ts::DATE >= p.d""")
def ratio_change(spark, sf):
    return show(_cross(spark, sf), "eth_btc_chg")


def _cross(spark, sf):
    return cross_asset.add_cross_asset(daily(spark, sf), PAIR, BASKET, LEAD)


@query("volume_share", f"""WITH {CROSS} SELECT b.symbol, b.ts, {r('coalesce(s.v, 0)')} AS btc_vol_share
  FROM daily b ASOF LEFT JOIN sharez s ON b.ts::DATE >= s.d""")
def volume_share(spark, sf):
    return show(_cross(spark, sf), "btc_vol_share")


_MKT = """j AS (SELECT b.*, k.v FROM rets b ASOF LEFT JOIN basket k ON b.d >= k.d),
  p AS (SELECT *, CASE WHEN ret IS NOT NULL AND v IS NOT NULL THEN ret END AS a,
          CASE WHEN ret IS NOT NULL AND v IS NOT NULL THEN v END AS c FROM j)"""
_MKT_CORR = (f"coalesce(CASE WHEN count(a) OVER {win(30)} = 30 THEN covar_samp(a, c) OVER {win(30)}"
             f" / nullif(stddev_samp(a) OVER {win(30)} * stddev_samp(c) OVER {win(30)}, 0) END, 0)")


@query("market_corr", f"WITH {CROSS}, {_MKT} SELECT symbol, ts, {r(_MKT_CORR)} AS mkt_corr FROM p")
def market_corr(spark, sf):
    return show(_cross(spark, sf), "mkt_corr")


@query("cross_asset_features", f"""WITH {CROSS}, e AS (SELECT b.symbol, b.ts, CASE WHEN p.none THEN NULL ELSE p.v END AS x
    FROM daily b ASOF LEFT JOIN pair p ON b.ts::DATE >= p.d),
  h AS (SELECT b.symbol, b.ts, s.v AS x FROM daily b ASOF LEFT JOIN sharez s ON b.ts::DATE >= s.d), {_MKT}
  SELECT symbol, ts, {r('coalesce(e.x, 0)')} AS eth_btc_chg, {r('coalesce(h.x, 0)')} AS btc_vol_share, {r(_MKT_CORR)} AS mkt_corr
  FROM p JOIN e USING (symbol, ts) JOIN h USING (symbol, ts)""")
def cross_asset_features(spark, sf):
    return show(_cross(spark, sf), *CROSS_ASSET)


@query("safe_corr", """SELECT o_orderpriority AS symbol, round(covar_samp(o_totalprice, o_custkey)
    / nullif(stddev_samp(o_totalprice) * stddev_samp(o_custkey), 0), 6) + 0.0 AS corr,
  CAST(NULL AS DOUBLE) AS corr_const FROM orders GROUP BY 1""")
def safe_corr_query(spark, sf):
    o = tables.table(spark, sf, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("symbol")).agg(
        r6(safe_corr(F.col("o_totalprice"), F.col("o_custkey").cast("double"))).alias("corr"),
        safe_corr(F.col("o_totalprice"), F.lit(1.0)).alias("corr_const"))


# --- reference series ---------------------------------------------------------------------
_RW = "(PARTITION BY name ORDER BY d)"
_MOVE = f"value / nullif(lag(value) OVER {_RW}, 0) - 1"


def _clip_sql(x, b):
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest(-{b}, least({b}, {x})) END"


_Z30 = zscore("value", 30, part="name").replace("ORDER BY ts", "ORDER BY d")
FEAT = f"""{REF}, feats AS (SELECT name, d, CASE
    WHEN name IN ('dxy_chg', 'stable_dom_chg', 'liquidity_chg') THEN {_clip_sql(_MOVE, 0.1)}
    WHEN name = 'oi_chg' THEN {_clip_sql(_MOVE, 0.5)}
    WHEN name = 'funding_rate' THEN {_clip_sql('value', 0.01)}
    WHEN name = 'onchain_z' THEN {_clip_sql(_Z30, 5)}
    WHEN name = 'fear_greed' THEN {_clip_sql('(value - 50) / 50', 1)} END AS value FROM ref)"""


def _feat_query(names):
    quoted = ", ".join(f"'{n}'" for n in names)
    return f"WITH {FEAT} SELECT name, d::TIMESTAMP AS d, {r('value')} AS value FROM feats WHERE name IN ({quoted})"


def _feats(spark, sf, *names):
    out = reference.transform(tables.reference_levels(spark, sf)).where(F.col("name").isin(list(names)))
    return out.select("name", F.col("d").cast("timestamp_ntz").alias("d"), r6(F.col("value")).alias("value"))


_CHG = ("dxy_chg", "stable_dom_chg", "liquidity_chg", "oi_chg")


@query("reference_changes", _feat_query(_CHG))
def reference_changes(spark, sf):
    return _feats(spark, sf, *_CHG)


@query("funding_clip", _feat_query(["funding_rate"]))
def funding_clip(spark, sf):
    return _feats(spark, sf, "funding_rate")


@query("onchain_zscore", _feat_query(["onchain_z"]))
def onchain_zscore(spark, sf):
    return _feats(spark, sf, "onchain_z")


@query("fear_greed_scale", _feat_query(["fear_greed"]))
def fear_greed_scale(spark, sf):
    return _feats(spark, sf, "fear_greed")


_PIVOT = ", ".join(f"{r(f'coalesce({n}.value, 0)')} AS {n}" for n in REFERENCE_NAMES)
_ASOFS = " ".join(
    f"ASOF LEFT JOIN (SELECT * FROM lagged WHERE name = '{n}') {n} ON b.ts >= {n}.d" for n in REFERENCE_NAMES)


@query("reference_features", f"""WITH {DAILY}, {FEAT},
  lagged AS (SELECT name, d::TIMESTAMP AS d, lag(value) OVER {_RW} AS value FROM feats)
  SELECT b.symbol, b.ts, {_PIVOT} FROM daily b {_ASOFS}""")
def reference_features(spark, sf):
    out = reference.add_reference(tables.daily_bars(spark, sf), tables.reference_levels(spark, sf))
    return show(out, *REFERENCE_NAMES)


@query("reference_by_symbol", f"""WITH {DAILY}, s AS (SELECT o_orderpriority AS symbol, o_orderdate::DATE AS d,
    avg(o_totalprice) / 2.5e7 - 0.01 AS v FROM orders GROUP BY 1, 2),
  l AS (SELECT symbol, d::TIMESTAMP AS d, lag(greatest(-0.01, least(0.01, v))) OVER (PARTITION BY symbol ORDER BY d) AS v FROM s)
  SELECT b.symbol, b.ts, {r('coalesce(l.v, 0) * 1000')} AS funding_rate FROM daily b ASOF LEFT JOIN l ON b.symbol = l.symbol AND b.ts >= l.d""")
def reference_by_symbol(spark, sf):
    o = tables.table(spark, sf, "orders")
    own = o.groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("d")).agg(
        (F.avg("o_totalprice") / 2.5e7 - 0.01).alias("value")).withColumn("name", F.lit("funding_rate"))
    out = reference.add_reference(tables.daily_bars(spark, sf), own, by_symbol=True)
    return show(out.withColumn("funding_rate", F.col("funding_rate") * 1000), "funding_rate")


# --- macro calendar ----------------------------------------------------------------------
EVENT = f"""{DAILY}, {CAL},
  outcomes AS (SELECT o_orderdate::DATE AS date, min(o_totalprice) / 1e4 AS forecast, max(o_totalprice) / 1e4 AS actual
    FROM orders GROUP BY 1),
  cal AS (SELECT p.*, u.forecast, u.actual FROM plan p LEFT JOIN outcomes u USING (date)),
  edays AS (SELECT date::TIMESTAMP AS date, count(*) AS n, max(importance) AS top, arg_min(importance, name) AS lead1,
    avg(actual - forecast) AS surprise FROM cal GROUP BY 1),
  ev AS (SELECT b.symbol, b.ts, coalesce(date_diff('day', b.ts, nx.date), -1)::DOUBLE AS wait,
      coalesce(x.top, nx.lead1, 0)::DOUBLE AS weight, coalesce(x.n, 0) AS flag, coalesce(x.surprise, 0) AS s
    FROM daily b ASOF LEFT JOIN edays nx ON b.ts <= nx.date LEFT JOIN edays x ON x.date = b.ts)"""


def _events(spark, sf):
    return events.add_events(daily(spark, sf), tables.macro_calendar(spark, sf))


@query("next_event_wait", f"WITH {EVENT} SELECT symbol, ts, wait AS bars_to_next_event FROM ev")
def next_event_wait(spark, sf):
    return _events(spark, sf).select("symbol", "ts", "bars_to_next_event")


@query("event_weight", f"WITH {EVENT} SELECT symbol, ts, weight AS event_importance, flag AS event_day_flag FROM ev")
def event_weight(spark, sf):
    return _events(spark, sf).select("symbol", "ts", "event_importance", "event_day_flag")


@query("event_surprise", f"WITH {EVENT} SELECT symbol, ts, {r(f'coalesce(lag(s) OVER {ORD}, 0)')} AS last_event_surprise FROM ev")
def event_surprise(spark, sf):
    return show(_events(spark, sf), "last_event_surprise")


@query("event_features", f"""WITH {EVENT} SELECT symbol, ts, wait AS bars_to_next_event, weight AS event_importance,
  flag::DOUBLE AS event_day_flag, {r(f'coalesce(lag(s) OVER {ORD}, 0)')} AS last_event_surprise FROM ev""")
def event_features(spark, sf):
    return show(_events(spark, sf), *MACRO_EVENTS)


# --- news ----------------------------------------------------------------------------------
# Function words of the invented prose stand in for a market lexicon.
WORDS = {"the": 1.0, "that": -1.0, "and": 0.5, "with": -0.5, "for": 1.0, "of": -1.0, "is": 0.25,
         "la": 1.0, "le": -1.0, "der": 0.5, "die": -0.5, "el": -0.5}
_HITS = (r"list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda t: t IN ("
         + ", ".join(f"'{k}'" for k in WORDS) + "))")
_CASE = "CASE t " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WORDS.items()) + " END"
_SCORE = f"coalesce(list_avg(list_transform({_HITS}, lambda t: ({_CASE})::DOUBLE)), 0)"
SCORED = f"""scored AS (SELECT doc_id, DATE '2024-01-01' + CAST((doc_id * 37) % 28 AS INT) AS d, {_SCORE} AS sentiment FROM documents)"""
NEWS_DAILY = f"""{SCORED},
  nd0 AS (SELECT d, avg(sentiment) AS a, coalesce(stddev_samp(sentiment), 0) AS s, count(*)::DOUBLE AS v FROM scored GROUP BY 1),
  nd AS (SELECT *, coalesce(a - lag(a) OVER (ORDER BY d), 0) AS t FROM nd0)"""
NEWS_SHIFTED = f"""{NEWS_DAILY},
  cal_days AS (SELECT unnest(generate_series((SELECT min(d) FROM nd), (SELECT max(d) FROM nd), INTERVAL 1 DAY))::DATE AS d),
  filled AS (SELECT c.d, coalesce(a, 0) AS a, coalesce(s, 0) AS s, coalesce(v, 0) AS v, coalesce(t, 0) AS t FROM cal_days c LEFT JOIN nd USING (d)),
  ns AS (SELECT d, lag(a) OVER (ORDER BY d) AS a, lag(s) OVER (ORDER BY d) AS s, lag(v) OVER (ORDER BY d) AS v, lag(t) OVER (ORDER BY d) AS t FROM filled)"""
NEWS_BARS = f"""{HOURLY}, {NEWS_SHIFTED}, nb AS (SELECT h.*, coalesce(a, 0) AS sentiment_avg, coalesce(s, 0) AS sentiment_std,
    coalesce(v, 0) AS news_volume, coalesce(t, 0) AS sentiment_trend FROM hourly h LEFT JOIN ns ON ns.d = h.ts::DATE)"""


def _scored(spark, sf):
    return news.score_news(tables.news(spark, sf), WORDS)


def _news_bars(spark, sf):
    return news.merge_news(hourly(spark, sf), news.daily_sentiment(_scored(spark, sf)))


@query("text_sentiment", f"WITH {SCORED} SELECT doc_id, {r('sentiment')} AS sentiment FROM scored")
def text_sentiment(spark, sf):
    return _scored(spark, sf).select("doc_id", r6(F.col("sentiment")).alias("sentiment"))


@query("daily_sentiment", f"""WITH {NEWS_DAILY} SELECT d::TIMESTAMP AS d, {rs(sentiment_avg='a', sentiment_std='s', sentiment_trend='t')},
  v AS news_volume FROM nd""")
def daily_sentiment(spark, sf):
    out = news.daily_sentiment(_scored(spark, sf), shift=0).withColumn("d", F.col("d").cast("timestamp_ntz"))
    return show(out, *NEWS, keys=("d",))


@query("shifted_sentiment", f"""WITH {NEWS_SHIFTED} SELECT d::TIMESTAMP AS d, {rs(sentiment_avg='a', sentiment_std='s', sentiment_trend='t')},
  v AS news_volume FROM ns""")
def shifted_sentiment(spark, sf):
    out = news.daily_sentiment(_scored(spark, sf)).withColumn("d", F.col("d").cast("timestamp_ntz"))
    return show(out, *NEWS, keys=("d",))


_NB = "sentiment_avg sentiment_std news_volume sentiment_trend".split()


@query("news_features", f"WITH {NEWS_BARS} SELECT symbol, ts, {rs(**{c: c for c in _NB})} FROM nb")
def news_features(spark, sf):
    return show(_news_bars(spark, sf), *NEWS)


@query("news_coverage", f"""WITH {NEWS_BARS} SELECT symbol, {r('avg((news_volume > 0)::INT)')} AS coverage,
  avg((news_volume > 0)::INT) < 0.3 AS low_coverage FROM nb GROUP BY 1""")
def news_coverage(spark, sf):
    return news.coverage(_news_bars(spark, sf)).select("symbol", r6(F.col("coverage")).alias("coverage"), "low_coverage")


def _corr_sql(x, y):
    both = f"CASE WHEN ({x}) IS NOT NULL AND ({y}) IS NOT NULL THEN"
    a, b = f"{both} {x} END", f"{both} {y} END"
    return f"coalesce(covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0), 0)"


@query("sentiment_price_corr", f"""WITH {NEWS_BARS}, hs AS (SELECT unnest([1, 3, 5, 10]) AS horizon),
  f AS (SELECT n.symbol, horizon, sentiment_avg, news_volume, lead(close, horizon) OVER (PARTITION BY symbol, horizon ORDER BY ts)
      / nullif(close, 0) - 1 AS fwd FROM nb n, hs)
  SELECT symbol, horizon, {r(_corr_sql('sentiment_avg', 'fwd'))} AS sent_vs_return,
    {r(_corr_sql('news_volume', 'abs(fwd)'))} AS volume_vs_volatility FROM f GROUP BY 1, 2""")
def sentiment_price_corr(spark, sf):
    return show(news.sentiment_price_corr(_news_bars(spark, sf)), "sent_vs_return", "volume_vs_volatility",
                keys=("symbol", "horizon"))


NEWS_FWD = f"""{NEWS_BARS}, nf AS (SELECT *, lead(close, 5) OVER {ORD} / nullif(close, 0) - 1 AS fwd_5d FROM nb WHERE news_volume > 0)"""


@query("top_sentiment_days", f"""WITH {NEWS_FWD}, signs AS (SELECT unnest(['pos', 'neg']) AS kind)
  SELECT kind, symbol, ts, row_number() OVER w AS rank,
  {rs(sentiment_avg='sentiment_avg', news_volume='news_volume', close='close', fwd_5d='fwd_5d')} FROM nf, signs
  WINDOW w AS (PARTITION BY kind, symbol ORDER BY CASE kind WHEN 'pos' THEN -sentiment_avg ELSE sentiment_avg END, ts)
  QUALIFY row_number() OVER w <= 10""")
def top_sentiment_days(spark, sf):
    bars = _news_bars(spark, sf)
    one = lambda kind: news.top_sentiment_days(bars, kind=kind).withColumn("kind", F.lit(kind))
    rank = F.col("rank").cast("long").alias("rank")
    return show(one("pos").unionByName(one("neg")), "sentiment_avg", "news_volume", "close", "fwd_5d",
                keys=("kind", "symbol", "ts", rank))


@query("sentiment_buckets", f"""WITH {NEWS_FWD}, k AS (SELECT *, CASE WHEN sentiment_avg <= -1.01 THEN NULL WHEN sentiment_avg <= -0.3 THEN 'very_neg'
    WHEN sentiment_avg <= -0.05 THEN 'neg' WHEN sentiment_avg <= 0.05 THEN 'neutral' WHEN sentiment_avg <= 0.3 THEN 'pos'
    WHEN sentiment_avg <= 1.01 THEN 'very_pos' END AS bucket FROM nf)
  SELECT symbol, bucket, {rs(avg_fwd_5d='avg(fwd_5d)', win_rate='avg(coalesce((fwd_5d > 0)::INT, 0))')}, count(fwd_5d) AS n
  FROM k WHERE bucket IS NOT NULL GROUP BY 1, 2""")
def sentiment_buckets(spark, sf):
    return show(news.sentiment_buckets(_news_bars(spark, sf)), "avg_fwd_5d", "win_rate", keys=("symbol", "bucket", "n"))


# --- social -----------------------------------------------------------------------------------
SOC = f"""{HOURLY}, {POSTS}, pd0 AS (SELECT symbol, ts::DATE AS d, count(text)::DOUBLE AS n, avg({_SCORE}) AS mood FROM posts GROUP BY 1, 2),
  pd1 AS (SELECT *, coalesce({zscore('n', 30, 5).replace('ORDER BY ts', 'ORDER BY d')}, 0) AS z FROM pd0),
  sj AS (SELECT h.symbol, h.ts, coalesce(z, 0) AS z, coalesce(mood, 0) AS mood FROM hourly h LEFT JOIN pd1 ON pd1.symbol = h.symbol AND pd1.d = h.ts::DATE),
  sl AS (SELECT symbol, ts, coalesce(lag(z) OVER {ORD}, 0) AS vz, coalesce(lag(mood) OVER {ORD}, 0) AS sa FROM sj)"""


@query("daily_posts", f"WITH {SOC} SELECT symbol, d::TIMESTAMP AS d, {rs(volume_z='z', mood='mood')} FROM pd1")
def daily_posts(spark, sf):
    out = social.daily_posts(tables.posts(spark, sf), lexicon=WORDS)
    return show(out.select("symbol", F.col("d").cast("timestamp_ntz").alias("d"), F.col("z").alias("volume_z"), "mood"),
                "volume_z", "mood", keys=("symbol", "d"))


@query("social_features", f"""WITH {SOC} SELECT symbol, ts, {rs(social_volume_z='vz', social_sentiment_avg='sa',
  social_polarity_shift=f'coalesce(sa - lag(sa) OVER {ORD}, 0)')} FROM sl""")
def social_features(spark, sf):
    return show(social.add_social(hourly(spark, sf), tables.posts(spark, sf), lexicon=WORDS), *SOCIAL)


# --- order book ----------------------------------------------------------------------------------
BOOKS = """levels AS (SELECT 'N' || s_nationkey AS symbol, time_bucket(INTERVAL 14 DAYS, l_shipdate, TIMESTAMP '1970-01-01') AS ts,
    CASE l_linestatus WHEN 'O' THEN 'bid' ELSE 'ask' END AS side, l_extendedprice / l_quantity AS price, l_quantity AS size,
    row_number() OVER (PARTITION BY s_nationkey, time_bucket(INTERVAL 14 DAYS, l_shipdate, TIMESTAMP '1970-01-01'), l_linestatus
      ORDER BY CASE l_linestatus WHEN 'O' THEN -l_extendedprice / l_quantity ELSE l_extendedprice / l_quantity END,
        l_orderkey, l_linenumber, l_partkey) AS r
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey QUALIFY r <= 50),
  means AS (SELECT *, avg(size) OVER (PARTITION BY symbol, ts, side) AS m FROM levels),
  b0 AS (SELECT symbol, ts, coalesce(sum(size) FILTER (WHERE side = 'bid' AND r <= 20), 0) AS bv,
      coalesce(sum(size) FILTER (WHERE side = 'ask' AND r <= 20), 0) AS av,
      max(price) FILTER (WHERE side = 'bid' AND r = 1) AS bb, max(price) FILTER (WHERE side = 'ask' AND r = 1) AS ba,
      max(size) FILTER (WHERE side = 'bid' AND r = 1) AS b1, max(size) FILTER (WHERE side = 'ask' AND r = 1) AS a1,
      count(*) FILTER (WHERE side = 'bid') AS nb, count(*) FILTER (WHERE side = 'ask') AS na,
      count(*) FILTER (WHERE side = 'bid' AND size > 3 * m) AS bid_walls,
      count(*) FILTER (WHERE side = 'ask' AND size > 3 * m) AS ask_walls FROM means GROUP BY 1, 2),
  b1 AS (SELECT *, coalesce((bv - av) / nullif(bv + av, 0), 0) AS imb, coalesce((bb + ba) / 2, bb, ba, 0) AS mid FROM b0),
  book AS (SELECT *, coalesce((bb * a1 + ba * b1) / nullif(b1 + a1, 0), mid) AS mp,
      CASE WHEN bb IS NULL OR ba IS NULL THEN 0 ELSE ba - bb END AS abs_sp,
      nb >= 5 AND na >= 5 AND bv + av > 0 AND coalesce(least(bv, av) / nullif(bv + av, 0) >= 0.02, false) AS reliable FROM b1)"""


def _books(spark, sf):
    return tables.books(spark, sf)


def _history(spark, sf):
    """Recorded signal rows: what a recorder would have stored."""
    return keep(book.signals(_books(spark, sf)))


def r9(expr):
    """Prices have up to eight decimals; nine digits keep them off rounding ties."""
    return f"(round({expr}, 9) + 0.0)"


def _r9(c):
    return F.round(c, 9) + 0.0


@query("depth_imbalance_now", f"WITH {BOOKS} SELECT symbol, ts, {r('imb')} AS imbalance FROM book")
def depth_imbalance_now(spark, sf):
    return _books(spark, sf).select("symbol", "ts", r6(ob.imbalance()).alias("imbalance"))


@query("best_prices", f"WITH {BOOKS} SELECT symbol, ts, {r9('bb')} AS best_bid, {r9('ba')} AS best_ask, {r9('mid')} AS mid_price FROM book")
def best_prices(spark, sf):
    return _books(spark, sf).select("symbol", "ts", _r9(ob.best("bids")).alias("best_bid"),
                                    _r9(ob.best("asks")).alias("best_ask"), _r9(ob.mid_price()).alias("mid_price"))


@query("book_spread", f"WITH {BOOKS} SELECT symbol, ts, {r9('abs_sp')} AS abs_spread, {r9('abs_sp / nullif(mid, 0)')} AS rel_spread FROM book")
def book_spread(spark, sf):
    return _books(spark, sf).select("symbol", "ts", _r9(ob.abs_spread()).alias("abs_spread"), _r9(ob.rel_spread()).alias("rel_spread"))


@query("book_walls", f"""WITH {BOOKS} SELECT symbol, ts, side, {r('price')} AS price, size FROM means WHERE size > 3 * m""")
def book_walls(spark, sf):
    side = lambda n, c: _books(spark, sf).select("symbol", "ts", F.lit(n).alias("side"), F.inline(ob.walls(c)))
    out = side("bid", "bids").unionByName(side("ask", "asks"))
    return out.select("symbol", "ts", "side", r6(F.col("price")).alias("price"), "size")


@query("microprice", f"WITH {BOOKS} SELECT symbol, ts, {rs(microprice='mp', micro_skew='CASE WHEN mid > 0 THEN (mp - mid) / mid ELSE 0 END')} FROM book")
def microprice(spark, sf):
    return _books(spark, sf).select("symbol", "ts", r6(ob.microprice()).alias("microprice"), r6(ob.micro_skew()).alias("micro_skew"))


_STATE = "CASE WHEN imb > 0.3 THEN 'BUY PRESSURE' WHEN imb < -0.3 THEN 'SELL PRESSURE' ELSE 'BALANCED' END"


@query("book_signals", f"""WITH {BOOKS} SELECT symbol, ts, {_STATE} AS state, round(least(abs(imb) * 100, 100), 1) + 0.0 AS confidence,
  bid_walls, ask_walls, reliable FROM book""")
def book_signals(spark, sf):
    cols = ("symbol", "ts", "state", "confidence", "bid_walls", "ask_walls", "reliable")
    return book.signals(_books(spark, sf)).select(*cols)


@query("book_reliability", f"WITH {BOOKS} SELECT symbol, ts, bv AS bid_vol, av AS ask_vol, reliable FROM book")
def book_reliability(spark, sf):
    return _books(spark, sf).select("symbol", "ts", ob.side_volume("bids", 20).alias("bid_vol"),
                                    ob.side_volume("asks", 20).alias("ask_vol"), ob.reliable().alias("reliable"))


def _step_sql(value, prev):
    return f"""CASE WHEN {prev} = 'BUY PRESSURE' AND {value} > 0.15 THEN 'BUY PRESSURE'
      WHEN {prev} = 'SELL PRESSURE' AND {value} < -0.15 THEN 'SELL PRESSURE'
      WHEN {value} > 0.3 THEN 'BUY PRESSURE' WHEN {value} < -0.3 THEN 'SELL PRESSURE' ELSE 'BALANCED' END"""


def _book_rows(spark, sf):
    s = _books(spark, sf).select("symbol", "ts", ob.imbalance().alias("imb"))
    return number_rows(s, ["symbol"], ["ts"], time_bucket(F.col("ts"), 1.0))


# The recursion replays the state machine snapshot by snapshot.
@query("book_hysteresis", f"""WITH RECURSIVE {BOOKS}, n AS (SELECT symbol, ts, imb, row_number() OVER {ORD} AS k FROM book),
  walk AS (SELECT symbol, ts, k, {_step_sql('imb', "'BALANCED'")} AS state FROM n WHERE k = 1
    UNION ALL SELECT n.symbol, n.ts, n.k, {_step_sql('n.imb', 'w.state')} FROM walk w JOIN n ON n.symbol = w.symbol AND n.k = w.k + 1)
  SELECT symbol, ts, state FROM walk""")
def book_hysteresis(spark, sf):
    return book.add_hysteresis(_book_rows(spark, sf), "imb").select("symbol", "ts", "state")


@query("book_tracker", f"""WITH RECURSIVE {BOOKS}, n AS (SELECT symbol, ts, reliable, round(imb, 4) AS raw, row_number() OVER {ORD} AS k FROM book),
  walk AS (
    SELECT symbol, ts, k, reliable, CASE WHEN reliable THEN raw END AS ema,
      CASE WHEN reliable THEN {_step_sql('raw', "'BALANCED'")} ELSE 'BALANCED' END AS held FROM n WHERE k = 1
    UNION ALL
    SELECT symbol, ts, k, reliable, ema, CASE WHEN reliable THEN {_step_sql('ema', 'prev')} ELSE prev END FROM (
      SELECT n.symbol, n.ts, n.k, n.reliable, w.held AS prev,
        CASE WHEN NOT n.reliable THEN w.ema WHEN w.ema IS NULL THEN n.raw ELSE 0.3 * n.raw + 0.7 * w.ema END AS ema
      FROM walk w JOIN n ON n.symbol = w.symbol AND n.k = w.k + 1) z)
  SELECT symbol, ts, CASE WHEN reliable THEN held ELSE 'THIN BOOK' END AS state,
    round(coalesce(ema, 0) * pi(), 9) + 0.0 AS scaled, reliable FROM walk""")
def book_tracker(spark, sf):
    """Smoothed values are compared times pi, which keeps them off rounding ties."""
    out = book.track(_history(spark, sf))
    return out.select("symbol", "ts", "state", _r9(F.col("smoothed") * F.pi()).alias("scaled"), "reliable")


SPANS = f"""{BOOKS}, nbars AS (SELECT 'N' || s_nationkey AS symbol, time_bucket(INTERVAL 60 DAYS, l_shipdate, TIMESTAMP '1970-01-01') AS ts
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
  spans AS (SELECT symbol, ts, coalesce(lag(ts) OVER {ORD}, ts - (lead(ts) OVER {ORD} - ts)) AS lo FROM nbars),
  snap AS (SELECT b.symbol, b.ts, s.ts AS bar_ts, round(imb, 4) AS imbalance, round(CASE WHEN mid > 0 THEN (mp - mid) / mid ELSE 0 END, 6) AS skew,
      round(coalesce(abs_sp / nullif(mid, 0), 0), 6) AS rel, bid_walls + ask_walls AS walls
    FROM book b JOIN spans s ON s.symbol = b.symbol AND b.ts > s.lo AND b.ts <= s.ts),
  per AS (SELECT symbol, bar_ts, last(imbalance ORDER BY ts) AS imbalance, last(skew ORDER BY ts) AS skew, last(rel ORDER BY ts) AS rel,
      avg(walls) AS walls FROM snap GROUP BY 1, 2),
  pb AS (SELECT n.symbol, n.ts, p.imbalance, p.skew, p.rel, p.walls FROM nbars n LEFT JOIN per p ON p.symbol = n.symbol AND p.bar_ts = n.ts)"""


@query("stored_history", f"WITH {BOOKS} SELECT symbol, ts, round(imb, 4) + 0.0 AS imbalance, bid_walls, ask_walls FROM book")
def stored_history(spark, sf):
    """Snapshots as the recorder stores them, with times in milliseconds, read back as a history."""
    folder = scratch_folder(spark)
    rows = book.signals(_books(spark, sf)).withColumn("timestamp", epoch_millis(F.col("ts")))
    rows.select(*[F.col(f.name).cast(f.dataType) for f in snapshots.SNAPSHOT_SCHEMA]).write.parquet(folder)
    out = snapshots.read_history(spark, folder)
    return out.select("symbol", "ts", (F.col("imbalance") + 0.0).alias("imbalance"), F.col("bid_walls").cast("long").alias("bid_walls"),
                      F.col("ask_walls").cast("long").alias("ask_walls"))


def _nation_bars(spark, sf):
    return number_rows(keep(tables.nation_bars(spark, sf)), ["symbol"], ["ts"], time_bucket(F.col("ts"), 365.0))


@query("snapshot_bars", f"WITH {SPANS} SELECT symbol, ts, bar_ts FROM snap")
def snapshot_bars(spark, sf):
    return book.assign_to_bars(_history(spark, sf), _nation_bars(spark, sf)).select("symbol", "ts", "bar_ts")


@query("book_features", f"""WITH {SPANS} SELECT symbol, ts, {rs(depth_imbalance='coalesce(imbalance, 0)', wall_persistence='coalesce(walls, 0)',
  microprice_drift=f'coalesce(skew - lag(skew) OVER {ORD}, 0)', spread_regime=f"coalesce({zscore('rel', 20, 3)}, 0)")} FROM pb""")
def book_features(spark, sf):
    return show(book.add_book_features(_nation_bars(spark, sf), _history(spark, sf)), *ORDER_BOOK)


def _one_book_feature(name, expr):
    @query(name, f"WITH {SPANS} SELECT symbol, ts, {r(expr)} AS {name} FROM pb")
    def run(spark, sf):
        return show(book.add_book_features(_nation_bars(spark, sf), _history(spark, sf)), name)

    return run


_one_book_feature("depth_imbalance", "coalesce(imbalance, 0)")
_one_book_feature("wall_persistence", "coalesce(walls, 0)")
_one_book_feature("microprice_drift", f"coalesce(skew - lag(skew) OVER {ORD}, 0)")
_one_book_feature("spread_regime", f"coalesce({zscore('rel', 20, 3)}, 0)")


@query("book_history", f"""WITH {BOOKS} SELECT symbol, epoch_ms(ts) AS timestamp, round(imb, 4) + 0.0 AS imbalance, bid_walls, ask_walls FROM book""")
def book_history(spark, sf):
    """Recorded layout: milliseconds and scalars, read back with a naive time."""
    s = _history(spark, sf)
    return s.select("symbol", epoch_millis(F.col("ts")).alias("timestamp"),
                    (F.col("imbalance") + 0.0).alias("imbalance"), "bid_walls", "ask_walls")
