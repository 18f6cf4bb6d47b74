"""Source, store, calendar and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeflow.functions.numeric import clip, finite
from tapeflow.functions.times import epoch_millis, epoch_seconds
from tapeflow.operators import micro, technical, validate
from tapeflow.plans.slices import over_slices
from tapeflow.queries.registry import DAILY, HOURLY, ORD, daily, hourly, query, r, r6, show
from tapeflow.sources import bars as bar_src
from tapeflow.sources import calendar, ledger, payloads, store, tables, texts, upsert

BARS = "symbol, ts, open, high, low, close, volume"


def _bars(spark, sf):
    return tables.hourly_bars(spark, sf)


def _as_raw(bars, page=0):
    return bars.select(
        "symbol", F.lit(page).alias("page"),
        epoch_millis(F.col("ts")).alias("ms"), *bar_src.BAR_COLS,
    )


@query("tick_bars", f"WITH {HOURLY} SELECT {BARS} FROM hourly")
def tick_bars(spark, sf):
    return _bars(spark, sf).select(*BARS.split(", "))


@query("landed_bars", f"WITH {HOURLY} SELECT {BARS}, 'crypto' AS source FROM hourly")
def landed_bars(spark, sf):
    return bar_src.land_bars(_as_raw(_bars(spark, sf))).select(*BARS.split(", "), "source")


# The first page holds only the bars that small ticks form; the second holds all bars.
@query("paged_history", f"""WITH {HOURLY}, small AS (
    SELECT event_type AS symbol, date_trunc('hour', ts) AS ts,
      first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
      last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume
    FROM events WHERE value < 20 GROUP BY 1, 2)
  SELECT {BARS} FROM small UNION ALL
  SELECT {BARS} FROM hourly h WHERE NOT EXISTS (
    SELECT 1 FROM small s WHERE s.symbol = h.symbol AND s.ts = h.ts)""")
def paged_history(spark, sf):
    ev = tables.table(spark, sf, "events").where("value < 20").select(
        F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"),
        F.col("value").alias("price"), F.lit(1.0).alias("size"))
    small = bar_src.ticks_to_bars(ev, "1 hour")
    pages = _as_raw(small, 0).unionByName(_as_raw(_bars(spark, sf), 1))
    return bar_src.merge_pages(pages).select(*BARS.split(", "))


@query("latest_bars", f"""WITH {HOURLY} SELECT {BARS} FROM hourly
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 168""")
def latest_bars(spark, sf):
    return bar_src.latest_bars(_bars(spark, sf), 168).select(*BARS.split(", "))


@query("bar_round_trip", f"WITH {HOURLY} SELECT {BARS} FROM hourly")
def bar_round_trip(spark, sf):
    """Save bars by kind and symbol, then load one kind back with pruned partitions."""
    folder = store.scratch_folder(spark)
    stamp = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    store.save(_bars(spark, sf), folder, "price", stamp)
    return store.load(spark, folder, "price").select(*BARS.split(", "))


@query("trades_after_upsert", """WITH t AS (SELECT l_shipdate, l_orderkey, l_linenumber, l_quantity, o_orderstatus FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
  u AS (SELECT strftime(l_shipdate, '%Y') AS year, CASE WHEN o_orderstatus = 'O' THEN l_quantity * 2 ELSE l_quantity END AS qty FROM t
    WHERE NOT (o_orderstatus = 'P' AND l_linenumber = 1)) SELECT year, count(*) AS n, sum(qty) AS qty FROM u GROUP BY 1""")
def trades_after_upsert(spark, sf):
    """A stored ledger by year in which trades are corrected and taken back; applied twice, it changes once."""
    folder = store.scratch_folder(spark)
    own = tables.trades(spark, sf).select("order_id", "line", "seq", "symbol", "ts", "qty", F.date_format("ts", "yyyy").alias("year"))
    key = ["year", "order_id", "line", "seq"]
    upsert.upsert(spark, folder, own, key, "year", "first")
    status = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), "o_orderstatus")
    met = own.join(status, "order_id")
    gone = (F.col("o_orderstatus") == "P") & (F.col("line") == 1)
    changes = met.where((F.col("o_orderstatus") == "O") | gone).withColumns({"qty": F.col("qty") * 2, "gone": gone}).drop("o_orderstatus")
    for _ in range(2):
        upsert.upsert(spark, folder, changes, key, "year", "second")
    stored = spark.read.schema(own.schema).parquet(folder)
    return stored.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"))


@query("dataset_delete", f"""WITH {HOURLY}, {DAILY}, a AS (
    SELECT symbol, 'price' AS kind, ts FROM hourly WHERE symbol <> 'click' UNION ALL SELECT symbol, 'dataset', ts FROM daily WHERE symbol <> '1-URGENT')
  SELECT symbol, kind, count(*) AS rows, min(ts) AS start_ts, max(ts) AS end_ts FROM a GROUP BY 1, 2""")
def dataset_delete(spark, sf):
    """Store two kinds, drop one symbol of one kind and one symbol of all kinds, list what is left."""
    folder = store.scratch_folder(spark)
    stamp = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    for kind, bars in (("price", _bars(spark, sf)), ("dataset", tables.daily_bars(spark, sf))):
        store.save(bars, folder, kind, stamp)
    store.delete(spark, folder, "click", "price")
    store.delete(spark, folder, "1-URGENT")
    return store.catalog(spark.read.parquet(folder)).drop("saved_at")


@query("dataset_catalog", f"""WITH {HOURLY}, {DAILY}, a AS (
    SELECT symbol, 'price' AS kind, ts FROM hourly UNION ALL SELECT symbol, 'dataset', ts FROM daily)
  SELECT symbol, kind, count(*) AS rows, min(ts) AS start_ts, max(ts) AS end_ts FROM a GROUP BY 1, 2""")
def dataset_catalog(spark, sf):
    return _catalog(spark, sf).drop("saved_at")


def _catalog(spark, sf):
    parts = [
        bars.select("symbol", F.lit(kind).alias("kind"), "ts", F.col("ts").alias("saved_at"))
        for kind, bars in (("price", _bars(spark, sf)), ("dataset", tables.daily_bars(spark, sf)))
    ]
    return store.catalog(parts[0].unionByName(parts[1]))


@query("dataset_freshness", f"""WITH {HOURLY}, {DAILY}, a AS (
    SELECT symbol, 'price' AS kind, ts FROM hourly UNION ALL SELECT symbol, 'dataset', ts FROM daily),
  c AS (SELECT symbol, kind, max(ts) AS saved_at FROM a GROUP BY 1, 2)
  SELECT symbol, kind, {r("epoch(TIMESTAMP '2024-01-31 06:00:00' - saved_at) / 3600.0")} AS age_hours,
    epoch(TIMESTAMP '2024-01-31 06:00:00' - saved_at) / 3600.0 <= 12 AS is_fresh FROM c""")
def dataset_freshness(spark, sf):
    as_of = F.lit("2024-01-31 06:00:00").cast("timestamp_ntz")
    out = store.with_age(_catalog(spark, sf), as_of)
    return out.select("symbol", "kind", r6(F.col("age_hours")).alias("age_hours"), "is_fresh")


@query("dataset_variants", f"""WITH {HOURLY}, d AS (SELECT DISTINCT
      DATE '2024-01-01' + CAST((doc_id * 37) % 28 AS INT) AS d FROM documents),
  j AS (SELECT h.symbol, d.d IS NOT NULL AS with_news FROM hourly h LEFT JOIN d ON d.d = h.ts::DATE)
  SELECT symbol, CASE WHEN with_news THEN 'dataset_news' ELSE 'dataset' END AS kind, count(*) AS rows
  FROM j GROUP BY 1, 2""")
def dataset_variants(spark, sf):
    days = tables.news(spark, sf).select("d").distinct().withColumn("has", F.lit(True))
    j = _bars(spark, sf).withColumn("d", F.to_date("ts")).join(days, "d", "left")
    kind = store.dataset_kind(F.coalesce("has", F.lit(False)))
    return j.groupBy("symbol", kind.alias("kind")).agg(F.count(F.lit(1)).alias("rows"))


@query("build_many", f"""WITH {HOURLY}, c AS (SELECT symbol, count(*) AS n FROM hourly GROUP BY 1)
  SELECT symbol, n AS rows, CASE WHEN n < 675 THEN 'too_short' ELSE 'accepted' END AS outcome FROM c""")
def build_many(spark, sf):
    """One job over all symbols; a symbol that fails its checks becomes a reject row."""
    bars = _bars(spark, sf)
    report = validate.ohlcv_report(bars, min_rows=675)
    good = validate.accepted(bars, report).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))
    bad = validate.rejects(report).select("symbol", "rows", F.col("reason").alias("outcome"))
    return good.withColumn("outcome", F.lit("accepted")).unionByName(bad)


# --- delivered payloads: one JSON document per event, error events carry bad values --

def _epoch():
    return epoch_seconds(F.col("ts")).cast("string")


def _payload(spark, sf, *parts):
    ev = tables.table(spark, sf, "events")
    return ev.select(F.concat(*parts).alias("payload"), F.col("event_id").alias("seq"))


def _daily_out(df):
    return df.select("name", F.col("d").cast("timestamp_ntz").alias("d"), "value")


def _last_sql(name, value, where="event_type <> 'error'"):
    return f"""SELECT '{name}' AS name, date_trunc('day', ts)::TIMESTAMP AS d,
      last({value} ORDER BY event_id) AS value FROM events WHERE {where} GROUP BY 2"""


def _value():
    return F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string"))


@query("fear_greed_payload", _last_sql("fear_greed", "value"))
def fear_greed_payload(spark, sf):
    p = _payload(spark, sf, F.lit('{"data":[{"timestamp":"x","value":"1"},{"timestamp":"'), _epoch(),
                 F.lit('","value":"'), _value(), F.lit('"}]}'))
    return _daily_out(payloads.parse_fear_greed(p))


@query("stable_supply_payload", _last_sql("stable_dom_chg", "value"))
def stable_supply_payload(spark, sf):
    amount = F.when(F.col("event_type") == "view", F.concat(F.lit('{"peggedUSD":'), F.col("value").cast("string"), F.lit("}"))
                    ).when(F.col("event_type") == "error", '"n/a"').otherwise(F.col("value").cast("string"))
    p = _payload(spark, sf, F.lit('[{"date":"'), _epoch(), F.lit('","totalCirculatingUSD":'), amount, F.lit("}]"))
    return _daily_out(payloads.parse_stable_supply(p))


def _ms():
    return epoch_millis(F.col("ts")).cast("string")


@query("open_interest_payload", _last_sql(
    "oi_chg", "CASE WHEN event_type = 'click' THEN value * 2 ELSE value END"))
def open_interest_payload(spark, sf):
    stated = F.when(F.col("event_type") == "click", "0").when(F.col("event_type") == "error", "null").otherwise(F.col("value").cast("string"))
    amount = F.when(F.col("event_type") == "error", "null").otherwise((F.col("value") * 2).cast("string"))
    p = _payload(spark, sf, F.lit('[{"timestamp":'), _ms(), F.lit(',"openInterestValue":'), stated,
                 F.lit(',"openInterestAmount":'), amount, F.lit("}]"))
    return _daily_out(payloads.parse_derivatives(p, "oi", "BTC/USDT"))


@query("funding_payload", _last_sql("funding_rate", "value"))
def funding_payload(spark, sf):
    rate = F.when(F.col("event_type") == "error", "null").otherwise(F.col("value").cast("string"))
    p = _payload(spark, sf, F.lit('[{"timestamp":'), _ms(), F.lit(',"fundingRate":'), rate, F.lit("}]"))
    return _daily_out(payloads.parse_derivatives(p, "funding", "BTC/USDT"))


@query("observations_payload", _last_sql("dxy_chg", "value"))
def observations_payload(spark, sf):
    value = F.when(F.col("event_type") == "error", ".").otherwise(F.col("value").cast("string"))
    p = _payload(spark, sf, F.lit('{"observations":[{"date":"'), F.date_format("ts", "yyyy-MM-dd"),
                 F.lit('","value":"'), value, F.lit('"}]}'))
    return _daily_out(payloads.parse_observations(p, "dxy_chg"))


@query("onchain_payload", _last_sql("onchain_z", "value"))
def onchain_payload(spark, sf):
    p = _payload(spark, sf, F.lit('{"data":[{"time":"'), F.date_format("ts", "yyyy-MM-dd"),
                 F.lit('T00:00:00.000000000Z","AdrActCnt":"'), _value(), F.lit('"}]}'))
    return _daily_out(payloads.parse_onchain(p, "AdrActCnt", "BTC/USDT"))


# --- news and posts -----------------------------------------------------------------

NEWS = r"""news AS (SELECT doc_id, DATE '2024-01-01' + CAST((doc_id * 37) % 28 AS INT) AS d,
  regexp_extract(text, '^([^\n]*)', 1) AS title, text,
  CASE WHEN doc_id % 3 = 0 THEN 'newsapi' ELSE 'rss' END AS source FROM documents)"""


def _raw_news(spark, sf):
    n = tables.news(spark, sf)
    stamp = F.when(F.length("text") < 120, "no date").when(
        F.col("source") == "rss", F.concat(F.date_format("d", "d MMM yyyy"), F.lit(" 08:00:00 +0000"))
    ).otherwise(F.concat(F.date_format("d", "yyyy-MM-dd"), F.lit("T12:30:00Z")))
    return n.select(stamp.alias("published"), "title", F.col("text").alias("summary"), "source",
                    F.col("doc_id").alias("seq"))


@query("landed_news", f"""WITH {NEWS} SELECT doc_id AS seq, d::TIMESTAMP AS d, source,
  length(title || '. ' || text) AS chars, md5(title || '. ' || text) AS digest
  FROM news WHERE length(text) >= 120""")
def landed_news(spark, sf):
    n = texts.land_news(_raw_news(spark, sf))
    return n.select("seq", F.col("d").cast("timestamp_ntz").alias("d"), "source",
                    F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


@query("united_news", f"""WITH {NEWS}, k AS (SELECT *, row_number() OVER (PARTITION BY title
    ORDER BY CASE source WHEN 'rss' THEN 0 ELSE 1 END, doc_id) AS k FROM news WHERE length(text) >= 120)
  SELECT doc_id AS seq, d::TIMESTAMP AS d, source, md5(title) AS title FROM k WHERE k = 1""")
def united_news(spark, sf):
    n = texts.land_news(_raw_news(spark, sf))
    u = texts.union_news(n.where("source = 'rss'"), n.where("source = 'newsapi'"))
    return u.select("seq", F.col("d").cast("timestamp_ntz").alias("d"), "source", F.md5("title").alias("title"))


POSTS = """posts AS (SELECT conv_id, turn, TIMESTAMP '2024-01-01' + to_days(CAST((conv_id * 13) % 31 AS INT))
    + to_hours(CAST(conv_id % 24 AS INT)) + to_minutes(CAST(turn AS INT)) AS ts, text,
  CASE WHEN role = 'user' THEN 'reddit' ELSE 'x' END AS source,
  ['click', 'view', 'BTC'][((conv_id % 3) + 3) % 3 + 1] AS symbol FROM conversations)"""


def _raw_posts(spark, sf):
    p = tables.posts(spark, sf)
    return p.select(
        "conv_id", "turn", epoch_seconds(F.col("ts")).alias("created_utc"),
        F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("title"),
        F.col("text").alias("selftext"), "source", "symbol",
        F.when(F.col("turn") > 0, F.col("conv_id")).alias("score"), F.col("turn").alias("num_comments"),
    )


@query("landed_posts", f"""WITH {POSTS} SELECT ts, source, symbol,
  md5('turn ' || turn || ' ' || text) AS digest,
  coalesce(CASE WHEN turn > 0 THEN conv_id END, 1) + turn AS engagement FROM posts
  WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'""")
def landed_posts(spark, sf):
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05 00:00:00", "2024-01-25 00:00:00"))
    p = texts.land_posts(_raw_posts(spark, sf), lo, hi)
    return p.select("ts", "source", "symbol", F.md5("text").alias("digest"), "engagement")


@query("united_posts", f"""WITH {POSTS} SELECT source, date_trunc('day', ts)::TIMESTAMP AS d, count(*) AS n
  FROM posts WHERE source IN ('reddit', 'x') GROUP BY 1, 2""")
def united_posts(spark, sf):
    p = tables.posts(spark, sf)
    feeds = [p.where("source = 'reddit'"), p.where("source = 'x'")]
    u = texts.union_posts(feeds, ["reddit", "x"])
    return u.groupBy("source", F.to_date("ts").cast("timestamp_ntz").alias("d")).agg(F.count(F.lit(1)).alias("n"))


@query("search_terms", """SELECT o_orderpriority AS symbol, CASE o_orderstatus WHEN 'F' THEN 'Bitcoin'
    WHEN 'O' THEN 'Solana' ELSE 'USD' END AS term, count(*) AS n FROM orders GROUP BY 1, 2""")
def search_terms(spark, sf):
    pair = F.when(F.col("o_orderstatus") == "F", "BTC/USDT").when(F.col("o_orderstatus") == "O", "SOL/USDT").otherwise("USD")
    return tables.table(spark, sf, "orders").groupBy(
        F.col("o_orderpriority").alias("symbol"), texts.search_term(pair).alias("term")
    ).agg(F.count(F.lit(1)).alias("n"))


# --- calendar -------------------------------------------------------------------------

CAL = """span AS (SELECT min(o_orderdate)::DATE AS lo, max(o_orderdate)::DATE AS hi FROM orders),
  days AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS day, lo, hi FROM span),
  proposed AS (
    SELECT 'FOMC' AS name, 3 AS importance, day AS date, lo, hi FROM days
      WHERE (weekofyear(day) - 1) % 6 = 0 AND isodow(day) = 3
    UNION ALL SELECT 'FOMC_Minutes', 2, day + 21, lo, hi FROM days
      WHERE (weekofyear(day) - 1) % 6 = 0 AND isodow(day) = 3
    UNION ALL SELECT n, i, date_trunc('month', day)::DATE + k, lo, hi FROM days,
      (VALUES ('CPI', 3, 11), ('PPI', 2, 11), ('Retail_Sales', 2, 13)) v(n, i, k)
    UNION ALL SELECT 'NFP', 3, (date_trunc('month', day)::DATE
      + CAST((12 - isodow(date_trunc('month', day))) % 7 AS INT)), lo, hi FROM days
    UNION ALL SELECT 'GDP', 3, day, lo, hi FROM days WHERE month(day) IN (1, 4, 7, 10) AND day(day) = 28
    UNION ALL SELECT 'Unemployment_Claims', 2, day + CAST((12 - isodow(day)) % 7 AS INT), lo, hi FROM days),
  plan AS (SELECT DISTINCT date, name, importance FROM proposed WHERE date BETWEEN lo AND hi)"""


def plan(spark, sf):
    span = tables.table(spark, sf, "orders").agg(
        F.to_date(F.min("o_orderdate")).alias("first_day"), F.to_date(F.max("o_orderdate")).alias("last_day"))
    return calendar.static_calendar(span)


@query("static_calendar", f"WITH {CAL} SELECT date::TIMESTAMP AS date, name, 'US' AS country, importance FROM plan")
def static_calendar(spark, sf):
    return plan(spark, sf).select(F.col("date").cast("timestamp_ntz").alias("date"), "name", "country", "importance")


@query("calendar_range", f"""WITH {CAL} SELECT date::TIMESTAMP AS date, name FROM plan
  WHERE date BETWEEN DATE '1998-01-01' AND DATE '1999-06-30'""")
def calendar_range(spark, sf):
    out = calendar.in_range(plan(spark, sf), "1998-01-01", "1999-06-30")
    return out.select(F.col("date").cast("timestamp_ntz").alias("date"), "name")


# --- ledgers --------------------------------------------------------------------------

@query("active_trades", """WITH t AS (SELECT 'S' || l_suppkey AS symbol, l_quantity, l_shipdate, l_orderkey, l_linenumber FROM lineitem)
  SELECT symbol, count(*) AS n, sum(l_quantity) AS qty FROM t
  WHERE NOT (l_linenumber = 1 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')) GROUP BY 1""")
def active_trades(spark, sf):
    """The first trade of each order in process is taken back; the order's other trades stay."""
    gone = tables.table(spark, sf, "orders").where("o_orderstatus = 'P'").select(
        F.col("o_orderkey").alias("order_id"), F.lit(1).alias("line"))
    left = ledger.active_trades(tables.trades(spark, sf), gone, ["order_id", "line"])
    return left.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"))


@query("traded_symbols", "SELECT DISTINCT 'S' || l_suppkey AS symbol FROM lineitem")
def traded_symbols(spark, sf):
    return ledger.traded_symbols(tables.trades(spark, sf))


@query("trades_of_symbol", """SELECT l_shipdate AS ts, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
  l_quantity AS qty FROM lineitem WHERE l_suppkey = 0""")
def trades_of_symbol(spark, sf):
    return ledger.trades_of(tables.trades(spark, sf, "S0"), "S0").select("ts", "side", "qty")


# --- validation -----------------------------------------------------------------------

REPORT = """g AS (SELECT symbol, count(*) AS rows, min(ts) AS start_ts, max(ts) AS end_ts,
    count(*) FILTER (WHERE high < low OR high < open OR high < close OR low > open OR low > close) AS ohlc_violations,
    date_diff('day', min(ts::DATE), max(ts::DATE)) + 1 AS span, count(DISTINCT ts::DATE) AS days,
    count(*) FILTER (WHERE volume = 0) AS zero_volume_rows FROM daily GROUP BY 1)"""


@query("column_report", f"WITH {HOURLY} " + " UNION ALL ".join(
    f"SELECT '{c}' AS name, true AS present, count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM hourly" for c in ("open", "high", "low", "close")) +
    " UNION ALL SELECT 'volume', false, NULL::BIGINT FROM (SELECT 1)")
def column_report(spark, sf):
    """Which required columns a delivery has, and how many of their values are missing."""
    return validate.column_report(_bars(spark, sf).drop("volume"))


@query("ohlcv_report", f"""WITH {DAILY}, {REPORT} SELECT symbol, rows, start_ts, end_ts, ohlc_violations,
  span - days AS missing_periods, zero_volume_rows, rows < 252 AS too_short,
  ohlc_violations / rows > 0.05 AS bad_ohlc, (span - days) / span > 0.05 AS gap_warning,
  zero_volume_rows / rows > 0.1 AS zero_volume_warning FROM g""")
def ohlcv_report(spark, sf):
    return validate.ohlcv_report(tables.daily_bars(spark, sf))


@query("min_length", f"WITH {HOURLY} SELECT symbol, count(*) < 675 AS too_short FROM hourly GROUP BY 1")
def min_length(spark, sf):
    return validate.ohlcv_report(_bars(spark, sf), min_rows=675).select("symbol", "too_short")


# A vendor's view with the closing tick mislabelled as the low makes real violations.
@query("ohlc_violations", f"""WITH {HOURLY} SELECT symbol,
  count(*) FILTER (WHERE high < close OR close > open) AS n_bad FROM hourly GROUP BY 1""")
def ohlc_violations(spark, sf):
    wrong = _bars(spark, sf).withColumn("low", F.col("close"))
    return validate.ohlcv_report(wrong).select("symbol", F.col("ohlc_violations").alias("n_bad"))


@query("missing_days", f"""WITH {DAILY}, s AS (SELECT symbol, min(ts)::DATE AS lo, max(ts)::DATE AS hi FROM daily GROUP BY 1),
  f AS (SELECT symbol, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS d FROM s)
  SELECT symbol, d::TIMESTAMP AS d FROM f WHERE NOT EXISTS (SELECT 1 FROM daily b WHERE b.symbol = f.symbol AND b.ts = f.d)""")
def missing_days(spark, sf):
    out = validate.missing_days(tables.daily_bars(spark, sf))
    return out.select("symbol", F.col("d").cast("timestamp_ntz").alias("d"))


@query("zero_volume", """WITH b AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts,
    sum(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END) AS volume FROM events GROUP BY 1, 2)
  SELECT symbol, count(*) FILTER (WHERE volume = 0) AS zero_volume_rows,
    count(*) FILTER (WHERE volume = 0) / count(*) > 0.1 AS zero_volume_warning FROM b GROUP BY 1""")
def zero_volume(spark, sf):
    ev = tables.table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"),
        F.col("value").alias("price"), F.when(F.col("value") > 20, 1.0).otherwise(0.0).alias("size"))
    rep = validate.ohlcv_report(bar_src.ticks_to_bars(ev, "1 hour"))
    return rep.select("symbol", "zero_volume_rows", "zero_volume_warning")


@query("missing_values", f"""WITH {HOURLY}, f AS (SELECT symbol, close / nullif(lag(close, 5) OVER {ORD}, 0) - 1 AS a,
    lead(close, 5) OVER {ORD} AS b FROM hourly)
  SELECT symbol, sum(CASE WHEN a IS NULL THEN 1 ELSE 0 END + CASE WHEN b IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_missing,
    0::BIGINT AS n_inf FROM f GROUP BY 1""")
def missing_values(spark, sf):
    steps = (technical.add_returns, technical.add_target)
    df = over_slices(hourly(spark, sf), ["symbol"], steps, 10, 5)
    return validate.missing_values(df, ["ret_5d", "target"])


@query("clean_inf", """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN NULL
  ELSE value END AS value FROM events""")
def clean_inf(spark, sf):
    v = F.when(F.col("event_type") == "error", float("inf")).when(F.col("event_type") == "view", float("nan")).otherwise(F.col("value"))
    return tables.table(spark, sf, "events").select("event_id", finite(v).alias("value"))


@query("complete_rows", f"""WITH {HOURLY}, f AS (SELECT symbol, ts, close / nullif(lag(close, 10) OVER {ORD}, 0) - 1 AS a,
    lead(close, 5) OVER {ORD} / nullif(close, 0) - 1 AS target FROM hourly)
  SELECT symbol, ts, {r('a')} AS ret_10d, {r('target')} AS target FROM f WHERE a IS NOT NULL AND target IS NOT NULL""")
def complete_rows(spark, sf):
    df = over_slices(hourly(spark, sf), ["symbol"], (technical.add_returns, technical.add_target), 10, 5)
    return show(validate.complete_rows(df, ["ret_10d", "target"]), "ret_10d", "target")


@query("clip_bounds", f"""WITH {DAILY} SELECT symbol, ts,
  {r(f'greatest(-0.5, least(0.5, close / nullif(lag(close) OVER {ORD}, 0) - 1))')} AS ret FROM daily
  QUALIFY lag(close) OVER {ORD} IS NOT NULL""")
def clip_bounds(spark, sf):
    df = over_slices(daily(spark, sf), ["symbol"], [technical.add_returns], 10)
    df = df.withColumn("ret", clip(F.col("ret_1d"), -0.5, 0.5)).where("ret IS NOT NULL")
    return show(df, "ret")


@query("winsorized", f"""WITH {HOURLY}, f AS (SELECT symbol, ts, (high - low) / nullif(close, 0) AS x FROM hourly),
  q AS (SELECT symbol, quantile_cont(x, 0.005) AS lo, quantile_cont(x, 0.995) AS hi FROM f GROUP BY 1)
  SELECT symbol, ts, {r('CASE WHEN lo < hi THEN greatest(lo, least(hi, x)) ELSE x END')} AS hl_range
  FROM f JOIN q USING (symbol)""")
def winsorized(spark, sf):
    df = micro.add_range(_bars(spark, sf))
    return show(validate.winsorize(df, ["hl_range"]), "hl_range")


@query("trade_rejects", """SELECT CASE WHEN l_quantity - 25 <= 0 THEN 'qty' ELSE 'fee' END AS reason, count(*) AS n
  FROM lineitem WHERE l_quantity - 25 <= 0 OR l_tax - 0.04 < 0 GROUP BY 1""")
def trade_rejects(spark, sf):
    """Net quantities and fees after a rebate; what falls to zero or below is no trade."""
    li = tables.table(spark, sf, "lineitem").select(
        F.lit("BUY").alias("side"), (F.col("l_quantity") - 25).alias("qty"),
        F.col("l_extendedprice").alias("price"), (F.col("l_tax") - 0.04).alias("fee"))
    return validate.trade_rejects(li).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
