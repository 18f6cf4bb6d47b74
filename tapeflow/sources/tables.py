"""Adapters from the given tables to the engine's own inputs.

The given tables hold ticks, orders and documents rather than finished bars or
books, so these functions derive the engine inputs from whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeflow.config import REFERENCE_NAMES
from tapeflow.sources.bars import ticks_to_bars
from tapeflow.sources.calendar import static_calendar
from tapeflow.sources.snapshots import assemble_books


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of five event streams: price = value, volume = number of ticks."""
    ticks = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        "ts",
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        F.lit(1.0).alias("size"),
    )
    return ticks_to_bars(ticks, "1 hour")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of five order priorities: price = total price, volume = number of orders."""
    ticks = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("symbol"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_totalprice").alias("price"),
        F.lit(1.0).alias("size"),
    )
    return ticks_to_bars(ticks, "1 day")


def brand_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of 25 brands: price = unit price of shipped lines, volume = quantity."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    lines = table(spark, sf_dir, "lineitem").join(
        part, F.col("l_partkey") == F.col("p_partkey")
    )
    ticks = lines.select(
        F.col("p_brand").alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        _line_number().alias("seq"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"),
    )
    return ticks_to_bars(ticks, "1 day")


def _line_id():
    return F.struct("l_orderkey", "l_linenumber", "l_partkey")


def _line_number():
    """A number that orders lines by ship day, order, line and part.

    Order and line alone repeat in the given table. A wide decimal stays a fixed-width
    value, so aggregates over it hash instead of sort.
    """
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date")).cast("decimal(6,0)")
    line = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("decimal(17,0)")
    wide = F.lit("1" + "0" * 27).cast("decimal(28,0)")
    return (
        day * wide + line * F.lit(10**10).cast("decimal(11,0)") + F.col("l_partkey").cast("decimal(10,0)")
    ).cast("decimal(38,0)")


def trades(spark: SparkSession, sf_dir: str, symbol: str | None = None) -> DataFrame:
    """A trade ledger: supplier as symbol, returned lines as sells, whole table or one symbol's rows."""
    side = F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY")
    signal = F.when(F.col("l_returnflag") == "A", "BUY").when(
        F.col("l_linestatus") == "O", "HOLD"
    )
    lines = table(spark, sf_dir, "lineitem")
    if symbol is not None:
        lines = lines.where(F.col("l_suppkey") == int(symbol.removeprefix("S")))
    return lines.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        _line_id().alias("seq"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
        side.alias("side"),
        F.col("l_quantity").alias("qty"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        (F.col("l_extendedprice") * F.col("l_tax") * F.lit(0.001)).alias("fee"),
        signal.alias("signal"),
    )


def book_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-book levels: a snapshot per nation and fortnight, open lines bid, closed lines ask."""
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    lines = table(spark, sf_dir, "lineitem").join(
        sup, F.col("l_suppkey") == F.col("s_suppkey")
    )
    return lines.select(
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("symbol"),
        F.window("l_shipdate", "14 days").start.alias("ts"),
        F.when(F.col("l_linestatus") == "O", "bid").otherwise("ask").alias("side"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"),
        _line_id().alias("seq"),
    )


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble_books(book_levels(spark, sf_dir))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News items: documents spread over the days of the event stream, title = first line."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        _day_of("doc_id", 37).alias("d"),
        F.regexp_extract("text", r"^([^\n]*)", 1).alias("title"),
        "text",
        F.when(F.pmod("doc_id", F.lit(3)) == 0, "newsapi").otherwise("rss").alias("source"),
    )


#: Two symbols of the hourly bars and one that has no bars there.
POST_SYMBOLS = ("click", "view", "BTC")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Social posts: conversation turns, a conversation per minute slot of January 2024."""
    at = F.make_timestamp_ntz(*[F.lit(v) for v in (2024, 1, 1, 0, 0, 0)]) + F.make_dt_interval(
        F.pmod(F.col("conv_id") * 13, F.lit(31)).cast("int"),
        F.pmod(F.col("conv_id"), F.lit(24)).cast("int"),
        F.col("turn").cast("int"),
    )
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        at.alias("ts"),
        "text",
        F.when(F.col("role") == "user", "reddit").otherwise("x").alias("source"),
        F.element_at(F.array(*[F.lit(s) for s in POST_SYMBOLS]), F.pmod("conv_id", F.lit(3)).cast("int") + 1).alias("symbol"),
        (F.length("text") + F.col("turn")).cast("long").alias("engagement"),
    )


def _day_of(col: str, step: int):
    return F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col(col) * step, F.lit(28)).cast("int"))


def reference_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven external daily series from orders, one per name, on the days that have orders."""
    names = F.array(*[F.lit(n) for n in REFERENCE_NAMES])
    orders = table(spark, sf_dir, "orders").select(
        F.element_at(names, (F.pmod("o_custkey", F.lit(7)) + 1).cast("int")).alias("name"),
        F.to_date("o_orderdate").alias("d"),
        F.col("o_totalprice").alias("v"),
    )
    scale = (
        F.when(F.col("name") == "fear_greed", F.avg("v") / 5000.0)
        .when(F.col("name") == "funding_rate", F.avg("v") / 2.5e7 - 0.01)
        .otherwise(F.avg("v") + 1.0e6)
    )
    return orders.groupBy("name", "d").agg(scale.alias("value"))


def nation_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty-day bars per nation, wide enough to hold several book snapshots."""
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    lines = table(spark, sf_dir, "lineitem").join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
    ticks = lines.select(
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        _line_number().alias("seq"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"),
    )
    return ticks_to_bars(ticks, "60 days")


def macro_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planned events, with outcomes on days that have orders: their smallest and largest total."""
    orders = table(spark, sf_dir, "orders")
    span = orders.agg(
        F.to_date(F.min("o_orderdate")).alias("first_day"),
        F.to_date(F.max("o_orderdate")).alias("last_day"),
    )
    outcomes = (
        orders.groupBy(F.to_date("o_orderdate").alias("date"))
        .agg(
            (F.min("o_totalprice") / 1e4).alias("forecast"),
            (F.max("o_totalprice") / 1e4).alias("actual"),
        )
    )
    return static_calendar(span).join(outcomes, "date", "left")


# --- side tables of the hourly bars: the same symbols, the same month ----------------------

def _in_january(day):
    """A day of any year to one of the bars' first 28 days."""
    return F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.datediff(day, F.lit("1970-01-01").cast("date")), F.lit(28)))


def january_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven external series on the days of the hourly bars."""
    levels = reference_levels(spark, sf_dir)
    return levels.groupBy("name", _in_january(F.col("d")).alias("d")).agg(F.avg("value").alias("value"))


def january_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned events of the bars' month, with outcomes from the orders dealt to each day."""
    orders = table(spark, sf_dir, "orders")
    span = table(spark, sf_dir, "events").agg(F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day"))
    outcomes = orders.groupBy(_in_january(F.to_date("o_orderdate")).alias("date")).agg(
        (F.avg("o_totalprice") / 1e4).alias("forecast"), (F.max("o_totalprice") / 1e4).alias("actual"))
    return static_calendar(span).join(outcomes, "date", "left")


def january_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books of the hourly symbols: order lines dealt to an hour of the month, open lines bid, closed lines ask."""
    symbols = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol")).distinct()
    turn = F.row_number().over(Window.orderBy("symbol")) - 1  # a handful of symbols
    own = symbols.withColumn("_s", turn)
    at = _in_january(F.to_date("l_shipdate")).cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.pmod("l_orderkey", F.lit(24)).cast("int"), F.lit(30))
    lines = table(spark, sf_dir, "lineitem").withColumn("_s", F.pmod("l_suppkey", F.lit(5)).cast("int"))
    levels = lines.join(own, "_s").select(
        "symbol", at.alias("ts"), F.when(F.col("l_linestatus") == "O", "bid").otherwise("ask").alias("side"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("size"), _line_id().alias("seq"))
    return assemble_books(levels)
