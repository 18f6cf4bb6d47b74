"""Parsing of delivered JSON payloads into daily series (name, symbol, d, value).

Input rows carry ``payload`` (one JSON document) and ``seq`` (delivery order). Bad
records are skipped; the latest delivery of a day wins. Keeping the latest is an
aggregate, so it combines before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeflow.functions.times import from_millis, from_seconds


def _daily(rows: DataFrame, name: str, symbol: Column | None = None) -> DataFrame:
    symbol = F.lit(None).cast("string") if symbol is None else symbol
    good = rows.where(F.col("d").isNotNull() & F.col("value").isNotNull())
    return (
        good.groupBy("d")
        .agg(F.max_by("value", F.struct("seq", "pos")).alias("value"))
        .select(F.lit(name).alias("name"), symbol.alias("symbol"), "d", "value")
    )


def _records(df: DataFrame, schema: str, path: str | None) -> DataFrame:
    parsed = F.from_json("payload", schema)
    rows = parsed.getField(path) if path else parsed
    return df.select("seq", F.posexplode(rows).alias("pos", "r"))


def _epoch_day(seconds: Column) -> Column:
    return F.to_date(from_seconds(seconds.try_cast("bigint")))


def parse_fear_greed(df: DataFrame) -> DataFrame:
    recs = _records(df, "data array<struct<timestamp:string,value:string>>", "data")
    return _daily(
        recs.select("seq", "pos", _epoch_day(F.col("r.timestamp")).alias("d"),
                    F.col("r.value").try_cast("double").alias("value")),
        "fear_greed",
    )


def parse_stable_supply(df: DataFrame) -> DataFrame:
    """The circulating amount is a number or an object holding ``peggedUSD``."""
    recs = _records(df, "array<struct<date:string,totalCirculatingUSD:string>>", None)
    usd = F.col("r.totalCirculatingUSD")
    amount = F.coalesce(
        F.get_json_object(usd, "$.peggedUSD").try_cast("double"), usd.try_cast("double")
    )
    return _daily(
        recs.select("seq", "pos", _epoch_day(F.col("r.date")).alias("d"), amount.alias("value")),
        "stable_dom_chg",
    )


def parse_derivatives(df: DataFrame, kind: str, symbol: str) -> DataFrame:
    """Funding rates, or open interest as value and otherwise as amount."""
    recs = _records(
        df,
        "array<struct<timestamp:bigint,fundingRate:double,openInterestValue:double,"
        "openInterestAmount:double>>",
        None,
    )
    if kind == "funding":
        name, value = "funding_rate", F.col("r.fundingRate")
    elif kind == "oi":
        stated = F.col("r.openInterestValue")
        name = "oi_chg"
        value = F.when(stated != 0, stated).otherwise(F.col("r.openInterestAmount"))
    else:
        raise ValueError(f"kind must be 'funding' or 'oi', got {kind!r}")
    day = F.to_date(from_millis(F.col("r.timestamp")))
    return _daily(recs.select("seq", "pos", day.alias("d"), value.alias("value")), name, F.lit(symbol))


def parse_observations(df: DataFrame, name: str) -> DataFrame:
    """Official statistics; a missing observation is written as a dot."""
    recs = _records(df, "observations array<struct<date:string,value:string>>", "observations")
    return _daily(
        recs.select("seq", "pos", F.col("r.date").try_cast("date").alias("d"),
                    F.col("r.value").try_cast("double").alias("value")),
        name,
    )


def parse_onchain(df: DataFrame, metric: str, symbol: str) -> DataFrame:
    recs = _records(df, f"data array<struct<time:string,`{metric}`:string>>", "data")
    return _daily(
        recs.select("seq", "pos", F.substring("r.time", 1, 10).try_cast("date").alias("d"),
                    F.col("r").getField(metric).try_cast("double").alias("value")),
        "onchain_z",
        F.lit(symbol),
    )
