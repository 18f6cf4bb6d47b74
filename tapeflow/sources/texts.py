"""News and social-post landing: typing, cleaning, union and de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeflow.functions.times import epoch_millis, from_seconds

# Search term per base asset.
SEARCH_TERMS = {
    "BTC": "Bitcoin", "ETH": "Ethereum", "BNB": "Binance Coin", "SOL": "Solana",
    "XRP": "Ripple", "ADA": "Cardano", "DOGE": "Dogecoin", "AVAX": "Avalanche",
}


def search_term(symbol: Column) -> Column:
    """News search term of a symbol like BTC/USDT; unknown bases stay as they are."""
    base = F.split_part(symbol, F.lit("/"), F.lit(1))
    terms = F.create_map(*[F.lit(x) for kv in SEARCH_TERMS.items() for x in kv])
    return F.coalesce(F.try_element_at(terms, base), base)


def land_news(raw: DataFrame, max_chars: int | None = None) -> DataFrame:
    """News from (published, title, summary, source, seq); rows without a readable date drop out.

    ``max_chars`` cuts the stored text where a store asks for a fixed width; texts
    stay whole by default.
    """
    # The day is the wall-clock day as written, whatever zone the feed or the session has.
    stamp = F.col("published")
    mail = F.regexp_replace(F.regexp_replace(stamp, r"^[A-Za-z]{3}, *", ""), r" *([+-]\d{4}|[A-Z]{1,4})$", "")
    when = F.coalesce(
        stamp.try_cast("timestamp_ntz"),
        F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss")).cast("timestamp_ntz"),
    )
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("summary", F.lit("")))
    if max_chars:
        text = F.substring(text, 1, max_chars)
    return raw.select(
        F.to_date(when).alias("d"),
        F.coalesce("title", F.lit("")).alias("title"),
        text.alias("text"),
        "source",
        "seq",
    ).where(F.col("d").isNotNull())


def union_news(rss: DataFrame, api: DataFrame) -> DataFrame:
    """Both feeds without repeated titles; the RSS item wins, then the earliest.

    Equal titles meet in a min over a struct, which combines before the shuffle.
    """
    both = rss.withColumn("_rank", F.lit(0)).unionByName(api.withColumn("_rank", F.lit(1)))
    first = F.min(F.struct("_rank", "seq", "d", "text", "source")).alias("n")
    return both.groupBy("title").agg(first).select(
        F.col("n.d").alias("d"), "title", F.col("n.text").alias("text"),
        F.col("n.source").alias("source"), F.col("n.seq").alias("seq"),
    )


def _seconds(at: Column) -> Column:
    return epoch_millis(at.cast("timestamp_ntz")) / 1000


def land_posts(
    raw: DataFrame, since: Column, until: Column, max_chars: int | None = None
) -> DataFrame:
    """Posts inside a time range; engagement counts a missing score as 1 and comments as 0."""
    body = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("selftext", F.lit("")))
    if max_chars:
        body = F.substring(body, 1, max_chars)
    # Whole seconds are compared as they are stored, so that the bounds reach the scan.
    stored = F.col("created_utc").between(F.ceil(_seconds(since)).cast("long"), F.floor(_seconds(until)).cast("long"))
    return raw.where(stored).select(
        from_seconds(F.col("created_utc")).alias("ts"),
        body.alias("text"),
        "source",
        "symbol",
        (F.coalesce("score", F.lit(1)) + F.coalesce("num_comments", F.lit(0)))
        .cast("long")
        .alias("engagement"),
    )


def union_posts(feeds: list[DataFrame], sources: list[str] | None = None) -> DataFrame:
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f)
    return out.where(F.col("source").isin(sources)) if sources else out
