"""News sentiment per day, merged to bars, and its relation to later returns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.config import NEWS
from tapeflow.functions.numeric import change, safe_corr, zero_fill
from tapeflow.functions.text import score_text
from tapeflow.plans.slices import number_rows, over_slices, time_bucket


def score_news(news: DataFrame, lexicon: dict[str, float] | None = None) -> DataFrame:
    return news.withColumn("sentiment", score_text(F.col("text"), lexicon))


def daily_sentiment(scored: DataFrame, shift: int = 1) -> DataFrame:
    """Mean, spread, count and day-to-day change, made visible ``shift`` days later.

    The change is taken between days that have news. With a shift the calendar is
    filled with zeros between first and last day, and values pushed past the last
    day fall off; the first ``shift`` days are NULL.
    """
    daily = scored.groupBy("d").agg(
        F.avg("sentiment").alias("sentiment_avg"),
        F.coalesce(F.stddev_samp("sentiment"), F.lit(0.0)).alias("sentiment_std"),
        F.count("sentiment").cast("double").alias("news_volume"),
    )
    w = Window.partitionBy(F.lit(0)).orderBy("d")  # one row per calendar day
    trend = F.col("sentiment_avg") - F.lag("sentiment_avg").over(w)
    daily = daily.withColumn("sentiment_trend", F.coalesce(trend, F.lit(0.0)))
    if shift <= 0:
        return daily
    span = daily.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    days = span.select("lo", "hi", F.explode(F.sequence("lo", "hi")).alias("d"))
    moved = daily.withColumn("d", F.date_add("d", shift))
    filled = days.join(moved, "d", "left")
    early = F.col("d") < F.date_add("lo", shift)
    return filled.select("d", *[F.when(~early, F.coalesce(c, F.lit(0.0))).alias(c) for c in NEWS])


def merge_news(bars: DataFrame, daily: DataFrame, fill: bool = True) -> DataFrame:
    """Left join by day; bars outside the news span get zeros."""
    out = bars.withColumn("d", F.to_date("ts")).join(daily, "d", "left").drop("d")
    return out.withColumns({c: zero_fill(F.col(c)) for c in NEWS}) if fill else out


def coverage(bars: DataFrame) -> DataFrame:
    """Share of bars with news; below 0.3 a model should not lean on it."""
    share = F.avg((F.col("news_volume") > 0).cast("double"))
    return bars.groupBy("symbol").agg(share.alias("coverage")).withColumn(
        "low_coverage", F.col("coverage") < 0.3
    )


def _forward(bars: DataFrame, horizons: Sequence[int], rows: int = 16384) -> DataFrame:
    def step(df, w):
        return df.withColumns(
            {f"fwd_{h}": change(F.lead("close", h).over(w), F.col("close")) for h in horizons}
        )

    return over_slices(bars, ["symbol"], [step], 0, max(horizons), rows)


def sentiment_price_corr(bars: DataFrame, horizons: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """Correlation of sentiment with later returns, and of volume with their size."""
    fwd = _forward(bars, horizons)
    aggs = []
    for h in horizons:
        x = F.col(f"fwd_{h}")
        aggs += [
            safe_corr(F.col("sentiment_avg"), x).alias(f"r{h}"),
            safe_corr(F.col("news_volume"), F.abs(x)).alias(f"v{h}"),
        ]
    wide = fwd.groupBy("symbol").agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(h).alias("horizon"),
                zero_fill(F.col(f"r{h}")).alias("sent_vs_return"),
                zero_fill(F.col(f"v{h}")).alias("volume_vs_volatility"),
            )
            for h in horizons
        ]
    )
    return wide.select("symbol", F.inline(rows))


def news_days_forward(bars: DataFrame, h: int = 5) -> DataFrame:
    """Only bars with news, and the return h such bars later."""
    d = bars.where(F.col("news_volume") > 0).drop("rn")
    d = number_rows(d, ["symbol"], ["ts"], time_bucket(F.col("ts"), 365.0))
    return _forward(d, [h]).withColumnRenamed(f"fwd_{h}", "fwd_5d" if h == 5 else f"fwd_{h}d")


def top_sentiment_days(bars: DataFrame, n: int = 10, kind: str = "pos") -> DataFrame:
    """The n strongest news bars per symbol; equal scores go to the earlier bar."""
    s = F.col("sentiment_avg")
    w = Window.partitionBy("symbol").orderBy(s.asc() if kind == "neg" else s.desc(), "ts")
    d = news_days_forward(bars).withColumn("rank", F.row_number().over(w))
    return d.where(F.col("rank") <= n).select(
        "symbol", "ts", "rank", "sentiment_avg", "news_volume", "close", "fwd_5d"
    )


def sentiment_buckets(bars: DataFrame) -> DataFrame:
    """Later return by sentiment bucket; buckets are closed on the right."""
    s = F.col("sentiment_avg")
    bucket = (
        F.when((s > -1.01) & (s <= -0.3), "very_neg")
        .when((s > -0.3) & (s <= -0.05), "neg")
        .when((s > -0.05) & (s <= 0.05), "neutral")
        .when((s > 0.05) & (s <= 0.3), "pos")
        .when((s > 0.3) & (s <= 1.01), "very_pos")
    )
    fwd = F.col("fwd_5d")
    won = F.coalesce((fwd > 0).cast("double"), F.lit(0.0))
    return (
        news_days_forward(bars)
        .withColumn("bucket", bucket)
        .where(F.col("bucket").isNotNull())
        .groupBy("symbol", "bucket")
        .agg(
            F.avg(fwd).alias("avg_fwd_5d"),
            F.avg(won).alias("win_rate"),
            F.count(fwd).alias("n"),
        )
    )
