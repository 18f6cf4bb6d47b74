"""Social-post activity and mood as features of the following bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.config import SOCIAL
from tapeflow.functions.numeric import zero_fill
from tapeflow.functions.rolling import roll_zscore
from tapeflow.functions.text import score_text
from tapeflow.plans.slices import over_slices


def _post_keys(posts: DataFrame) -> list[str]:
    return ["symbol"] if "symbol" in posts.columns else []


def daily_posts(
    posts: DataFrame, window: int = 30, lexicon: dict[str, float] | None = None
) -> DataFrame:
    """Posts per day, their mood, and how unusual the count is among days with posts.

    Posts with a ``symbol`` count for that symbol alone; without the column they are one series.
    """
    keys = _post_keys(posts)
    daily = (
        posts.withColumn("_s", score_text(F.col("text"), lexicon))
        .groupBy(*keys, F.to_date("ts").alias("d"))
        .agg(F.count("text").cast("double").alias("n"), F.avg("_s").alias("mood"))
    )
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("d")  # one row per calendar day
    z = zero_fill(roll_zscore(F.col("n"), w, window, need=5))
    return daily.select(*keys, "d", F.when(F.col("n") == 0, 0.0).otherwise(z).alias("z"), "mood")


def add_social(
    bars: DataFrame, posts: DataFrame | None, shift: int = 1, window: int = 30,
    lexicon: dict[str, float] | None = None, rows: int = 16384,
) -> DataFrame:
    """Three columns from the posts of the bar's day (and symbol), shown ``shift`` bars later. Needs ``rn``."""
    if posts is None:
        return bars.withColumns({c: F.lit(0.0) for c in SOCIAL})
    daily = daily_posts(posts, window, lexicon)
    joined = bars.withColumn("d", F.to_date("ts")).join(daily, [*_post_keys(posts), "d"], "left").drop("d")
    joined = joined.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("z", "mood")})

    def step(df, w):
        back = lambda c: F.coalesce(F.lag(c, shift).over(w), F.lit(0.0)) if shift else F.col(c)
        df = df.withColumns({"social_volume_z": back("z"), "social_sentiment_avg": back("mood")})
        mood = F.col("social_sentiment_avg")
        turn = F.coalesce(mood - F.lag("social_sentiment_avg").over(w), F.lit(0.0))
        return df.withColumn("social_polarity_shift", turn)

    return over_slices(joined, ["symbol"], [step], shift + 1, rows=rows).drop("z", "mood")
