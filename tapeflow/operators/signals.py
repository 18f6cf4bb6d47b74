"""Predictions to signals, votes and their filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.functions.numeric import div

# Thresholds where volatility is unknown, and how confidence is scaled.
BUY_FROM, SELL_FROM, ATR_SHARE = 0.02, -0.02, 0.1
SCALE, CAP = 50.0, 99.0
# Ties in a vote go to the earlier of these.
VOTE_ORDER = ("BUY", "SELL", "HOLD")


def dynamic_thresholds(
    atr_pct: Column, buy: float = BUY_FROM, sell: float = SELL_FROM, share: float = ATR_SHARE
) -> tuple[Column, Column]:
    """Buy and sell thresholds that scale with volatility, fixed where it is unknown."""
    ok = atr_pct.isNotNull() & ~F.isnan(atr_pct) & (atr_pct > 0)
    th = F.lit(share) * atr_pct
    return (
        F.when(ok, th).otherwise(F.lit(buy)),
        F.when(ok, -th).otherwise(F.lit(sell)),
    )


def add_signal(
    df: DataFrame, pred: str = "pred", buy: str = "buy_th", sell: str = "sell_th",
    scale: float = SCALE, cap: float = CAP,
) -> DataFrame:
    """BUY, SELL or HOLD with a confidence that grows with distance from the threshold."""
    p, b, s = F.col(pred), F.col(buy), F.col(sell)
    eps = F.lit(1e-9)
    beyond = lambda gap, th: F.least(gap / F.greatest(F.abs(th), eps) * scale, F.lit(cap))
    near = F.when(p < 0, F.abs(s)).otherwise(b)
    hold = F.greatest(F.lit(0.0), (1.0 - F.abs(p) / F.greatest(F.abs(near), eps)) * scale)
    return df.withColumns(
        {
            "signal": F.when(p > b, "BUY").when(p < s, "SELL").otherwise("HOLD"),
            "confidence": F.when(p > b, beyond(p - b, b))
            .when(p < s, beyond(F.abs(p - s), s))
            .otherwise(hold),
        }
    )


def add_class_signal(
    df: DataFrame, proba: str = "proba", min_proba: float = 0.5
) -> DataFrame:
    """Most probable of [SELL, HOLD, BUY]; a weak BUY or SELL becomes HOLD."""
    top = F.array_max(proba)
    code = F.array_position(F.col(proba), top) - 1
    name = F.element_at(F.array(F.lit("SELL"), F.lit("HOLD"), F.lit("BUY")), (code + 1).cast("int"))
    return df.withColumns(
        {
            "pred_class": code.cast("int"),
            "class_signal": F.when((code != 1) & (top < min_proba), "HOLD").otherwise(name),
            "class_confidence": top * 100.0,
        }
    )


def last_signals(preds: DataFrame, keys: Sequence[str] = ("symbol", "model")) -> DataFrame:
    """Signal at the newest bar per symbol and model; a max over a struct, combined map-side."""
    last = preds.groupBy(*keys).agg(
        F.max_by(F.struct("ts", "close", "pred", "atr_pct"), "ts").alias("l")
    ).select(*keys, "l.*")
    buy, sell = dynamic_thresholds(F.col("atr_pct"))
    return add_signal(last.withColumns({"buy_th": buy, "sell_th": sell}))


def _vote(df: DataFrame, weight: Column, keys: Sequence[str]) -> list[Column]:
    share = {s: F.sum(F.when(F.col("signal") == s, weight).otherwise(0.0)) for s in VOTE_ORDER}
    best = F.greatest(*share.values())
    pick = F.when(share["BUY"] == best, "BUY").when(share["SELL"] == best, "SELL").otherwise("HOLD")
    votes = [c.alias(f"votes_{s.lower()}") for s, c in share.items()]
    return [pick.alias("consensus"), *votes]


def majority_vote(signals: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return signals.groupBy(*keys).agg(
        *_vote(signals, F.lit(1.0), keys),
        F.avg("confidence").alias("avg_confidence"),
        F.avg("pred").alias("avg_predicted_return"),
    )


def validation_weights(
    scores: DataFrame, metric: str = "val_r2", keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Model weights from validation scores, equal when none is positive.

    ``scores`` holds one row per (key, model), so a window covers the models of a key.
    """
    if metric == "val_r2":
        raw = F.greatest(F.coalesce("val_r2", F.lit(0.0)), F.lit(0.0))
    elif metric == "val_rmse":
        raw = F.when(F.col("val_rmse") > 0, div(F.lit(1.0), F.col("val_rmse"))).otherwise(0.0)
    else:
        raise ValueError(f"metric must be 'val_r2' or 'val_rmse', got {metric!r}")
    w = Window.partitionBy(*keys)
    total, n = F.sum("_raw").over(w), F.count(F.lit(1)).over(w)
    weight = F.when(total <= 0, 1.0 / n).otherwise(div(F.col("_raw"), total))
    return scores.withColumn("_raw", raw).withColumn("weight", weight).drop("_raw")


def weighted_vote(
    signals: DataFrame, weights: DataFrame, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    joined = signals.join(weights.select(*keys, "model", "weight"), [*keys, "model"])
    w = F.col("weight")
    return joined.groupBy(*keys).agg(
        *_vote(joined, w, keys),
        F.sum(F.col("confidence") * w).alias("avg_confidence"),
        F.sum(F.col("pred") * w).alias("avg_predicted_return"),
    )


def meta_filter(
    votes: DataFrame, prob_correct: str = "prob_correct", threshold: float = 0.5
) -> DataFrame:
    """Turn a directional consensus into HOLD where it is unlikely to be right."""
    weak = (F.col(prob_correct) < threshold) & F.col("consensus").isin("BUY", "SELL")
    return votes.withColumns(
        {
            "meta_confidence": F.round(F.col(prob_correct) * 100.0, 1),
            "consensus": F.when(weak, "HOLD").otherwise(F.col("consensus")),
        }
    )


def meta_labels(preds: DataFrame, keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """1 where the mean prediction points the way the target went."""
    per_bar = preds.groupBy(*keys).agg(F.avg("pred").alias("pred"), F.max("target").alias("target"))
    hit = (F.signum("pred") == F.signum("target")).cast("int")
    return per_bar.where(F.col("target").isNotNull()).withColumn("meta_label", hit)
