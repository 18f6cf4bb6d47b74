"""Model and path metrics as grouped moments: partial sums travel, rows do not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeflow.config import BUY, HOLD, SELL
from tapeflow.functions.numeric import div


def _r2(p: Column, y: Column) -> Column:
    """1 - SSres/SStot; NULL when the target is constant."""
    return 1.0 - div(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y))


def _dir_acc(p: Column, y: Column) -> Column:
    """Share of matching signs where neither side is zero; 0 when there is none."""
    moved = (p != 0) & (y != 0)
    hit = F.when(moved, (F.signum(p) == F.signum(y)).cast("double"))
    return F.coalesce(F.avg(hit), F.lit(0.0))


def regression_metrics(
    df: DataFrame, keys: Sequence[str], pred: str = "pred", target: str = "target"
) -> DataFrame:
    p, y = F.col(pred), F.col(target)
    rows = df.where(p.isNotNull() & y.isNotNull())
    err = p - y
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(err * err).alias("mse"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        _r2(p, y).alias("r2"),
        _dir_acc(p, y).alias("dir_acc"),
    )


def path_metrics(
    df: DataFrame, keys: Sequence[str], pred: str = "pred", target: str = "target"
) -> DataFrame:
    """Direction accuracy, R2 and the yearly Sharpe of following the sign."""
    p, y = F.col(pred), F.col(target)
    pnl = F.signum(p) * y
    sharpe = div(F.avg(pnl), F.stddev_samp(pnl)) * F.lit(365.0**0.5)
    return df.where(p.isNotNull() & y.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        _dir_acc(p, y).alias("dir_acc"),
        F.coalesce(sharpe, F.lit(0.0)).alias("sharpe"),
        F.coalesce(_r2(p, y), F.lit(0.0)).alias("r2"),
    )


def path_summary(paths: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    def share(cond):
        return F.avg(cond.cast("double")) * 100.0

    return paths.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_paths"),
        F.avg("dir_acc").alias("mean_dir_acc"),
        F.coalesce(F.stddev_samp("dir_acc"), F.lit(0.0)).alias("std_dir_acc"),
        F.min("dir_acc").alias("min_dir_acc"),
        F.max("dir_acc").alias("max_dir_acc"),
        share(F.col("dir_acc") > 0.5).alias("pct_dir_above_50"),
        F.avg("sharpe").alias("mean_sharpe"),
        F.coalesce(F.stddev_samp("sharpe"), F.lit(0.0)).alias("std_sharpe"),
        share(F.col("sharpe") > 0).alias("pct_sharpe_positive"),
        F.avg("r2").alias("mean_r2"),
    )


def fold_summary(folds: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Walk-forward summary over per-fold regression metrics."""
    return folds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.avg("r2").alias("mean_r2"),
        F.stddev_samp("r2").alias("std_r2"),
        F.avg("dir_acc").alias("mean_dir_acc"),
        F.stddev_samp("dir_acc").alias("std_dir_acc"),
        (F.avg((F.col("r2") > 0).cast("double")) * 100.0).alias("pct_r2_positive"),
        (F.avg((F.col("dir_acc") > 0.5).cast("double")) * 100.0).alias("pct_dir_above_50"),
    )


def hit_rate(
    df: DataFrame, keys: Sequence[str], pred: str = "pred_class", fwd: str = "fwd"
) -> DataFrame:
    """How often BUY and SELL calls went their way; NULL without any call."""
    c, f = F.col(pred), F.col(fwd)
    call = c.isin(BUY, SELL)
    hit = ((c == BUY) & (f > 0)) | ((c == SELL) & (f < 0))
    n = F.count_if(call)
    return df.groupBy(*keys).agg(
        n.alias("n_signals"),
        div(F.count_if(call & F.coalesce(hit, F.lit(False))), n).alias("hit_rate"),
    )


def class_metrics(
    df: DataFrame, keys: Sequence[str], pred: str = "pred_class", label: str = "label"
) -> DataFrame:
    """Accuracy, balanced accuracy, macro F1 and precisions from confusion counts."""
    codes = (SELL, HOLD, BUY)
    p, y = F.col(pred), F.col(label)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in codes:
        aggs += [
            F.count_if((p == c) & (y == c)).alias(f"_tp{c}"),
            F.count_if(p == c).alias(f"_pp{c}"),
            F.count_if(y == c).alias(f"_yy{c}"),
        ]
    g = df.where(y.isNotNull() & p.isNotNull()).groupBy(*keys).agg(*aggs)
    tp, pp, yy = ({c: F.col(f"_{x}{c}") for c in codes} for x in ("tp", "pp", "yy"))
    zero = F.lit(0.0)
    f1 = sum((F.coalesce(div(2.0 * tp[c], pp[c] + yy[c]), zero) for c in codes), zero) / 3.0
    seen = sum(((yy[c] > 0).cast("int") for c in codes), F.lit(0))
    recall = sum((F.coalesce(div(tp[c], yy[c]), zero) for c in codes), zero)
    return g.select(
        *keys,
        F.col("_n").alias("n"),
        div(sum(tp.values(), zero), F.col("_n")).alias("accuracy"),
        div(recall, seen).alias("balanced_accuracy"),
        f1.alias("f1_macro"),
        F.coalesce(div(tp[BUY], pp[BUY]), zero).alias("precision_buy"),
        F.coalesce(div(tp[SELL], pp[SELL]), zero).alias("precision_sell"),
        pp[BUY].alias("n_buy_pred"),
        pp[SELL].alias("n_sell_pred"),
        pp[HOLD].alias("n_hold_pred"),
    )


def classification_summary(folds: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Walk-forward summary; windows without a call do not count towards the hit rate."""
    above = F.avg((F.col("hit_rate") > 0.5).cast("double")) * 100.0
    return folds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.avg("accuracy").alias("mean_accuracy"),
        F.avg("f1_macro").alias("mean_f1"),
        F.avg("hit_rate").alias("mean_hit_rate"),
        F.stddev_samp("hit_rate").alias("std_hit_rate"),
        F.coalesce(above, F.lit(0.0)).alias("pct_windows_above_50"),
        F.sum("n_signals").alias("total_signals"),
    )


def naive_zero_r2(df: DataFrame, keys: Sequence[str], target: str = "target") -> DataFrame:
    """R2 of always predicting zero."""
    y = F.col(target)
    rows = df.where(y.isNotNull())
    return rows.groupBy(*keys).agg(
        (1.0 - div(F.sum(y * y), F.var_pop(y) * F.count(y))).alias("naive_r2")
    )


# --- comparison tables over model results (a row per combo, model, symbol) ---------------


def compare_models(scores: DataFrame, parts=("train", "val", "test")) -> DataFrame:
    """One row per symbol and model, R2 and RMSE of every part side by side."""
    return (
        scores.groupBy("symbol", "model")
        .pivot("segment", list(parts))
        .agg(F.first("r2").alias("r2"), F.first("rmse").alias("rmse"))
    )


def combo_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("combo", "model").agg(
        F.avg("test_r2").alias("mean_test_r2"), F.max("n_features").alias("n_features")
    )


def incremental_value(results: DataFrame, order: Sequence[str]) -> DataFrame:
    """Change in mean test R2 from each combination to the next, over shared symbols."""
    rank = F.create_map(*[F.lit(x) for i, c in enumerate(order) for x in (c, i)])
    at = results.withColumn("_i", F.try_element_at(rank, F.col("combo")))
    before = at.select(
        F.col("combo").alias("from_combo"), (F.col("_i") + 1).alias("_i"), "model", "symbol",
        F.col("test_r2").alias("_b"),
    )
    after = at.select(F.col("combo").alias("to_combo"), "_i", "model", "symbol",
                      F.col("test_r2").alias("_a"))
    joined = before.join(after, ["_i", "model", "symbol"])
    both = joined.where(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return both.groupBy("from_combo", "to_combo", "model").agg(
        (F.avg("_a") - F.avg("_b")).alias("delta_r2")
    )


def best_per_symbol(results: DataFrame) -> DataFrame:
    top = F.max_by(F.struct("combo", "model", "test_r2", "train_r2"),
                   F.struct("test_r2", "combo", "model"))
    rows = results.where(F.col("test_r2").isNotNull())
    return rows.groupBy("symbol").agg(top.alias("b")).select("symbol", "b.*")


def full_detail(results: DataFrame, combo: str, models: Sequence[str]) -> DataFrame:
    """Test R2 of one combination, a column per model, and the best model's name."""
    wide = (
        results.where(F.col("combo") == combo)
        .groupBy("symbol")
        .pivot("model", list(models))
        .agg(F.first("test_r2"))
    )
    top = F.greatest(*[F.col(m) for m in models])
    best = F.coalesce(*[F.when(F.col(m) == top, F.lit(m)) for m in models])
    return wide.withColumn("best_model", best)


def ablation_table(
    folds: DataFrame, keys: Sequence[str] = ("symbol",), spread_over: Sequence[str] | None = None
) -> DataFrame:
    """Classification summary per feature variant, with the spread across variants."""
    from pyspark.sql import Window

    table = classification_summary(folds, [*keys, "variant"])
    w = Window.partitionBy(*(spread_over or keys))
    spread = F.max("mean_hit_rate").over(w) - F.min("mean_hit_rate").over(w)
    return table.withColumn("spread", spread)
