"""Expected value of signals, per configuration and on a sealed holdout."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeflow.config import BUY, SELL
from tapeflow.functions.numeric import div
from tapeflow.functions.stats import binomial_p, deflate, expected_value

# The published search grid.
PROFIT_TARGETS = (1.0, 1.5, 2.0, 2.5)
STOPS = (0.75, 1.0, 1.5)
HORIZONS = (3, 5, 10)
MIN_PROBAS = (0.50, 0.55, 0.60, 0.65)


def label_grid() -> list[tuple[float, float, int]]:
    """The (pt, sl, h) variants that need their own labels; the threshold is a filter."""
    return list(product(PROFIT_TARGETS, STOPS, HORIZONS))


def _trades(preds: DataFrame, min_proba: Column, cost: float) -> DataFrame:
    c, f = F.col("pred_class"), F.col("fwd")
    won = ((c == BUY) & (f > 0)) | ((c == SELL) & (f < 0))
    kept = preds.where(c.isin(BUY, SELL) & (F.col("max_proba") >= min_proba) & f.isNotNull())
    sign = F.when(won, 1.0).otherwise(-1.0)
    return kept.withColumns({"won": won, "ret": F.abs(f) * sign - F.lit(cost)})


def _stats(trades: DataFrame, keys: Sequence[str], cost: float) -> DataFrame:
    size = F.abs("fwd")
    g = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.count_if("won").alias("wins"),
        F.coalesce(F.avg(F.when(F.col("won"), size)), F.lit(0.0)).alias("avg_gain"),
        F.coalesce(F.avg(F.when(~F.col("won"), size)), F.lit(0.0)).alias("avg_loss"),
        F.avg("ret").alias("mean_ev"),
        F.coalesce(div(F.avg("ret"), F.stddev_samp("ret")), F.lit(0.0)).alias("sharpe"),
    )
    rate = div(F.col("wins"), F.col("n_trades"))
    return g.withColumns(
        {
            "win_rate": rate,
            "ev": expected_value(rate, F.col("avg_gain"), F.col("avg_loss"), cost),
        }
    )


def signal_ev(
    preds: DataFrame, keys: Sequence[str], min_proba: float = 0.5, cost: float = 0.0
) -> DataFrame:
    """EV of confident BUY and SELL calls: preds(pred_class, max_proba, fwd)."""
    return _stats(_trades(preds, F.lit(min_proba), cost), keys, cost)


# --- the grid from additive tables ---------------------------------------------------------
#
# Rows are read once into counts per block of rows. Train windows, thresholds and the refit on all
# of trainval are sums of these counts, so nothing grows with the number of folds.

Variant = tuple[float, float, int]
VARIANT = ["pt", "sl", "h"]


def _edge(share: float) -> Column:
    """Rows whose label lies inside the first ``share`` of the bars."""
    return F.floor(F.col("n") * F.lit(share)) - F.col("h")


def label_counts(rows: DataFrame, variants: Sequence[Variant], block: int, share: float = 0.8) -> DataFrame:
    """How often each state meets each label, per variant and block of ``block`` rows of trainval.

    ``rows``: symbol, rn, n, cell (market state), labels (an array in the order of ``variants``). ``purged`` marks
    counts of rows so near a block's end that their label reaches past it.
    """
    picks = F.array(*[
        F.struct(F.lit(pt).alias("pt"), F.lit(sl).alias("sl"), F.lit(h).alias("h"), F.col("labels")[i].alias("label"))
        for i, (pt, sl, h) in enumerate(variants)])
    long = rows.select("symbol", "n", "rn", "cell", F.inline(picks)).where(F.col("rn") < _edge(share))
    return long.groupBy(
        "symbol", "n", *VARIANT, "cell", "label", F.floor(F.col("rn") / block).alias("block"),
        (F.col("rn") % block >= block - F.col("h")).alias("purged"),
    ).agg(F.count(F.lit(1)).alias("k"))


def fold_counts(counts: DataFrame, block: int, train: int, test: int, share: float = 0.8) -> DataFrame:
    """The same counts per walk-forward fold: sums of whole blocks, the last one without its purged rows.

    Folds step by their test length, which the block length must divide, as it must the train length.
    """
    if train % block or test % block:
        raise ValueError("blocks must divide the train and the test length")
    start = F.col("block") * block
    top = F.floor((_edge(share) - (train + test)) / test)
    lo = F.greatest(F.ceil((start + block - train) / test), F.lit(0)).cast("long")
    hi = F.least(F.floor(start / test), top).cast("long")
    folds = F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
    spread = counts.withColumn("fold_id", F.explode(folds))
    last = start + block == F.col("fold_id") * test + train
    return spread.where(~(last & F.col("purged"))).groupBy("symbol", *VARIANT, "fold_id", "cell", "label").agg(F.sum("k").alias("k"))


def state_model(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The commonest label of each state and its share; of equally common ones the lower code."""
    per = counts.groupBy(*keys, "cell", "label").agg(F.sum("k").alias("k"))
    return per.groupBy(*keys, "cell").agg(
        F.max_by("label", F.struct("k", -F.col("label"))).cast("int").alias("pred_class"),
        (F.max("k") / F.sum("k")).alias("max_proba"))


def outcome_sums(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Numbers, sizes and squares of rising and falling outcomes ``fwd`` per key: all that EV statistics need."""
    f = F.col("fwd")
    part = lambda c: F.coalesce(F.sum(F.when(c, F.abs(f))), F.lit(0.0))
    return long.where(f.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(f > 0).alias("n_up"), F.count_if(f < 0).alias("n_down"),
        part(f > 0).alias("up"), part(f < 0).alias("down"), F.sum(f * f).alias("squares"))


def by_horizon(rows: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Narrow rows per horizon: symbol, n, rn, cell, h, fwd, from columns ``fwd3``, ``fwd5`` and so on."""
    picks = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"fwd{h}").alias("fwd")) for h in horizons])
    return rows.select("symbol", "n", "rn", "cell", F.inline(picks))


def fold_outcomes(rows: DataFrame, train: int, test: int, share: float = 0.8, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Outcome sums of every fold's test block per horizon and state."""
    long = by_horizon(rows, horizons).withColumn("fold_id", F.floor((F.col("rn") - train) / test))
    top = F.floor((_edge(share) - (train + test)) / test)
    inside = (F.col("fold_id") >= 0) & (F.col("fold_id") <= top) & (F.col("rn") < _edge(share))
    return outcome_sums(long.where(inside), ["symbol", "h", "fold_id", "cell"])


def stats_of_sums(called: DataFrame, keys: Sequence[str], cost: float) -> DataFrame:
    """EV statistics of BUY and SELL calls from outcome sums with the call (``pred_class``) made on each."""
    buy = F.col("pred_class") == BUY
    side = lambda a, b: F.when(buy, F.col(a)).otherwise(F.col(b))
    own = called.where(F.col("pred_class").isin(BUY, SELL) & (F.col("n") > 0)).select(
        *keys, "n", "squares", side("n_up", "n_down").alias("won"), side("up", "down").alias("gain"), side("down", "up").alias("loss"))
    g = own.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "won", "gain", "loss", "squares")])
    n, c = F.col("n"), F.lit(cost)
    total = F.col("gain") - F.col("loss")
    mean = total / n - c
    # Squares around the mean; what rounding leaves of equal returns counts as none.
    spread = F.col("squares") - total * total / n
    spread = F.when(spread > F.col("squares") * 1e-14, spread).otherwise(0.0)
    sd = F.when(n > 1, F.sqrt(spread / (n - 1)))
    rate = div(F.col("won"), n)
    average = lambda a, k: F.coalesce(div(F.col(a), k), F.lit(0.0))
    return g.select(
        *keys, n.alias("n_trades"), F.col("won").alias("wins"), average("gain", F.col("won")).alias("avg_gain"),
        average("loss", n - F.col("won")).alias("avg_loss"), mean.alias("mean_ev"),
        F.coalesce(div(mean, sd), F.lit(0.0)).alias("sharpe"), rate.alias("win_rate"),
    ).withColumn("ev", expected_value(F.col("win_rate"), F.col("avg_gain"), F.col("avg_loss"), cost))


def grid_ev(
    counts: DataFrame, outcomes: DataFrame, block: int, train: int, test: int,
    min_probas: Sequence[float] = MIN_PROBAS, cost: float = 0.0, share: float = 0.8,
) -> DataFrame:
    """EV per (symbol, variant, min_proba) over all folds, from ``label_counts`` and ``fold_outcomes``."""
    keys = ["symbol", *VARIANT, "fold_id"]
    model = state_model(fold_counts(counts, block, train, test, share), keys)
    called = model.join(outcomes, ["symbol", "h", "fold_id", "cell"])
    passed = F.filter(F.array(*[F.lit(float(m)) for m in min_probas]), lambda m: m <= F.col("max_proba"))
    return stats_of_sums(called.withColumn("min_proba", F.explode(passed)), ["symbol", *VARIANT, "min_proba"], cost)


def holdout_ev(
    rows: DataFrame, counts: DataFrame, best: DataFrame, cost: float = 0.0, share: float = 0.8,
    horizons: Sequence[int] = HORIZONS,
) -> DataFrame:
    """EV of each symbol's best configuration, refitted on all of trainval, on the rows behind it."""
    long = by_horizon(rows, horizons)
    held = long.where((F.col("rn") >= F.floor(F.col("n") * F.lit(share))) & (F.col("rn") < F.col("n") - F.col("h")))
    model = state_model(counts, ["symbol", *VARIANT]).join(best, ["symbol", *VARIANT])
    called = model.where(F.col("max_proba") >= F.col("min_proba")).join(
        outcome_sums(held, ["symbol", "h", "cell"]), ["symbol", "h", "cell"])
    return stats_of_sums(called, ["symbol"], cost)


def all_trials(grid: DataFrame, symbols: DataFrame, variants: Sequence[Variant], min_probas: Sequence[float] = MIN_PROBAS) -> DataFrame:
    """Every configuration of the search per symbol, with its score if it traded: (symbol, pt, sl, h, min_proba, mean_ev)."""
    listed = F.array(*[
        F.struct(F.lit(pt).alias("pt"), F.lit(sl).alias("sl"), F.lit(h).alias("h"), F.lit(float(m)).alias("min_proba"))
        for pt, sl, h in variants for m in min_probas])
    every = symbols.select("symbol", F.inline(listed))
    return every.join(grid.select("symbol", *VARIANT, "min_proba", "mean_ev"), ["symbol", *VARIANT, "min_proba"], "left")


def best_config(grid: DataFrame, params: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Highest mean EV with at least one trade; equal scores go to the first in grid order."""
    order = F.struct(F.col("mean_ev"), *[(-F.col(p)).alias(f"_{p}") for p in params])
    top = F.max_by(F.struct(*params, "mean_ev"), order)
    return (
        grid.where(F.col("n_trades") > 0)
        .groupBy(*keys)
        .agg(top.alias("b"))
        .select(*keys, "b.*")
    )


def judge_holdout(stats: DataFrame, trials: Column) -> DataFrame:
    """Raw and trial-corrected p-value of the holdout trades, and the verdict."""
    raw = binomial_p(F.col("wins"), F.col("n_trades"))
    out = stats.withColumn("raw_p", raw).withColumn("deflated_p", deflate(F.col("raw_p"), trials))
    significant = F.col("deflated_p") < 0.05
    return out.withColumns(
        {"significant": significant, "positive_ev": significant & (F.col("ev") > 0)}
    )


def trial_log(trials: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Number of trials and the best one; the first of equal scores wins, a trial without a score never."""
    scored = F.when(F.col("score").isNotNull(), F.struct("score", -F.col("trial_id")))
    best = F.max_by(F.struct("trial_id", "score"), scored)
    return trials.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trials"), best.alias("b")
    ).select(*keys, "n_trials", F.col("b.trial_id").alias("best_trial"), F.col("b.score").alias("best_score"))
