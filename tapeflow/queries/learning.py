"""Model-fitting and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeflow.config import FeatureSpec
from tapeflow.operators import fold_models, metrics, models, signals, splits
from tapeflow.plans.features import engineer
from tapeflow.plans.slices import number_rows, time_bucket
from tapeflow.plans.tables import keep
from tapeflow.queries.context import BOOKS, _step_sql
from tapeflow.queries.registry import HOURLY, ORD, hourly, query, r, rs, show
from tapeflow.queries.strategy import BASE, base
from tapeflow.sources import tables
from tapeflow.sources.store import scratch_folder
from tapeflow.streaming import backfill
from tapeflow.streaming import bars as bar_stream
from tapeflow.streaming import books as book_stream

FEATURES = ["ret_1d", "ret_5d", "vwap_dist", "hl_range"]
SPEC = FeatureSpec(micro=True)
WIDE = SPEC.columns()
#: Every family that a symbol's own bars give.
FULL = FeatureSpec(micro=True, smooth=True)
EVERY = FULL.columns()


def rows(spark, sf):
    """Complete rows, renumbered, as the fits see them."""
    full = base(spark, sf).na.drop(subset=[*FEATURES, "target", "atr_pct"]).drop("rn", "n")
    full = keep(full.select("symbol", "ts", "close", "atr_pct", *FEATURES, "target"))
    return number_rows(full, ["symbol"], ["ts"], time_bucket(F.col("ts"), 365.0), total="n")


CLEAN = f"""{BASE}, clean AS (SELECT symbol, ts, ret_1d, ret_5d, vwap_dist, rg, target, row_number() OVER {ORD} - 1 AS rn,
    count(*) OVER (PARTITION BY symbol) AS n FROM base WHERE ret_1d IS NOT NULL AND ret_5d IS NOT NULL AND vwap_dist IS NOT NULL
    AND rg IS NOT NULL AND target IS NOT NULL AND atr_pct IS NOT NULL),
  wf AS (SELECT DISTINCT symbol, f AS fold_id FROM (SELECT DISTINCT symbol, n FROM clean), LATERAL (SELECT unnest(generate_series(0, (n - 360) // 60)) AS f))"""


def _fold_sums(spark, sf):
    return models.fold_moments(rows(spark, sf), ["symbol"], FEATURES, "target", 300, 60, None, 5)


@query("fold_moments", f"""WITH {CLEAN} SELECT c.symbol, fold_id, count(*) AS n_train, {rs(
    mean_y='avg(target)', mean_x='avg(vwap_dist)', xy='avg(vwap_dist * target)', xx='avg(vwap_dist * ret_5d)')}
  FROM clean c JOIN wf ON wf.symbol = c.symbol AND rn >= fold_id * 60 AND rn < fold_id * 60 + 295 GROUP BY 1, 2""")
def fold_moments(spark, sf):
    """Variables are numbered: 0 is one, 1..4 the features, 5 the target."""
    s, n = _fold_sums(spark, sf), F.col("m0_0")
    s = s.withColumns({"n_train": n.cast("long"), "mean_y": F.col("m0_5") / n, "mean_x": F.col("m0_3") / n,
                       "xy": F.col("m3_5") / n, "xx": F.col("m2_3") / n})
    return show(s, "mean_y", "mean_x", "xy", "xx", keys=("symbol", "fold_id", "n_train"))


def matrix_of(bars):
    """The feature table of numbered bars with all bar families, numbered, with the fixed label."""
    full = engineer(bars, FULL).select("symbol", "ts", "close", *EVERY, "target")
    full = number_rows(keep(full), ["symbol"], ["ts"], time_bucket(F.col("ts"), 365.0), total="n")
    band, y = 0.5 * F.col("atr_pct"), F.col("target")
    return keep(full.withColumn("label", F.when(y > band, 2).when(y < -band, 0).otherwise(1)))


def _matrix(spark, sf):
    return matrix_of(hourly(spark, sf))


def _folds(d):
    return splits.add_folds(d, 300, 60, None, 5)


def _wide_sums(d):
    return models.fold_moments(d, ["symbol"], EVERY, "target", 300, 60, None, 5)


@query("ridge_fits")
def ridge_fits(spark, sf):
    fit = models.fit_ridge(_wide_sums(_matrix(spark, sf)), ["symbol", "fold_id"], EVERY, "target", 1.0)
    coefs = [F.col("coef")[i].alias(f) for i, f in enumerate(EVERY)]
    return fit.select("symbol", "fold_id", "n_train", "intercept", *coefs)


@query("ridge_walk_forward")
def ridge_walk_forward(spark, sf):
    return ridge_scores(_matrix(spark, sf))


def ridge_scores(d):
    fits = models.fit_ridge(_wide_sums(d), ["symbol", "fold_id"], EVERY, "target", 1.0)
    p = models.predict_ridge(_folds(d).where("part = 'test'"), keep(fits), ["symbol", "fold_id"], EVERY)
    return metrics.regression_metrics(p, ["symbol", "fold_id"])


# --- fitted classifiers and feature families, all folds at once ----------------------------------


def softmax_calls(d):
    """Test rows of every fold with the classes of that fold's own fit."""
    f = _folds(d)
    key = ["symbol", "fold_id"]
    fits = fold_models.fit_softmax(f.where("part = 'train'"), key, EVERY)
    return fold_models.predict_softmax(f.where("part = 'test'"), keep(fits), key, EVERY).withColumn("fwd", F.col("target"))


def softmax_scores(d):
    calls, key = keep(softmax_calls(d)), ["symbol", "fold_id"]
    return metrics.class_metrics(calls, key).join(metrics.hit_rate(calls, key), key)


@query("softmax_folds")
def softmax_folds(spark, sf):
    """Accuracy, F1 and hit rate of a fitted classifier in each walk-forward window."""
    return softmax_scores(_matrix(spark, sf)).select("symbol", "fold_id", "n", "accuracy", "f1_macro", "n_signals", "hit_rate")


@query("softmax_summary")
def softmax_summary(spark, sf):
    return metrics.classification_summary(softmax_scores(_matrix(spark, sf)))


@query("softmax_probabilities")
def softmax_probabilities(spark, sf):
    p = softmax_calls(_matrix(spark, sf))
    return p.select("symbol", "fold_id", "ts", "pred_class", *[F.col("proba")[i].alias(c) for i, c in enumerate(("p_sell", "p_hold", "p_buy"))])


#: Feature families switched on and off, by name.
VARIANTS = {
    "technical": FeatureSpec().columns(), "technical+micro": FeatureSpec(micro=True).columns(),
    "technical+smooth": FeatureSpec(smooth=True).columns(), "technical+micro+smooth": FULL.columns(),
}


PENALTIES = (1.0, 100.0)


def _swept(d, variants, alphas=(1.0,)):
    return keep(fold_models.sweep_ridge(_wide_sums(d), ["symbol", "fold_id"], EVERY, "target", variants, alphas))


def variant_folds(d):
    """Class metrics per fold and feature variant: calls of the swept ridge fits under dynamic thresholds."""
    p = fold_models.predict_swept(_folds(d).where("part = 'test'"), _swept(d, VARIANTS), ["symbol", "fold_id"], EVERY)
    buy, sell = signals.dynamic_thresholds(F.col("atr_pct"))
    p = keep(p.withColumns({"fwd": F.col("target"), "pred_class": F.when(F.col("pred") > buy, 2).when(F.col("pred") < sell, 0).otherwise(1)}))
    key = ["symbol", "variant", "n_features", "fold_id"]
    return metrics.class_metrics(p, key).join(metrics.hit_rate(p, key), key)


@query("feature_ablation")
def feature_ablation(spark, sf):
    """Which feature families earn their place: real fits of every FeatureSpec variant, from one set of moments."""
    return metrics.ablation_table(variant_folds(_matrix(spark, sf)), ["symbol", "n_features"], spread_over=["symbol"])


def combo_results(spark, sf):
    """Train and test R2 per symbol, feature combination and penalty, fitted on the train segment."""
    d = splits.add_segments(_matrix(spark, sf), horizon=5)
    train = models.moments(d.where("segment = 'train'"), ["symbol"], EVERY, "target")
    fits = keep(fold_models.sweep_ridge(train, ["symbol"], EVERY, "target", VARIANTS, PENALTIES))
    model = F.concat(F.lit("ridge_"), F.col("alpha").cast("int"))
    p = fold_models.predict_swept(d.where("segment = 'test'"), fits, ["symbol"], EVERY)
    test = metrics.regression_metrics(p, ["symbol", "variant", "alpha"]).select("symbol", "variant", "alpha", F.col("r2").alias("test_r2"))
    both = fits.join(test, ["symbol", "variant", "alpha"])
    return keep(both.select("symbol", F.col("variant").alias("combo"), model.alias("model"), "n_features", "train_r2", "test_r2"))


@query("family_summary")
def family_summary(spark, sf):
    return metrics.combo_summary(combo_results(spark, sf))


@query("family_increments")
def family_increments(spark, sf):
    return metrics.incremental_value(combo_results(spark, sf), ["technical", "technical+micro", "technical+micro+smooth"])


@query("family_best")
def family_best(spark, sf):
    return metrics.best_per_symbol(combo_results(spark, sf))


@query("family_detail")
def family_detail(spark, sf):
    return metrics.full_detail(combo_results(spark, sf), "technical+micro+smooth", ["ridge_1", "ridge_100"])


@query("one_feature_variant", f"""WITH {CLEAN}, f AS (SELECT c.symbol, fold_id, count(*) AS n, avg(vwap_dist) AS mx, avg(target) AS my,
    covar_pop(vwap_dist, target) AS c, var_pop(vwap_dist) AS v FROM clean c JOIN wf ON wf.symbol = c.symbol AND rn >= fold_id * 60 AND rn < fold_id * 60 + 295 GROUP BY 1, 2),
  b AS (SELECT *, c / v * n / (n + 1) AS beta FROM f)
  SELECT symbol, fold_id, 1 AS n_features, n AS n_train, {rs(coef='beta', intercept='my - beta * mx')} FROM b""")
def one_feature_variant(spark, sf):
    """The variant of one feature, solved from the products of all: ridge has a closed form there."""
    fits = fold_models.sweep_ridge(_fold_sums(spark, sf), ["symbol", "fold_id"], FEATURES, "target", {"vwap": ["vwap_dist"]})
    fits = fits.withColumn("coef", F.col("coef")[FEATURES.index("vwap_dist")])
    return show(fits, "coef", "intercept", keys=("symbol", "fold_id", "n_features", "n_train"))


def _segmented(spark, sf):
    """The feature table with all bar families, cut into train, validation and test rows."""
    full = engineer(hourly(spark, sf), SPEC).select("symbol", "ts", "close", *WIDE, "target")
    full = number_rows(keep(full), ["symbol"], ["ts"], time_bucket(F.col("ts"), 365.0), total="n")
    return keep(splits.add_segments(full, horizon=5))


@query("ridge_alpha_search")
def ridge_alpha_search(spark, sf):
    d = _segmented(spark, sf)
    part = lambda s: models.moments(d.where(F.col("segment") == s), ["symbol"], WIDE, "target")
    return models.search_ridge(part("train"), part("val"), ["symbol"], WIDE, "target")


def _by_segment(scored):
    return metrics.regression_metrics(scored, ["segment"])


@query("linear_model")
def linear_model(spark, sf):
    d = _segmented(spark, sf)
    predict = models.fit_linear(d.where("segment = 'train'"), WIDE, "target")
    return _by_segment(predict(d))


def _boosted(d):
    return models.fit_boosted(d.where("segment = 'train'"), WIDE, "target", d.where("segment = 'val'"))


@query("boosted_model")
def boosted_model(spark, sf):
    d = _segmented(spark, sf)
    return _by_segment(_boosted(d).transform(models.assemble(d, WIDE)))


@query("boosting_curve")
def boosting_curve(spark, sf):
    """Validation loss after each boosting round, and the round where the ensemble is cut."""
    d, losses = _segmented(spark, sf), []
    model = models.fit_boosted(d.where("segment = 'train'"), WIDE, "target", d.where("segment = 'val'"), curve=losses)
    rows = [(i + 1, float(v), i + 1 == len(model.trees)) for i, v in enumerate(losses)]
    return spark.createDataFrame(rows, "round int, val_loss double, chosen boolean")


@query("tree_search")
def tree_search(spark, sf):
    """Every trial of a successive halving over tree settings; the winner of the last rung is marked."""
    d = _segmented(spark, sf)
    log = models.search_boosted(d.where("segment = 'train'"), d.where("segment = 'val'"), WIDE, "target", trials=6, first=5)
    return spark.createDataFrame(log, models.TRIALS_SCHEMA)


@query("feature_importance")
def feature_importance(spark, sf):
    return models.feature_ranking(spark, _boosted(_segmented(spark, sf)), WIDE)


@query("selected_features")
def selected_features(spark, sf):
    """Rows cut down to the strongest features."""
    d = _segmented(spark, sf)
    top = models.select_top(models.feature_ranking(spark, _boosted(d), WIDE))
    return d.select("symbol", "ts", "segment", *top, "target")


def _labelled(spark, sf):
    band, y = 0.5 * F.col("atr_pct"), F.col("target")
    return _segmented(spark, sf).withColumn("label", F.when(y > band, 2.0).when(y < -band, 0.0).otherwise(1.0))


def _class_scores(scored):
    out = scored.withColumn("proba", models.align_proba())
    out = signals.add_class_signal(out.drop("pred_class"))
    return metrics.class_metrics(out, ["segment"])


@query("logistic_model")
def logistic_model(spark, sf):
    d = _labelled(spark, sf)
    m = models.fit_logistic(d.where("segment = 'train'"), WIDE)
    return _class_scores(m.transform(models.assemble(d, WIDE)))


@query("class_probabilities")
def class_probabilities(spark, sf):
    d = _labelled(spark, sf)
    m = models.fit_logistic(d.where("segment = 'train'"), WIDE)
    out = m.transform(models.assemble(d, WIDE)).withColumn("p", models.align_proba())
    return out.select("symbol", "ts", F.col("p")[0].alias("p_sell"), F.col("p")[1].alias("p_hold"), F.col("p")[2].alias("p_buy"))


@query("boosted_classes")
def boosted_classes(spark, sf):
    d = _labelled(spark, sf)
    score = models.fit_boosted_classes(d.where("segment = 'train'"), WIDE, val=d.where("segment = 'val'"))
    return metrics.class_metrics(score(d), ["segment"])


@query("meta_model")
def meta_model(spark, sf):
    """Trained on the validation part: was the ridge direction right?"""
    d = _segmented(spark, sf)
    fit = models.fit_ridge(models.moments(d.where("segment = 'train'"), ["symbol"], WIDE, "target"), ["symbol"], WIDE, "target")
    p = keep(models.predict_ridge(d, fit, ["symbol"], WIDE)).withColumn(
        "meta_label", (F.signum("pred") == F.signum("target")).cast("int"))
    score = models.fit_meta(p.where("segment = 'val'"), WIDE)
    return score(p.where("segment = 'test'")).select("symbol", "ts", "pred", "prob_correct")


# --- streams -----------------------------------------------------------------------------------


def _drain(q):
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


_CLOSED = f"""WITH {HOURLY} SELECT symbol, ts, open, high, low, close, volume FROM hourly
  WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 MINUTE FROM events)"""


def _landed_ticks(spark, sf, files=None):
    """Ticks as a recorder lands them; with ``files``, in files by day that arrive in any order."""
    root, ev = scratch_folder(spark), tables.table(spark, sf, "events")
    ticks = ev.select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"),
                      F.lit(1.0).alias("size"))
    (ticks.repartition(files, F.to_date("ts")) if files else ticks).write.parquet(f"{root}/ticks")
    return root


@query("streamed_bars", _CLOSED)
def streamed_bars(spark, sf):
    """Bars the watermark has closed; the newest hour stays open in the state store."""
    root = _landed_ticks(spark, sf)
    out = bar_stream.stream_bars(bar_stream.read_ticks(spark, f"{root}/ticks"))
    _drain(bar_stream.write_bars(out, f"{root}/bars", f"{root}/ckpt", available_now=True))
    return spark.read.parquet(f"{root}/bars").select("symbol", "ts", "open", "high", "low", "close", "volume")


@query("backfilled_bars", _CLOSED)
def backfilled_bars(spark, sf):
    """The same bars from ten files at once, admitted in order of time."""
    root = _landed_ticks(spark, sf, 40)
    _drain(backfill.backfill_bars(spark, f"{root}/ticks", f"{root}/bars", f"{root}/steps", per_step=10))
    return spark.read.parquet(f"{root}/bars").select("symbol", "ts", "open", "high", "low", "close", "volume")


def _landed_books(spark, sf, files=None):
    root, books = scratch_folder(spark), tables.books(spark, sf)
    (books.repartition(files, F.date_trunc("month", "ts")) if files else books).write.parquet(f"{root}/books")
    return root, book_stream.read_books(spark, f"{root}/books")


@query("recorded_snapshots", f"""WITH {BOOKS} SELECT symbol, ts, CASE WHEN imb > 0.3 THEN 'BUY PRESSURE' WHEN imb < -0.3 THEN 'SELL PRESSURE' ELSE 'BALANCED' END AS state,
  round(imb, 4) + 0.0 AS imbalance, bid_walls, ask_walls FROM book""")
def recorded_snapshots(spark, sf):
    root, stream = _landed_books(spark, sf)
    _drain(book_stream.record(stream, f"{root}/out", f"{root}/ckpt", available_now=True))
    return spark.read.parquet(f"{root}/out").select("symbol", "ts", "state", (F.col("imbalance") + 0.0).alias("imbalance"), "bid_walls", "ask_walls")


_TRACKED = f"""WITH RECURSIVE {BOOKS}, n AS (SELECT symbol, ts, reliable, round(imb, 4) AS raw, row_number() OVER {ORD} AS k FROM book),
  walk AS (
    SELECT symbol, ts, k, reliable, CASE WHEN reliable THEN raw END AS ema,
      CASE WHEN reliable THEN {_step_sql('raw', "'BALANCED'")} ELSE 'BALANCED' END AS held FROM n WHERE k = 1
    UNION ALL
    SELECT symbol, ts, k, reliable, ema, CASE WHEN reliable THEN {_step_sql('ema', 'prev')} ELSE prev END FROM (
      SELECT n.symbol, n.ts, n.k, n.reliable, w.held AS prev,
        CASE WHEN NOT n.reliable THEN w.ema WHEN w.ema IS NULL THEN n.raw ELSE 0.3 * n.raw + 0.7 * w.ema END AS ema
      FROM walk w JOIN n ON n.symbol = w.symbol AND n.k = w.k + 1) z)
  SELECT symbol, ts, CASE WHEN reliable THEN held ELSE 'THIN BOOK' END AS state, {r('coalesce(ema, 0)')} AS smoothed, reliable FROM walk"""


@query("streamed_tracker", _TRACKED)
def streamed_tracker(spark, sf):
    root, stream = _landed_books(spark, sf)
    _drain(book_stream.track(stream, f"{root}/out", f"{root}/ckpt", available_now=True))
    return show(book_stream.read_tracked(spark, f"{root}/out"), "smoothed", keys=("symbol", "ts", "state", "reliable"))


@query("backfilled_tracker", _TRACKED)
def backfilled_tracker(spark, sf):
    """The same rows from ten files at once, admitted in order of time, the state carried over the steps."""
    root, _ = _landed_books(spark, sf, 40)
    _drain(backfill.backfill_tracker(spark, f"{root}/books", f"{root}/out", f"{root}/steps", per_step=10))
    return show(book_stream.read_tracked(spark, f"{root}/out"), "smoothed", keys=("symbol", "ts", "state", "reliable"))
