"""Model fitting. Ridge for many folds at once from added moments; the rest on Spark ML."""

from __future__ import annotations

import math
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The published booster settings Spark has a twin for.
BOOST = {"max_iter": 200, "max_depth": 3, "step": 0.05, "subsample": 0.8, "min_rows": 5}
SEED = 42
TOP_K = 10
PATIENCE = 20


# --- ridge from moments -------------------------------------------------------------------


def _names(features: Sequence[str], target: str) -> list[tuple[str, Column]]:
    """Every sum a ridge fit needs, with 1 and the target among the variables."""
    cols = [F.lit(1.0), *[F.col(f) for f in features], F.col(target)]
    out = []
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            out.append((f"m{i}_{j}", a * cols[j]))
    return out


def moments(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str) -> DataFrame:
    """Sums of all products per key: partial sums travel, rows do not."""
    return df.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in _names(features, target)])


def fold_moments(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, train: int,
    test: int, step: int | None = None, purge: int = 0, rn: str = "rn", total: str = "n",
) -> DataFrame:
    """Train moments of every walk-forward fold without copying a row per fold.

    Rows are summed per block of ``gcd(train, step)`` rows, the purged block end apart;
    folds are then sums of whole blocks.
    """
    step = step or test
    b = math.gcd(train, step)
    if purge > b:
        raise ValueError(f"purge ({purge}) must not exceed the block of {b} rows")
    block, at = F.floor(F.col(rn) / b).cast("long"), F.pmod(F.col(rn), F.lit(b))
    tagged = df.withColumns({"_block": block, "_tail": at >= b - purge})
    sums = moments(tagged, [*keys, total, "_block", "_tail"], features, target)
    start = F.col("_block") * b
    top = F.floor((F.col(total) - (train + test)) / step)
    lo = F.greatest(F.ceil((start + b - train) / step), F.lit(0)).cast("long")
    hi = F.least(F.floor(start / step), top).cast("long")
    folds = F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
    spread = sums.withColumn("fold_id", F.explode(folds))
    ends_here = F.col("_block") * b + b == F.col("fold_id") * step + train
    kept = spread.where(~(ends_here & F.col("_tail")))
    names = [n for n, _ in _names(features, target)]
    return kept.groupBy(*keys, "fold_id").agg(*[F.sum(n).alias(n) for n in names])


def _unpack(flat: Sequence[float], p: int) -> np.ndarray:
    """Full symmetric moment matrix of (1, x1..xp, y) from its upper triangle."""
    size = p + 2
    m = np.zeros((size, size))
    m[np.triu_indices(size)] = flat
    return m + np.triu(m, 1).T


def solve_ridge(flat: Sequence[float], p: int, alpha: float) -> tuple[np.ndarray, float]:
    """Coefficients on raw features of a ridge on standardised ones, and the intercept."""
    m = _unpack(flat, p)
    n = m[0, 0]
    mean = m[0, 1:] / n
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.clip(np.diag(cov)[:p], 0, None))
    sd[sd == 0] = 1.0
    zz = cov[:p, :p] / np.outer(sd, sd) * n
    zy = cov[:p, p] / sd * n
    w = np.linalg.solve(zz + alpha * np.eye(p), zy) / sd
    return w, float(mean[p] - w @ mean[:p])


def fit_ridge(
    sums: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, alpha: float = 1.0
) -> DataFrame:
    """One fit per key from its moments: (keys, n_train, coef array, intercept)."""
    p = len(features)
    flat = F.array(*[F.col(n) for n, _ in _names(features, target)])

    @F.pandas_udf("coef array<double>, intercept double")
    def solve(rows: pd.Series) -> pd.DataFrame:
        fits = [solve_ridge(r, p, alpha) for r in rows]
        return pd.DataFrame({"coef": [w.tolist() for w, _ in fits], "intercept": [b for _, b in fits]})

    return sums.withColumn("_f", solve(flat)).select(
        *keys, F.col("m0_0").cast("long").alias("n_train"), "_f.*"
    )


def predict_ridge(df: DataFrame, fits: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    dot = sum((F.col("coef")[i] * F.col(f) for i, f in enumerate(features)), F.col("intercept"))
    return df.join(fits.select(*keys, "coef", "intercept"), list(keys)).withColumn("pred", dot).drop(
        "coef", "intercept"
    )


def alpha_grid(n: int = 20, lo: float = 1e-3, hi: float = 100.0) -> list[float]:
    return [float(a) for a in np.geomspace(lo, hi, n)]


def search_ridge(
    train: DataFrame, val: DataFrame, keys: Sequence[str], features: Sequence[str], target: str,
    alphas: Sequence[float] | None = None,
) -> DataFrame:
    """Best alpha per key by validation RMSE. Both sides are moments: no pass over rows."""
    p, grid = len(features), list(alphas or alpha_grid())
    names = [n for n, _ in _names(features, target)]
    pack = lambda df, out: df.select(*keys, F.array(*names).alias(out))

    @F.pandas_udf("alpha double, val_rmse double")
    def best(tr: pd.Series, va: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(tr, va):
            m, scores = _unpack(b, p), []
            for alpha in grid:
                w, c = solve_ridge(a, p, alpha)
                # The residual is a linear form of (1, x, y); its square follows from moments.
                v = np.concatenate([[c], w, [-1.0]])
                scores.append(math.sqrt(max(float(v @ m @ v) / m[0, 0], 0.0)))
            i = int(np.argmin(scores))
            out.append((grid[i], scores[i]))
        return pd.DataFrame(out, columns=["alpha", "val_rmse"])

    both = pack(train, "_t").join(pack(val, "_v"), list(keys))
    return both.withColumn("_b", best("_t", "_v")).select(*keys, "_b.*")


# --- Spark ML -------------------------------------------------------------------------------


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error").transform(df)


def fit_linear(train: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0):
    """Ridge on standardised features over one large training set.

    The penalty is scaled so that it equals alpha on population-standardised inputs.
    """
    data = assemble(train, features, "_raw")
    scaler = StandardScaler(inputCol="_raw", outputCol="features", withMean=True).fit(data)
    n, sd = train.agg(F.count(target), F.stddev_pop(target)).first()
    model = LinearRegression(
        featuresCol="features", labelCol=target, predictionCol="pred", solver="normal",
        elasticNetParam=0.0, regParam=float(alpha / n * sd), standardization=True,
    ).fit(scaler.transform(data))
    return lambda df: model.transform(scaler.transform(assemble(df, features, "_raw"))).drop(
        "_raw", "features"
    )


def best_round(losses: Sequence[float], patience: int) -> int:
    """Rounds to keep: the best one before ``patience`` rounds in a row brought no lower loss; the first of equal ones."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def _patient(booster, train: DataFrame, val: DataFrame | None, rounds: int, patience: int, losses_of):
    """A booster's model with as many trees as the validation losses of all its prefixes ask for.

    Trees come one after another, so a shorter fit is the beginning of a longer one (same data, same seed).
    The fit is therefore grown in doubling lengths until patience runs out, and once more to the round that was best.
    """
    if val is None:
        return booster.setMaxIter(rounds).fit(train), None
    n = min(rounds, patience + 5)
    while True:
        model = booster.setMaxIter(n).fit(train)
        losses = losses_of(model, val)
        keep_rounds = best_round(losses, patience)
        if n >= rounds or keep_rounds + patience <= n:
            break
        n = min(rounds, 2 * n)
    return (model if keep_rounds == n else booster.setMaxIter(keep_rounds).fit(train)), losses


def fit_boosted(
    train: DataFrame, features: Sequence[str], target: str, val: DataFrame | None = None,
    max_iter: int = BOOST["max_iter"], max_depth: int = BOOST["max_depth"], step: float = BOOST["step"],
    subsample: float = BOOST["subsample"], patience: int = PATIENCE, curve: list | None = None,
):
    """Boosted regression trees; with a validation frame, cut at the round of least squared error.

    The losses of all rounds tried go to ``curve`` if one is given.
    """
    gbt = GBTRegressor(
        featuresCol="features", labelCol=target, predictionCol="pred", maxDepth=max_depth, stepSize=step,
        subsamplingRate=subsample, featureSubsetStrategy="0.8", minInstancesPerNode=BOOST["min_rows"], seed=SEED,
    )
    own = None if val is None else assemble(val, features)
    model, losses = _patient(gbt, assemble(train, features), own, max_iter, patience, lambda m, v: m.evaluateEachIteration(v, "squared"))
    if curve is not None and losses is not None:
        curve.extend(losses)
    return model


def search_boosted(
    train: DataFrame, val: DataFrame, features: Sequence[str], target: str, trials: int = 8, first: int = 10,
    seed: int = SEED,
) -> list[tuple]:
    """Successive halving over tree settings: (trial, rung, rounds, max_depth, step, subsample, val_rmse, best).

    Settings are drawn from the published ranges. Every rung fits what is left with twice the rounds and keeps
    the better half by validation RMSE; only train and validation rows are read. The last rung has one winner.
    """
    rng = np.random.default_rng(seed)
    draw = [(int(rng.integers(2, 9)), float(np.exp(rng.uniform(np.log(0.01), np.log(0.3)))), float(rng.uniform(0.5, 1.0)))
            for _ in range(trials)]
    left, rounds, rung, log = list(range(trials)), first, 0, []
    while True:
        scores = {}
        for t in left:
            depth, step, part = draw[t]
            model = fit_boosted(train, features, target, None, rounds, depth, step, part)
            scored = model.transform(assemble(val, features))
            scores[t] = scored.agg(F.sqrt(F.avg((F.col("pred") - F.col(target)) ** 2))).first()[0]
            log.append((t, rung, rounds, depth, step, part, scores[t]))
        left = sorted(left, key=lambda t: (scores[t], t))[: max(1, len(left) // 2)]
        if len(scores) == 1:
            return [(*row, row[0] == left[0] and row[1] == rung) for row in log]
        rounds, rung = rounds * 2, rung + 1


TRIALS_SCHEMA = ("trial int, rung int, rounds int, max_depth int, step double, subsample double, val_rmse double, best boolean")


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Weight n / (classes * class size), from a three-row table of class sizes."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_k"))
    every = Window.partitionBy(F.lit(0))
    n, classes = F.sum("_k").over(every), F.count(F.lit(1)).over(every)
    w = sizes.select(label, (n / (classes * F.col("_k"))).alias("weight"))
    return df.join(F.broadcast(w), label)  # at most one row per label code


def fit_logistic(train: DataFrame, features: Sequence[str], label: str = "label", c: float = 1.0):
    """Balanced multinomial logistic regression; ``c`` is the inverse penalty."""
    data = assemble(balanced_weights(train, label), features)
    n = train.count()
    return LogisticRegression(
        featuresCol="features", labelCol=label, weightCol="weight", family="multinomial",
        regParam=1.0 / (c * n), elasticNetParam=0.0, maxIter=1000, standardization=True,
    ).fit(data)


def _first_trees(model: GBTClassificationModel, k: int) -> GBTClassificationModel:
    """The model as it was after ``k`` rounds; trees come one after another and keep their weights."""
    j, jvm, array = model._java_obj, SparkSession.active()._jvm, GBTClassificationModel._new_java_array
    trees = array(list(j.trees())[:k], jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel)
    made = jvm.org.apache.spark.ml.classification.GBTClassificationModel(j.uid(), trees, array(model.treeWeights[:k], jvm.double))
    return model._copyValues(GBTClassificationModel(made))


def fit_boosted_classes(
    train: DataFrame, features: Sequence[str], label: str = "label", val: DataFrame | None = None,
    max_iter: int = BOOST["max_iter"], max_depth: int = BOOST["max_depth"], patience: int = PATIENCE,
    classes: int = 3,
):
    """One booster per class against the rest, as Spark's booster is binary: a function adding
    ``pred_class``, the likeliest class, the smallest of equal ones.

    Each class is cut at its own best validation round, see ``fit_boosted``. All rounds are fitted once and
    the trees after the best one left out, so no class grows a tree twice.
    """
    def fit(k):
        gbt = GBTClassifier(
            featuresCol="features", labelCol="_y", predictionCol=f"_c{k}", maxIter=max_iter, maxDepth=max_depth, stepSize=BOOST["step"],
            subsamplingRate=BOOST["subsample"], featureSubsetStrategy="0.8", minInstancesPerNode=BOOST["min_rows"], seed=SEED,
        ).setProbabilityCol(f"_p{k}").setRawPredictionCol(f"_r{k}")
        of = lambda df: assemble(df, features).withColumn("_y", (F.col(label) == k).cast("double"))
        model = gbt.fit(of(train))
        return model if val is None else _first_trees(model, best_round(model.evaluateEachIteration(of(val)), patience))

    # A round is a row of short jobs that leave most cores idle, so the classes are fitted side by side.
    with ThreadPool(classes) as pool:
        fits = pool.map(inheritable_thread_target(train.sparkSession)(fit), range(classes))

    def score(df: DataFrame) -> DataFrame:
        out = assemble(df, features)
        for m in fits:
            out = m.transform(out)
        p = F.array(*[vector_to_array(f"_p{k}").getItem(1) for k in range(classes)])
        best = (F.array_position(p, F.array_max(p)) - 1).cast("int")
        spare = [f"{c}{k}" for c in ("_c", "_p", "_r") for k in range(classes)]
        return out.withColumn("pred_class", best).drop("features", *spare)

    return score


def align_proba(probability: str = "probability") -> Column:
    """Probabilities as [SELL, HOLD, BUY], zero for a class the training part lacked."""
    p = vector_to_array(F.col(probability))
    return F.array(*[F.coalesce(F.get(p, F.lit(i)), F.lit(0.0)) for i in range(3)])


def fit_meta(train: DataFrame, features: Sequence[str], label: str = "meta_label"):
    """Random forest of "was the call right", as a function adding ``prob_correct``.

    With a single class there is nothing to learn and every call counts as right.
    """
    classes = train.select(label).distinct().limit(2).count()
    if classes < 2:
        return lambda df: df.withColumn("prob_correct", F.lit(1.0))
    model = RandomForestClassifier(
        featuresCol="features", labelCol=label, numTrees=100, maxDepth=4, seed=SEED
    ).fit(assemble(train, features))

    def score(df: DataFrame) -> DataFrame:
        out = model.transform(assemble(df, features))
        prob = vector_to_array("probability").getItem(1)
        return out.withColumn("prob_correct", prob).drop(
            "features", "rawPrediction", "probability", "prediction"
        )

    return score


def feature_ranking(spark, model, features: Sequence[str]) -> DataFrame:
    """Importance per feature, strongest first; one short row per feature."""
    scores = model.featureImportances.toArray().tolist()
    ranked = sorted(zip(features, scores), key=lambda x: (-x[1], x[0]))
    rows = [(i + 1, name, float(s)) for i, (name, s) in enumerate(ranked)]
    return spark.createDataFrame(rows, "rank int, feature string, importance double")


def select_top(ranking: DataFrame, k: int = TOP_K) -> list[str]:
    return [r.feature for r in ranking.where(F.col("rank") <= k).orderBy("rank").collect()]
