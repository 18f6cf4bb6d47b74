"""Models of very many groups (symbols, folds) at once: softmax fits and feature-family sweeps.

A softmax fit is a few Newton steps. Each step is one pass over blocks of rows: a block gives its
gradient and curvature under the parameters so far, the blocks of a group are added, and the small
sums are solved per group. A group may hold any number of rows; no task sees more than a block.

Feature families need no pass of their own: the products of all features of the widest set are
added once, and every narrower set is solved from its rows and columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeflow.operators.models import _names, _unpack, solve_ridge
from tapeflow.plans.slices import RN
from tapeflow.plans.tables import keep

CLASSES = 3
BLOCK_ROWS = 256


# --- softmax ---------------------------------------------------------------------------------


def _scales(rows: DataFrame, keys: Sequence[str], features: Sequence[str], label: str) -> DataFrame:
    """Per group: mean and deviation of each feature, balanced class weights (0 for a class it lacks), rows."""
    sizes = [F.count_if(F.col(label) == k).alias(f"_k{k}") for k in range(CLASSES)]
    g = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_train"), *sizes,
        F.array(*[F.avg(f) for f in features]).alias("mean"),
        F.array(*[F.stddev_pop(f) for f in features]).alias("_sd"))
    seen = sum(((F.col(f"_k{k}") > 0).cast("int") for k in range(CLASSES)), F.lit(0))
    weights = F.array(*[F.when(F.col(f"_k{k}") > 0, F.col("n_train") / (seen * F.col(f"_k{k}"))).otherwise(0.0) for k in range(CLASSES)])
    return g.select(*keys, "n_train", "mean", F.transform("_sd", lambda s: F.when(s > 0, s).otherwise(1.0)).alias("sd"), weights.alias("weights"))


def _block_sums(p: int):
    """Loss, gradient and upper triangle of the curvature of one block, flat."""
    d = p + 1
    upper = np.triu_indices(CLASSES * d)

    @F.pandas_udf("array<double>")
    def sums(xs: pd.Series, ys: pd.Series, mean: pd.Series, sd: pd.Series, weights: pd.Series, theta: pd.Series) -> pd.Series:
        out = []
        for x, y, m, s, w, t in zip(xs, ys, mean, sd, weights, theta):
            y, w = np.asarray(y, int), np.asarray(w, float)
            z = np.column_stack([np.ones(len(y)), (np.asarray(x, float).reshape(len(y), p) - np.asarray(m)) / np.asarray(s)])
            logits = np.where(w > 0, z @ np.asarray(t, float).reshape(CLASSES, d).T, -np.inf)
            logits -= logits.max(axis=1, keepdims=True)
            e = np.exp(logits)
            proba, rows = e / e.sum(axis=1, keepdims=True), np.arange(len(y))
            own = w[y]
            loss = own @ (np.log(e.sum(axis=1)) - logits[rows, y])
            rest = proba.copy()
            rest[rows, y] -= 1.0
            grad = (rest * own[:, None]).T @ z
            curve = np.zeros((CLASSES, d, CLASSES, d))
            for a in range(CLASSES):
                for b in range(a, CLASSES):
                    c = own * proba[:, a] * ((a == b) - proba[:, b])
                    curve[a, :, b, :] = curve[b, :, a, :] = (z * c[:, None]).T @ z
            out.append(np.concatenate([[loss], grad.ravel(), curve.reshape(CLASSES * d, CLASSES * d)[upper]]))
        return pd.Series(out)

    return sums


def _newton(p: int, penalty: float):
    """The next parameters of a group from its sums: a Newton step, or half the way back if the last one overshot."""
    d, size = p + 1, CLASSES * (p + 1)
    upper = np.triu_indices(size)
    slope = np.tile(np.r_[0.0, np.ones(p)], CLASSES) * penalty

    @F.pandas_udf("theta array<double>, before array<double>, loss double, moved double")
    def step(flat: pd.Series, theta: pd.Series, before: pd.Series, loss: pd.Series, weights: pd.Series) -> pd.DataFrame:
        out = []
        for f, t, b, last, w in zip(flat, theta, before, loss, weights):
            f, t, b = (np.asarray(v, float) for v in (f, t, b))
            now = f[0] + 0.5 * slope @ (t * t)
            if now > last + 1e-9 * abs(last):
                half = (t + b) / 2
                out.append((half.tolist(), b.tolist(), last, float(np.abs(half - t).max())))
                continue
            h = np.zeros((size, size))
            h[upper] = f[1 + size :]
            h = h + np.triu(h, 1).T + np.diag(slope)
            used = np.repeat(np.asarray(w) > 0, d)
            move = np.zeros(size)
            # Adding one number to all intercepts changes nothing: the shortest of all solutions is taken.
            move[used] = np.linalg.lstsq(h[np.ix_(used, used)], (f[1 : 1 + size] + slope * t)[used], rcond=None)[0]
            out.append(((t - move).tolist(), t.tolist(), now, float(np.abs(move).max())))
        return pd.DataFrame(out, columns=["theta", "before", "loss", "moved"])

    return step


def fit_softmax(
    rows: DataFrame, keys: Sequence[str], features: Sequence[str], label: str = "label", c: float = 1.0,
    tol: float = 1e-8, most: int = 60, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Balanced multinomial logistic fits per key: (keys, n_train, coef, intercept), on raw features.

    Features are standardised per group, ``c`` is the inverse penalty on the standardised coefficients, intercepts are
    free. ``coef`` holds the classes one after another; a class that a group lacks has a null intercept. ``rows``
    needs ``rn``. Raises if a group has not settled after ``most`` steps.
    """
    keys, p = list(keys), len(features)
    rows = rows.where(F.col(label).isNotNull())
    scales = keep(_scales(rows, keys, features, label))
    item = F.struct(F.col(label).cast("int").alias("y"), F.array(*features).alias("x"))
    blocks = rows.groupBy(*keys, F.floor(F.col(RN) / block_rows).alias("_b")).agg(F.collect_list(item).alias("i"))
    blocks = keep(blocks.select(*keys, F.flatten(F.transform("i", lambda r: r["x"])).alias("x"), F.transform("i", lambda r: r["y"]).alias("y")))
    sums, step = _block_sums(p), _newton(p, 1.0 / c)
    zero = F.array_repeat(F.lit(0.0), CLASSES * (p + 1))
    state = scales.select(*keys, zero.alias("theta"), zero.alias("before"), F.lit(float("inf")).alias("loss"), F.lit(1.0).alias("moved"))
    for _ in range(most):
        flat = (
            blocks.join(scales.drop("n_train"), keys).join(state.select(*keys, "theta"), keys)
            .select(*keys, F.posexplode(sums("x", "y", "mean", "sd", "weights", "theta")).alias("at", "v"))
            .groupBy(*keys, "at").agg(F.sum("v").alias("v"))
            .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("f"))
            .select(*keys, F.transform("f", lambda e: e["v"]).alias("f")))
        moved = flat.join(state, keys).join(scales.select(*keys, "weights"), keys)
        state = keep(moved.select(*keys, step("f", "theta", "before", "loss", "weights").alias("s")).select(*keys, "s.*"))
        far = state.agg(F.max("moved")).first()[0]
        if far is None or far < tol:
            return _on_raw(state.select(*keys, "theta").join(scales, keys), keys, p)
    raise RuntimeError(f"some fits still move by {far} after {most} steps")


def _on_raw(fits: DataFrame, keys: Sequence[str], p: int) -> DataFrame:
    d = p + 1
    coef = [F.col("theta")[k * d + 1 + i] / F.col("sd")[i] for k in range(CLASSES) for i in range(p)]
    free = [F.col("theta")[k * d] - sum((F.col("theta")[k * d + 1 + i] * F.col("mean")[i] / F.col("sd")[i] for i in range(p)), F.lit(0.0))
            for k in range(CLASSES)]
    some = [F.when(F.col("weights")[k] > 0, free[k]) for k in range(CLASSES)]
    return fits.select(*keys, "n_train", F.array(*coef).alias("coef"), F.array(*some).alias("intercept"))


def predict_softmax(df: DataFrame, fits: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Add ``proba`` [SELL, HOLD, BUY] and ``pred_class``, the likeliest class, the smallest of equal ones."""
    p = len(features)
    logits = [sum((F.col("coef")[k * p + i] * F.col(f) for i, f in enumerate(features)), F.col("intercept")[k]) for k in range(CLASSES)]
    df = df.join(fits.select(*keys, "coef", "intercept"), list(keys))
    df = df.withColumn("_l", F.array(*logits)).withColumn("_e", F.transform("_l", lambda v: F.coalesce(F.exp(v - F.array_max("_l")), F.lit(0.0))))
    total = F.aggregate("_e", F.lit(0.0), lambda a, v: a + v)
    df = df.withColumn("_t", total).withColumn("proba", F.transform("_e", lambda v: v / F.col("_t")))
    best = (F.array_position("proba", F.array_max("proba")) - 1).cast("int")
    return df.withColumn("pred_class", best).drop("coef", "intercept", "_l", "_e", "_t")


# --- feature families from one set of moments -------------------------------------------------


def sweep_ridge(
    sums: DataFrame, keys: Sequence[str], features: Sequence[str], target: str,
    variants: Mapping[str, Sequence[str]], alphas: Sequence[float] = (1.0,),
) -> DataFrame:
    """A ridge fit per key, feature variant and penalty, from the moments of all ``features``.

    (keys, variant, n_features, alpha, n_train, coef, intercept, train_r2); ``coef`` has a place for every
    feature, 0 where the variant leaves it out. The residual is linear in (1, x, y), so its square follows
    from the moments as well.
    """
    p, place = len(features), {f: i for i, f in enumerate(features)}
    chosen = [(name, [place[f] for f in cols]) for name, cols in variants.items()]
    kind = "array<struct<variant:string,n_features:int,alpha:double,coef:array<double>,intercept:double,train_r2:double>>"

    @F.pandas_udf(kind)
    def solve(flat: pd.Series) -> pd.Series:
        out = []
        for row in flat:
            m = _unpack(row, p)
            mine = []
            for name, at in chosen:
                picked = [0, *(i + 1 for i in at), p + 1]
                part = m[np.ix_(picked, picked)]
                for alpha in alphas:
                    w, b = solve_ridge(part[np.triu_indices(len(picked))], len(at), alpha)
                    v = np.concatenate([[b], w, [-1.0]])
                    n, spread = part[0, 0], part[-1, -1] - part[0, -1] ** 2 / part[0, 0]
                    coef = np.zeros(p)
                    coef[at] = w
                    r2 = float(1 - v @ part @ v / spread) if spread > 0 and n > 0 else None
                    mine.append({"variant": name, "n_features": len(at), "alpha": float(alpha), "coef": coef.tolist(),
                                 "intercept": b, "train_r2": r2})
            out.append(mine)
        return pd.Series(out)

    flat = F.array(*[F.col(n) for n, _ in _names(features, target)])
    return sums.select(*keys, F.col("m0_0").cast("long").alias("n_train"), F.inline(solve(flat)))


def predict_swept(df: DataFrame, fits: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One row per row, variant and penalty, with ``pred``."""
    dot: Column = sum((F.col("coef")[i] * F.col(f) for i, f in enumerate(features)), F.col("intercept"))
    own = fits.select(*keys, "variant", "n_features", "alpha", "coef", "intercept")
    return df.join(own, list(keys)).withColumn("pred", dot).drop("coef", "intercept")
