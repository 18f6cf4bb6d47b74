"""Significance helpers. They run on aggregated rows, a handful per report."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz), vectorised."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 100_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return h


def _inc_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    lg = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(lg(a + b) - lg(a) - lg(b) + a * np.log(x) + b * np.log1p(-x))
    direct = x < (a + 1.0) / (a + b + 2.0)
    left = front * _beta_fraction(a, b, x) / a
    right = 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b
    return np.where(direct, left, right)


def binomial_tail(wins, n, p: float = 0.5) -> np.ndarray:
    """P[X >= wins] for X ~ Binomial(n, p); 1.0 when n is 0. Cost does not grow with n."""
    k, n = np.asarray(wins, float), np.asarray(n, float)
    out = np.ones_like(k)
    out[(k > n) & (n > 0)] = 0.0
    inner = (k > 0) & (k <= n) & (n > 0)
    if inner.any():
        out[inner] = _inc_beta(k[inner], n[inner] - k[inner] + 1.0, np.full(inner.sum(), p))
    return out


def binomial_p(wins: Column, n: Column, p_null: float = 0.5) -> Column:
    """One-sided p-value of at least ``wins`` successes."""

    @F.pandas_udf("double")
    def tail(w: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series(binomial_tail(w.to_numpy(float), m.to_numpy(float), p_null))

    return tail(F.coalesce(wins, F.lit(0)).cast("double"), F.coalesce(n, F.lit(0)).cast("double"))


def deflate(p: Column, trials: Column) -> Column:
    """Pay for having picked the best of several trials."""
    return F.when(trials <= 1, p).otherwise(1.0 - F.pow(1.0 - p, trials))


def breakeven_win_rate(rr: Column) -> Column:
    return F.when(rr <= 0, F.lit(1.0)).otherwise(F.try_divide(F.lit(1.0), 1.0 + rr))


def expected_value(win_rate: Column, gain: Column, loss: Column, cost=0.0) -> Column:
    cost = cost if isinstance(cost, Column) else F.lit(float(cost))
    return win_rate * gain - (1.0 - win_rate) * loss - cost
