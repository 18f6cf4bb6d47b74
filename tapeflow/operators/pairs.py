"""Statistical arbitrage on listed pairs: fit, spread, positions, trades, judgement.

Pairs come as an explicit list, so work grows with the pairs asked for, never with
the square of the symbols.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.functions.numeric import div
from tapeflow.functions.stats import binomial_p, deflate
from tapeflow.operators.splits import add_folds
from tapeflow.plans.slices import RN, SLICE, over_slices, rn_bucket
from tapeflow.plans.tables import keep

# Asymptotic critical values with a constant, plain and residual-based.
ADF_CRITICAL = {0.01: -3.43, 0.05: -2.86, 0.10: -2.57}
RESIDUAL_CRITICAL = {0.01: -3.90, 0.05: -3.34, 0.10: -3.04}


def align_pairs(bars: DataFrame, pairs: DataFrame | Sequence[tuple[str, str]], price: str = "close") -> DataFrame:
    """(pair, ts, y, x) on the times both legs trade; ``pairs`` lists (y, x) symbols, as a table or a short list.

    A bar is copied once per listed pair it takes part in, and the legs meet on
    (pair, ts), which spreads a busy symbol over all its times. A repeated pair counts once.
    """
    if not isinstance(pairs, DataFrame):
        pairs = bars.sparkSession.createDataFrame(list(pairs), "y string, x string")
    listed = pairs.select(F.concat("y", F.lit("~"), "x").alias("pair"), F.col("y").alias("_y"), F.col("x").alias("_x")).distinct()

    def leg(side: str) -> DataFrame:
        mine = bars.select(F.col("symbol"), "ts", F.col(price).alias(side))
        return mine.join(listed, F.col("symbol") == F.col(f"_{side}")).select("pair", "ts", side)

    return leg("y").join(leg("x"), ["pair", "ts"])


def pivot_on(rows: DataFrame, by: Sequence[str] = ("pair",)) -> DataFrame:
    """Add what a fit needs to keep its digits: x and the residual of one rough fit per ``by``, both around their means.

    Second moments of prices lose what is small beside the level when they are subtracted. Moments of the
    residual (``_e``) and of ``_dx`` have nothing large in them, add up over blocks like any others, and give the
    fit of any part of the rows, see ``hedge_fit``. One pass before rows are copied to folds.
    """
    rough = rows.groupBy(*by).agg(
        F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)).alias("_b0"), F.avg("x").alias("_x0"), F.avg("y").alias("_y0"))
    dx = F.col("x") - F.col("_x0")
    return rows.join(rough, list(by)).withColumns({"_dx": dx, "_e": F.col("y") - F.col("_y0") - F.col("_b0") * dx})


def hedge_fit(rows: DataFrame, keys: Sequence[str], by: Sequence[str] = ("pair",)) -> DataFrame:
    """Slope, intercept and the train spread's mean and deviation, from one pass of centred moments.

    ``rows`` come from ``pivot_on``, or are pivoted here.
    """
    if "_e" not in rows.columns:
        rows = pivot_on(rows, by)
    g = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_train"),
        *[F.first(c).alias(c) for c in ("_b0", "_x0", "_y0")],
        F.avg("_e").alias("_me"), F.avg("_dx").alias("_mx"),
        F.var_pop("_e").alias("_ve"), F.var_pop("_dx").alias("_vx"), F.covar_pop("_e", "_dx").alias("_c"),
    )
    more = F.when(F.col("n_train") > 1, div(F.col("_c"), F.col("_vx")))
    beta = F.col("_b0") + F.col("_more")
    alpha = F.col("_y0") + F.col("_me") - F.col("_more") * F.col("_mx") - F.col("beta") * F.col("_x0")
    sd = F.sqrt(F.greatest(F.col("_ve") - F.col("_more") * F.col("_c"), F.lit(0.0)))
    return (
        g.withColumn("_more", more).withColumn("beta", beta)
        .withColumns({
            "alpha": alpha,
            # The residuals of a fit with an intercept add up to nothing.
            "spread_mean": F.when(F.col("beta").isNotNull(), 0.0),
            "spread_std": F.when(sd == 0, 1.0).otherwise(sd),
        })
        .select(*keys, "n_train", "beta", "alpha", "spread_mean", "spread_std")
    )


def add_spread(rows: DataFrame, fit: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spread and its z-score under a frozen fit."""
    spread = F.col("y") - (F.col("alpha") + F.col("beta") * F.col("x"))
    rows = rows.drop("_b0", "_x0", "_y0", "_dx", "_e")
    return rows.join(fit, list(keys)).withColumn("spread", spread).withColumn(
        "z", (F.col("spread") - F.col("spread_mean")) / F.col("spread_std")
    )


def add_positions(
    df: DataFrame, keys: Sequence[str], entry=2.0, leave=0.5, bounded: bool = False,
    rows: int = 16384,
) -> DataFrame:
    """Position of -1, 0 or 1 per bar, and the row of the entry that opened it.

    A position opens past ``entry`` and closes inside ``leave``. Only an entry that
    follows an exit (or nothing) counts, so within a slice the state is the last
    counting entry or exit. A slice's end state follows from its own start-flat end
    state, whether it holds an exit, and the end state before it; the same rule over
    the short table of slice ends gives every slice its start. ``bounded`` says a key
    holds few rows (a test block) and is its own slice. Needs ``leave <= entry``.
    """
    entry = entry if isinstance(entry, Column) else F.lit(float(entry))
    leave = leave if isinstance(leave, Column) else F.lit(float(leave))
    leave = F.when(leave <= entry, leave).otherwise(F.raise_error(F.lit("leave is above entry")).cast("double"))
    z = F.col("z")
    side = F.when(z > entry, -1.0).when(z < -entry, 1.0)
    none = F.struct(F.lit(0.0).alias("side"), F.lit(-1).cast("long").alias("at"))
    opened = F.struct(F.col("_side").alias("side"), F.col(RN).alias("at"))
    df = df.withColumns({"_exit": F.abs(z) < leave, "_side": side, SLICE: F.lit(0) if bounded else rn_bucket(rows)})
    part = Window.partitionBy(*keys, SLICE).orderBy(RN)
    df = _state(df, part, "_exit", opened, none)
    if not bounded:
        ends = df.groupBy(*keys, SLICE).agg(
            F.max_by("_state", RN).alias("_state"), F.max("_exit").alias("_any_exit")
        )
        walk = Window.partitionBy(*keys).orderBy(SLICE)
        flat = F.col("_state.side") == 0
        ends = ends.withColumns(
            {"_closes": F.col("_any_exit"), "_opens": F.when(~flat, F.col("_state"))}
        )
        # A slice with an exit ends in its own state; one without keeps an open position.
        kind = F.when(F.col("_closes"), "set").when(F.col("_opens").isNotNull(), "entry")
        ends = ends.withColumn("_kind", kind)
        before = walk.rowsBetween(Window.unboundedPreceding, -1)
        last_kind = F.last(
            F.when(F.col("_kind") == "set", ~flat).when(F.col("_kind") == "entry", F.lit(True)),
            ignorenulls=True,
        ).over(before)
        counts = (F.col("_kind") == "set") | ~F.coalesce(last_kind, F.lit(False))
        ends = ends.withColumn(
            "_eff", F.when(F.col("_kind").isNotNull() & counts, F.col("_state"))
        )
        ends = ends.select(
            *keys, SLICE, F.coalesce(F.last("_eff", ignorenulls=True).over(before), none).alias("_start")
        )
        df = df.join(ends, [*keys, SLICE])
        untouched = ~F.col("_exited") & (F.col("_start.side") != 0)
        df = df.withColumn("_state", F.when(untouched, F.col("_start")).otherwise(F.col("_state")))
        df = df.drop("_start")
    return df.withColumns(
        {"position": F.col("_state.side"), "trade_rn": F.col("_state.at")}
    ).drop("_exit", "_side", "_state", "_exited", SLICE)


def _state(df: DataFrame, w, exit_flag: str, opened: Column, none: Column) -> DataFrame:
    """Start-flat state inside a slice, and whether an exit has been seen in it."""
    event = F.when(F.col(exit_flag), F.lit(False)).when(F.col("_side").isNotNull(), F.lit(True))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_ev", event)
    df = df.withColumn("_open", F.coalesce(F.last("_ev", ignorenulls=True).over(before), F.lit(False)))
    effect = F.when(F.col(exit_flag), none).when(F.col("_ev") & ~F.col("_open"), opened)
    df = df.withColumn("_fx", effect)
    return df.withColumns(
        {
            "_state": F.coalesce(F.last("_fx", ignorenulls=True).over(upto), none),
            "_exited": F.max(exit_flag).over(upto),
        }
    ).drop("_ev", "_open", "_fx")


def add_pair_pnl(df: DataFrame, keys: Sequence[str], bounded: bool = False, rows: int = 16384) -> DataFrame:
    """PnL of each bar's position over the move to the next bar."""

    def step(d, w):
        move = F.lead("spread").over(w) - F.col("spread")
        return d.withColumn("pnl", F.coalesce(F.col("position") * move, F.lit(0.0)))

    if bounded:
        return step(df, Window.partitionBy(*keys).orderBy(RN))
    return over_slices(df, keys, [step], 0, 1, rows)


def trades(df: DataFrame, keys: Sequence[str], cost: float = 0.0) -> DataFrame:
    """One row per round trip, a run of one non-zero position; cost once per trip."""
    held = df.where(F.col("position") != 0)
    return held.groupBy(*keys, "trade_rn").agg(
        (F.sum("pnl") - F.lit(cost)).alias("trade_pnl"),
        F.first("position").alias("side"),
        F.count(F.lit(1)).alias("bars"),
    )


def trade_stats(closed: DataFrame, keys: Sequence[str]) -> DataFrame:
    p = F.col("trade_pnl")
    sharpe = div(F.avg(p), F.stddev_samp(p))
    return closed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.count_if(p > 0).alias("wins"),
        F.avg((p > 0).cast("double")).alias("win_rate"),
        F.sum(p).alias("total_pnl"),
        F.coalesce(sharpe, F.lit(0.0)).alias("sharpe"),
    )


def with_p_value(stats: DataFrame) -> DataFrame:
    return stats.withColumn("p_value", binomial_p(F.col("wins"), F.col("n_trades")))


def walk_forward_trades(
    rows: DataFrame, train: int, test: int, step: int | None = None,
    grid: Sequence[tuple[float, float]] = ((2.0, 0.5),), cost: float = 0.0, purge: int = 1,
    embargo: int = 0, total: str = "n",
) -> DataFrame:
    """Trades of every (pair, fold, config): fit on the purged train block, trade the test block.

    The fit is shared by all configs; a test block has ``test`` rows, so its windows
    are short whatever the series length.
    """
    f = add_folds(pivot_on(rows), train, test, step, purge, embargo, total=total)
    key = ["pair", "fold_id"]
    fit = hedge_fit(f.where(F.col("part") == "train"), key).where(
        (F.col("n_train") >= 4) & F.col("beta").isNotNull()
    )
    scored = add_spread(f.where(F.col("part") == "test"), fit, key)
    return _traded(scored, [*key, "entry", "leave"], grid, cost, bounded=True)


def _traded(scored, keys, grid, cost, bounded):
    configs = F.array(
        *[F.struct(F.lit(float(e)).alias("entry"), F.lit(float(x)).alias("leave")) for e, x in grid]
    )
    slim = [k for k in keys if k not in ("entry", "leave")]
    wide = scored.select(*slim, RN, "spread", "z", F.inline(configs))
    pos = add_positions(wide, keys, F.col("entry"), F.col("leave"), bounded)
    return trades(add_pair_pnl(pos, keys, bounded), keys, cost)


def select_config(
    stats: DataFrame, grid: Sequence[tuple[float, float]], select_by: str = "win_rate"
) -> DataFrame:
    """Best (entry, leave) per pair; the first of equal scores, the first config if none traded."""
    if select_by not in ("win_rate", "sharpe", "total_pnl"):
        raise ValueError(f"unknown select_by={select_by!r}")
    rank = sum(
        (
            F.when((F.col("entry") == e) & (F.col("leave") == x), F.lit(i)).otherwise(0)
            for i, (e, x) in enumerate(grid)
        ),
        F.lit(0),
    )
    best = F.max_by(F.struct("entry", "leave"), F.struct(F.col(select_by), (-rank).alias("r")))
    return stats.where(F.col("n_trades") > 0).groupBy("pair").agg(best.alias("b")).select("pair", "b.*")


def judge_pairs(
    rows: DataFrame, grid: Sequence[tuple[float, float]], train: int = 120, test: int = 40,
    cost: float = 0.0, purge: int = 1, select_by: str = "win_rate", share: float = 0.8,
) -> DataFrame:
    """Grid search on the first ``share`` of each pair, one sealed judgement on the rest.

    ``rows`` needs (pair, ts, y, x, rn, n). The p-value pays for the configs tried.
    Pairs too short for one train and test block before the edge cannot be judged.
    """
    edge = F.floor(F.col("n") * F.lit(share)).cast("long")
    rows = rows.withColumn("edge", edge).where(F.col("edge") >= train + test)
    before = rows.where(F.col(RN) < F.col("edge"))
    wf = walk_forward_trades(before, train, test, None, grid, cost, purge, total="edge")
    best = select_config(trade_stats(wf, ["pair", "entry", "leave"]), grid, select_by)
    fit = hedge_fit(before, ["pair"]).where(F.col("beta").isNotNull())
    held = rows.where(F.col(RN) >= F.col("edge"))
    scored = add_spread(held, fit, ["pair"]).join(keep(best), "pair", "left")
    first_entry, first_leave = grid[0]
    scored = scored.withColumns(
        {
            "entry": F.coalesce("entry", F.lit(float(first_entry))),
            "leave": F.coalesce("leave", F.lit(float(first_leave))),
        }
    )
    keys = ["pair"]
    scored = keep(scored.select("pair", RN, "spread", "z", "entry", "leave"))
    pos = add_positions(scored, keys, F.col("entry"), F.col("leave"))
    closed = trades(add_pair_pnl(pos, keys), keys, cost)
    chosen = scored.groupBy("pair").agg(F.first("entry").alias("entry"), F.first("leave").alias("leave"))
    stats = chosen.join(trade_stats(closed, keys), "pair", "left")
    stats = stats.withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("n_trades", "wins")}
        | {c: F.coalesce(c, F.lit(0.0)) for c in ("win_rate", "total_pnl", "sharpe")}
    )
    return with_p_value(stats).withColumn(
        "deflated_p", deflate(F.col("p_value"), F.lit(len(grid)))
    )


# --- cointegration ------------------------------------------------------------------------


def schwert_lag(n: int) -> int:
    """Default lag order, bounded so that the regression keeps enough rows."""
    return max(0, min(int(math.floor(12.0 * (n / 100.0) ** 0.25)), (n - 1) // 2 - 2))


def adf_moments(df: DataFrame, keys: Sequence[str], value: str, most: int, rows: int = 16384) -> DataFrame:
    """Everything a Dickey-Fuller regression with up to ``most`` lags needs, in one pass of plain sums.

    Per key: n, the sums of differences, of levels and of squared levels, ``c[k]``, the sum of products of
    differences k apart, ``x[k]``, the sum of products of a level with the difference k before it, and the first
    and last ``most`` differences (with their levels). The regression's matrix holds the sums of c and x along
    its diagonals but for a few products at either end, so 2 sums a lag replace one for each pair of lags.
    ``value`` must not be null. Needs ``rn``.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg((F.max(RN) + 1).alias("n"))

    def step(d, w):
        d = d.withColumn("_l", F.lag(value).over(w))
        d = d.withColumn("_d", F.col(value) - F.col("_l"))
        return d.withColumns({f"_d{k}": F.lag("_d", k).over(w) for k in range(1, most + 1)})

    lagged = over_slices(df.select(*keys, RN, value), keys, [step], most + 1, rows=rows).join(sizes, keys)
    at = lambda k: F.col("_d" if k == 0 else f"_d{k}")
    edge = F.struct(F.col(RN).alias("t"), F.col("_d").alias("d"), F.col("_l").alias("l"))
    some = F.col("_d").isNotNull()
    zero = F.lit(0.0)
    total = lambda c: F.coalesce(F.sum(c), zero)
    return lagged.groupBy(*keys, "n").agg(
        total(F.col("_d")).alias("sum_d"), total(F.when(some, F.col("_l"))).alias("sum_l"),
        total(F.when(some, F.col("_l") * F.col("_l"))).alias("sum_ll"),
        F.array(*[total(F.col("_d") * at(k)) for k in range(most + 1)]).alias("c"),
        F.array(*[total(F.col("_l") * at(k)) for k in range(most + 1)]).alias("x"),
        F.array_sort(F.collect_list(F.when(some & (F.col(RN) <= most), edge))).alias("head"),
        F.array_sort(F.collect_list(F.when(some & (F.col(RN) >= F.col("n") - most), edge))).alias("tail"))


def adf_matrix(n: int, lag: int, sum_d, sum_l, sum_ll, c, x, head, tail) -> np.ndarray:
    """Products of (1, level, differences 1 to ``lag`` before, difference), over the rows that have them all."""
    d = {t: v for t, v, _ in head} | {t: v for t, v, _ in tail}
    level = {t: v for t, _, v in head}
    first = range(1, lag + 1)  # rows without all their lags
    m = np.zeros((lag + 3, lag + 3))
    place = {0: lag + 2} | {k: k + 1 for k in range(1, lag + 1)}
    m[0, 0] = n - 1 - lag
    m[0, 1] = sum_l - sum(level[t] for t in first)
    m[1, 1] = sum_ll - sum(level[t] ** 2 for t in first)
    for i in range(lag + 1):
        # Row t has the difference of t - i, which runs from lag + 1 - i to n - 1 - i.
        m[0, place[i]] = sum_d - sum(d[t] for t in range(1, lag + 1 - i)) - sum(d[t] for t in range(n - i, n))
        m[1, place[i]] = x[i] - sum(level[t] * d[t - i] for t in range(i + 1, lag + 1))
        for j in range(i, lag + 1):
            k = j - i
            ends = sum(d[t] * d[t - k] for t in range(k + 1, lag + 1 - i)) + sum(d[t] * d[t - k] for t in range(n - i, n))
            a, b = sorted((place[i], place[j]))
            m[a, b] = c[k] - ends
    return m + np.triu(m, 1).T


def adf_solution(m: np.ndarray) -> float | None:
    """t-statistic of the level."""
    xtx, xty, yty, n = m[:-1, :-1], m[:-1, -1], m[-1, -1], m[0, 0]
    dof = n - len(xtx)
    # Scale columns so that levels and differences weigh alike.
    scale = np.sqrt(np.diag(xtx))
    if dof <= 0 or not np.all(scale > 0):
        return None
    inv = np.linalg.pinv(xtx / np.outer(scale, scale))
    coef = inv @ (xty / scale)
    rss = max(yty - coef @ (xty / scale), 0.0)
    se = math.sqrt(rss / dof * inv[1, 1])
    return float(coef[1] / se) if se > 0 else None


def adf_statistic(
    df: DataFrame, keys: Sequence[str], value: str, max_lag: int | Column, rows: int = 16384, most: int | None = None
) -> DataFrame:
    """t-statistic of the lagged level in the augmented Dickey-Fuller regression, per key.

    ``max_lag`` is a number, or a column of the moments (such as one of ``n``) with at most ``most``: keys of
    different lags share the one pass over the rows. Only a key's few sums reach the solver. Needs ``rn``.
    """
    sums = adf_moments(df, keys, value, max_lag if most is None else most, rows)
    sums = sums.withColumn("used_lag", max_lag if isinstance(max_lag, Column) else F.lit(max_lag))
    plain = lambda edge: [(e["t"], e["d"], e["l"]) for e in edge]

    @F.pandas_udf("stat double, nobs long")
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows.itertuples(index=False):
            if r.n - 1 - r.used_lag < 1:
                out.append((None, max(r.n - 1 - r.used_lag, 0)))
                continue
            m = adf_matrix(r.n, r.used_lag, r.sum_d, r.sum_l, r.sum_ll, r.c, r.x, plain(r.head), plain(r.tail))
            out.append((adf_solution(m), int(m[0, 0])))
        return pd.DataFrame(out, columns=["stat", "nobs"])

    packed = F.struct("n", "used_lag", "sum_d", "sum_l", "sum_ll", "c", "x", "head", "tail")
    return sums.withColumn("_s", solve(packed)).select(*keys, "_s.stat", "used_lag", "_s.nobs")


def lag_of(n: Column) -> Column:
    """``schwert_lag`` as a column; fewer than 8 rows are an error."""
    fourth = F.floor(F.lit(12.0) * F.pow(n / 100.0, F.lit(0.25)) + F.lit(1e-9))
    lag = F.greatest(F.lit(0), F.least(fourth, F.floor((n - 1) / 2) - 2)).cast("int")
    return F.when(n < 8, F.raise_error(F.lit("a pair has fewer than 8 rows")).cast("int")).otherwise(lag)


def engle_granger(rows: DataFrame, max_lag: int | None = None, slice_rows: int = 16384) -> DataFrame:
    """Two-step cointegration test per pair: hedge fit, then ADF on the residual spread.

    Without ``max_lag`` each pair takes the lag its own length asks for; the sums go up to the longest
    pair's lag, which grows with the fourth root of the length. A pair of fewer than 8 rows is an error.
    """
    fit = keep(hedge_fit(rows, ["pair"]))
    spread = keep(add_spread(rows, fit, ["pair"]).select("pair", RN, "spread"))
    if max_lag is not None:
        adf = adf_statistic(spread, ["pair"], "spread", max_lag, slice_rows)
    else:
        sizes = spread.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
        most = sizes.agg(F.max(lag_of(F.col("n")))).first()[0] or 0
        adf = adf_statistic(spread, ["pair"], "spread", lag_of(F.col("n")), slice_rows, most)
    return fit.select("pair", "beta", "alpha").join(adf, "pair").withColumn(
        "cointegrated", F.col("stat") < RESIDUAL_CRITICAL[0.05]
    )
