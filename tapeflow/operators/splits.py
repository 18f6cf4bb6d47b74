"""Split geometry as arithmetic on row positions: no range joins, no row copies to drop later."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def purged_end(train_start, train_end, test_start, horizon: int, embargo: int = 0) -> Column:
    """Train end without rows whose label window reaches into the test block."""
    if horizon < 0 or embargo < 0:
        raise ValueError("horizon and embargo must not be negative")
    cutoff = test_start - F.lit(horizon + embargo)
    return F.greatest(train_start, F.least(train_end, cutoff))


def add_segments(
    df: DataFrame, train: float = 0.60, val: float = 0.15, horizon: int = 5,
    embargo: int = 0, pass_on: bool = False, rn: str = "rn", total: str = "n",
) -> DataFrame:
    """Chronological train/val/test per symbol from position and row count.

    Rows at a segment's end whose labels reach past it read ``purged``;
    ``pass_on=True`` hands them to the following segment instead.
    """
    if not (0 < train < 1 and 0 < val < 1 and train + val < 1):
        raise ValueError("train and val must be in (0,1) and leave room for the test part")
    n, at = F.col(total), F.col(rn)
    a, b = F.floor(n * F.lit(train)), F.floor(n * F.lit(train + val))
    zero = F.lit(0).cast("long")
    pa = purged_end(zero, a, a, horizon, embargo)
    low = pa if pass_on else a
    pb = purged_end(a, b, b, horizon, embargo)
    segment = F.when(at < pa, "train")
    if not pass_on:
        segment = segment.when(at < a, "purged")
    segment = segment.when((at >= low) & (at < pb), "val")
    if not pass_on:
        segment = segment.when(at < b, "purged")
    return df.withColumn("segment", segment.otherwise("test"))


def segment_sizes(df: DataFrame, keys=("symbol",)) -> DataFrame:
    return df.groupBy(*keys, "segment").agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts")
    )


def walk_forward_windows(
    sizes: DataFrame, train: int, test: int, step: int | None = None, horizon: int = 0,
    embargo: int = 0,
) -> DataFrame:
    """Folds per symbol from (symbol, n): half-open train and test ranges, train purged."""
    step = step or test
    start = F.col("fold_id") * step
    end = start + train
    last = F.floor((F.col("n") - (train + test)) / step).cast("long")
    folds = sizes.where(F.col("n") >= train + test).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("fold_id")
    )
    new_end = purged_end(start, end, end, horizon, embargo)
    return folds.withColumns(
        {
            "train_start": start,
            "train_end": new_end,
            "n_purged": end - new_end,
            "test_start": end,
            "test_end": end + test,
        }
    )


def add_folds(
    df: DataFrame, train: int, test: int, step: int | None = None,
    horizon: int | Column = 0, embargo: int = 0, rn: str = "rn", total: str = "n",
) -> DataFrame:
    """One row per (row, fold, part). Which folds hold a row follows from its position.

    A row sits in at most ``ceil(train/step)`` train and ``ceil(test/step)`` test
    folds. ``horizon`` may be a column when variants of one frame look ahead differently.
    """
    step = step or test
    at, n = F.col(rn), F.col(total)
    top = F.floor((n - (train + test)) / step)
    zero = F.lit(0).cast("long")
    kept = F.lit(train - embargo) - (horizon if isinstance(horizon, Column) else F.lit(horizon))

    def span(first_row: int, size: Column) -> Column:
        lo = F.greatest(F.ceil((at - (first_row + size - 1)) / step), zero).cast("long")
        hi = F.least(F.floor((at - first_row) / step), top).cast("long")
        some = (size > 0) & (hi >= lo)
        return F.when(some, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))

    def tagged(folds: Column, part: str) -> Column:
        return F.transform(folds, lambda f: F.struct(f.alias("fold_id"), F.lit(part).alias("part")))

    both = F.concat(tagged(span(0, kept), "train"), tagged(span(train, F.lit(test)), "test"))
    return df.withColumn("_f", F.explode(both)).select("*", "_f.*").drop("_f")


# --- combinatorial purged cross-validation -----------------------------------------------


def n_paths(groups: int, k: int) -> int:
    if not 1 <= k < groups:
        raise ValueError(f"need 1 <= k < groups, got k={k}, groups={groups}")
    return comb(groups - 1, k - 1)


def path_table(groups: int, k: int) -> list[tuple[int, int, int]]:
    """(combo_id, group, path_id): the p-th test of a group belongs to path p."""
    n_paths(groups, k)
    seen = dict.fromkeys(range(groups), 0)
    out = []
    for combo_id, members in enumerate(combinations(range(groups), k)):
        for g in members:
            out.append((combo_id, g, seen[g]))
            seen[g] += 1
    return out


def group_start(g: Column, n: Column, groups: int) -> Column:
    return F.floor(g * n / F.lit(groups)).cast("long")


def add_group(df: DataFrame, groups: int, rn: str = "rn", total: str = "n") -> DataFrame:
    """The contiguous, near-equal group of each row.

    The quotient is off by at most one from the group whose floor bounds hold the
    row, so one comparison settles it.
    """
    guess = F.floor((F.col(rn) * groups) / F.col(total)).cast("long")
    nxt = group_start(guess + 1, F.col(total), groups)
    group = F.when(F.col(rn) >= nxt, guess + 1).otherwise(guess)
    return df.withColumn("group_id", F.least(group, F.lit(groups - 1)).cast("long"))


def combo_literal(groups: int, k: int) -> Column:
    """array<struct<combo_id, members array<struct<g, path>>>> built at plan time."""
    table: dict[int, list[tuple[int, int]]] = {}
    for combo_id, g, path in path_table(groups, k):
        table.setdefault(combo_id, []).append((g, path))
    return F.array(
        *[
            F.struct(
                F.lit(c).alias("combo_id"),
                F.array(
                    *[F.struct(F.lit(g).alias("g"), F.lit(p).alias("path")) for g, p in members]
                ).alias("members"),
            )
            for c, members in table.items()
        ]
    )


def add_cpcv_tests(df: DataFrame, groups: int, k: int, rn: str = "rn", total: str = "n") -> DataFrame:
    """One row per (row, combination that tests it), with its path: C(groups - 1, k - 1) rows a row, none made to be dropped."""
    own: dict[int, list[tuple[int, int]]] = {g: [] for g in range(groups)}
    for combo_id, g, path in path_table(groups, k):
        own[g].append((combo_id, path))
    tests = F.array(*[
        F.array(*[F.struct(F.lit(c).alias("combo_id"), F.lit(p).alias("path_id")) for c, p in own[g]]) for g in range(groups)])
    df = add_group(df, groups, rn, total)
    return df.select("*", F.inline(F.get(tests, F.col("group_id").cast("int"))))


def add_cpcv_roles(
    df: DataFrame, groups: int, k: int, horizon: int, embargo: int = 0, rn: str = "rn",
    total: str = "n",
) -> DataFrame:
    """One row per (row, combination) with its role: test (with path), purged or train.

    A train row is purged when its label reaches a test group or when it follows one
    within the embargo. Keep the frame narrow: it grows by C(groups, k).
    """
    if horizon < 0 or embargo < 0:
        raise ValueError("horizon and embargo must not be negative")
    at, n = F.col(rn), F.col(total)
    df = add_group(df, groups, rn, total)
    df = df.withColumn("_c", F.explode(combo_literal(groups, k)))
    members = F.col("_c.members")
    own = F.filter(members, lambda m: m.g == F.col("group_id"))
    near = F.exists(
        members,
        lambda m: (at >= group_start(m.g, n, groups) - horizon)
        & (at < group_start(m.g + 1, n, groups) + embargo),
    )
    path = F.when(F.size(own) > 0, F.try_element_at(own, F.lit(1)).getField("path"))
    role = F.when(F.size(own) > 0, "test").when(near, "purged").otherwise("train")
    return df.withColumns(
        {"combo_id": F.col("_c.combo_id"), "role": role, "path_id": path}
    ).drop("_c")
