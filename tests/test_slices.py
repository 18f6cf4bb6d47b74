"""Slices, row numbers and running values must not depend on how rows are cut or spread."""

import random

import pytest
from conftest import day
from pyspark.sql import functions as F

from tapeflow.functions.rolling import add_ema, ema_reach, ema_span_limit
from tapeflow.operators.asof import align_days, asof_join
from tapeflow.operators.validate import exact_quantiles
from tapeflow.plans.slices import RN, number_rows, over_slices, rn_bucket, running, time_bucket
from tapeflow.plans.tables import keep


@pytest.fixture(scope="module")
def series(frame):
    """A hot symbol with nine tenths of the rows, gaps in time, and some nulls."""
    rng = random.Random(5)
    rows = []
    for sym, n in (("hot", 900), ("a", 70), ("b", 1)):
        at = 0
        for _ in range(n):
            at += rng.randint(1, 5)
            value = None if rng.random() < 0.1 else round(rng.uniform(-9, 9), 3)
            rows.append((sym, day(0, at), value))
    return frame(rows, "symbol string, ts timestamp_ntz, v double", 6)


def by_symbol(df, *cols):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["symbol"], r["ts"])):
        out.setdefault(r["symbol"], []).append(tuple(r[c] for c in cols))
    return out


@pytest.mark.parametrize("days", [0.5, 7.0, 3650.0])
def test_row_numbers_are_dense(series, days):
    df = number_rows(series, ["symbol"], ["ts"], time_bucket(F.col("ts"), days), total="n")
    for rows in by_symbol(df, RN, "n").values():
        assert [r for r, _ in rows] == list(range(len(rows)))
        assert {n for _, n in rows} == {len(rows)}


@pytest.fixture(scope="module")
def numbered(series):
    return keep(number_rows(series, ["symbol"], ["ts"], time_bucket(F.col("ts"), 3.0)))


@pytest.mark.parametrize("rows", [3, 10, 64, 10_000])
def test_bounded_windows_equal_the_whole_series(numbered, rows):
    def step(df, w):
        return df.withColumns(
            {
                "m": F.sum("v").over(w.rowsBetween(-9, 0)),
                "back": F.lag("v", 10).over(w),
                "on": F.lead("v", 4).over(w),
            }
        )

    got = by_symbol(over_slices(numbered, ["symbol"], [step], 10, 4, rows), "v", "m", "back", "on")
    for cells in got.values():
        v = [c[0] for c in cells]
        for i, (_, m, back, on) in enumerate(cells):
            known = [x for x in v[max(0, i - 9): i + 1] if x is not None]
            assert (m is None) == (not known)
            assert not known or m == pytest.approx(sum(known), abs=1e-9)
            assert back == (v[i - 10] if i >= 10 else None)
            assert on == (v[i + 4] if i + 4 < len(v) else None)


@pytest.mark.parametrize("rows", [1, 7, 10_000])
def test_running_values_carry_over_buckets(numbered, rows):
    df = running(
        numbered, ["symbol"], [RN], rn_bucket(rows),
        {
            "total": ("sum", F.col("v")), "top": ("max", F.col("v")), "low": ("min", F.col("v")),
            "last": ("last", F.col("v")), "before": ("before", F.col("v")), "next": ("next", F.col("v")),
        },
    )
    for cells in by_symbol(df, "v", "total", "top", "low", "last", "before", "next").values():
        v = [c[0] for c in cells]
        for i, (_, total, top, low, last, before, nxt) in enumerate(cells):
            seen = [x for x in v[: i + 1] if x is not None]
            earlier = [x for x in v[:i] if x is not None]
            later = [x for x in v[i:] if x is not None]
            assert total == pytest.approx(sum(seen), abs=1e-9)
            assert top == (max(seen) if seen else None)
            assert low == (min(seen) if seen else None)
            assert last == (seen[-1] if seen else None)
            assert before == (earlier[-1] if earlier else None)
            assert nxt == (later[0] if later else None)


@pytest.mark.parametrize("alpha", [0.3, 1 / 14, 2 / 27])
def test_ema_equals_the_recurrence_in_any_slicing(spark, frame, alpha):
    rng = random.Random(1)
    x = [rng.uniform(50, 500) for _ in range(1500)]
    df = frame([("s", day(i), i, p) for i, p in enumerate(x)], "symbol string, ts timestamp_ntz, rn bigint, x double")
    want, y = [], None
    for p in x:
        y = p if y is None else alpha * p + (1 - alpha) * y
        want.append(y)
    back = ema_reach(alpha)
    for rows in (97, max(1, ema_span_limit(alpha) - back)):
        out = over_slices(df, ["symbol"], [lambda d, w: add_ema(d, w, "x", "y", alpha)], back, rows=rows)
        got = [r["y"] for r in sorted(out.collect(), key=lambda r: r["rn"])]
        assert max(abs(a - b) / b for a, b in zip(got, want)) < 1e-12


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("days", [0.2, 30.0])
def test_asof_join_equals_a_search(frame, forward, days):
    rng = random.Random(3)
    left = [("s", day(0, rng.randint(0, 400)), i) for i in range(120)]
    times = sorted(rng.sample(range(0, 400), 40))
    right = [("s", day(0, t), t, None if t % 5 == 0 else float(t)) for t in times]
    l = frame(left, "symbol string, ts timestamp_ntz, id int")
    r = frame(right, "symbol string, ts timestamp_ntz, at int, value double")
    got = asof_join(l, r, ["symbol"], "ts", ["at", "value"], time_bucket(F.col("ts"), days), forward=forward)
    for row in got.collect():
        hour = int((row["ts"] - day(0)).total_seconds() // 3600)
        ok = [t for t in times if (t >= hour if forward else t <= hour)]
        want = (min(ok) if forward else max(ok)) if ok else None
        assert (row["match"]["at"] if row["match"] else None) == want
        if want is not None:
            # A null inside the matched row stays null.
            assert row["match"]["value"] == (None if want % 5 == 0 else float(want))


def test_align_days_keeps_the_latest_null(frame):
    import datetime as dt

    d = lambda i: dt.date(2024, 1, i)
    series = frame([("s", d(1), 1.0), ("s", d(3), None)], "name string, d date, value double")
    days = frame([("s", d(i)) for i in (1, 2, 3, 4)], "name string, d date")
    got = {r["d"].day: r["value"] for r in align_days(series, days, ["name"]).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: None, 4: None}


def test_exact_quantiles_match_numpy_with_a_hot_key(frame):
    import numpy as np

    rng = np.random.default_rng(0)
    big = np.concatenate([rng.lognormal(0, 3, 2000), np.full(500, 7.0)])
    rows = [("hot", float(x)) for x in big] + [("one", 3.0)]
    got = {r["k"]: r for r in exact_quantiles(frame(rows, "k string, x double"), "k", ["x"], [0.005, 0.5, 0.995]).collect()}
    for i, p in enumerate((0.005, 0.5, 0.995)):
        assert got["hot"][f"q{i}"] == pytest.approx(float(np.quantile(big, p)), rel=1e-12)
        assert got["one"][f"q{i}"] == 3.0
