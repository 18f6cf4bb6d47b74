"""Set-based rewrites against plain loops on random series, with slices far too small."""

import random

import pytest
from conftest import day
from pyspark.sql import functions as F

from tapeflow.functions.numeric import safe_corr
from tapeflow.operators import book, labels, pairs, portfolio, technical
from tapeflow.plans import ranges
from tapeflow.plans.ranges import RANGE, ranged
from tapeflow.plans.slices import RN, over_slices
from tapeflow.plans.tables import keep
from tapeflow.sources import snapshots


def ordered(df, *cols, key=RN):
    return [tuple(r[c] for c in cols) for r in sorted(df.collect(), key=lambda r: r[key])]


@pytest.mark.parametrize("seed", range(6))
def test_hysteresis(frame, seed):
    rng = random.Random(seed)
    v = [rng.choice([-0.5, -0.31, -0.3, -0.2, -0.15, 0.0, 0.1, 0.15, 0.2, 0.3, 0.31, 0.6]) for _ in range(150)]
    df = frame([("s", i, x) for i, x in enumerate(v)], "symbol string, rn bigint, v double")
    got = [s for (s,) in ordered(book.add_hysteresis(df, "v", rows=rng.choice([1, 4, 1000])), "state")]
    state, want = "BALANCED", []
    for x in v:
        if not ((state == "BUY PRESSURE" and x > 0.15) or (state == "SELL PRESSURE" and x < -0.15)):
            state = "BUY PRESSURE" if x > 0.3 else "SELL PRESSURE" if x < -0.3 else "BALANCED"
        want.append(state)
    assert got == want


@pytest.mark.parametrize("value,prev,want", [
    (0.4, 0.0, "BUY PRESSURE"), (0.2, 0.4, "BUY PRESSURE"), (0.1, 0.4, "BALANCED"),
    (-0.2, 0.4, "BALANCED"), (-0.4, 0.4, "SELL PRESSURE"),
])
def test_hysteresis_pinned(frame, value, prev, want):
    df = frame([("s", 0, prev), ("s", 1, value)], "symbol string, rn bigint, v double")
    assert ordered(book.add_hysteresis(df, "v"), "state")[1] == (want,)


def replay(z, entry, leave):
    cur, opened, out = 0.0, -1, []
    for i, x in enumerate(z):
        if cur == 0.0:
            if abs(x) > entry:
                cur, opened = (-1.0 if x > 0 else 1.0), i
        elif abs(x) < leave:
            cur, opened = 0.0, -1
        out.append((cur, opened))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_positions(frame, seed):
    rng = random.Random(seed)
    z = [rng.choice([-2.5, -2.0, -1.0, -0.4, 0.0, 0.3, 0.5, 1.2, 2.0, 2.6]) for _ in range(200)]
    df = keep(frame([("p", i, x) for i, x in enumerate(z)], "pair string, rn bigint, z double"))
    want = replay(z, 2.0, 0.5)
    for kw in ({"bounded": True}, {"rows": 1}, {"rows": 7}, {"rows": 50}):
        got = ordered(pairs.add_positions(df, ["pair"], 2.0, 0.5, **kw), "position", "trade_rn")
        assert got == want, kw


@pytest.mark.parametrize("z,want", [
    ([0, 2.5, 1, 0.3], [0, -1, -1, 0]), ([0, -2.5, -1, 0.1], [0, 1, 1, 0]),
])
def test_positions_pinned(frame, z, want):
    df = frame([("p", i, float(x)) for i, x in enumerate(z)], "pair string, rn bigint, z double")
    assert [p for (p,) in ordered(pairs.add_positions(df, ["pair"]), "position")] == want


def test_round_trip_pnl_pinned(frame):
    rows = [("p", 0, 0.0, 1.0, 0), ("p", 1, 1.0, 1.0, 0), ("p", 2, 2.0, 0.0, -1)]
    df = frame(rows, "pair string, rn bigint, spread double, position double, trade_rn bigint")
    got = pairs.trades(pairs.add_pair_pnl(df, ["pair"]), ["pair"], 0.1).collect()
    assert [round(r["trade_pnl"], 9) for r in got] == [1.9]


@pytest.mark.parametrize("seed", range(4))
def test_triple_barrier_and_grid(frame, seed):
    rng = random.Random(seed)
    n, h = 80, 5
    bars, p = [], 100.0
    for i in range(n):
        p *= 1 + rng.uniform(-0.05, 0.05)
        vol = None if rng.random() < 0.1 else rng.choice([0.0, 0.01, 0.03])
        bars.append(("s", i, p, p * (1 + rng.uniform(0, 0.03)), p * (1 - rng.uniform(0, 0.03)), vol))
    df = frame(bars, "symbol string, rn bigint, close double, high double, low double, atr_pct double")

    def want(t, pt, sl, h):
        if t + h >= n:
            return None
        _, _, c, _, _, vol = bars[t]
        vol = max(vol or 1e-4, 1e-4)
        for _, _, _, hi, lo, _ in bars[t + 1: t + h + 1]:
            if hi >= c * (1 + pt * vol):
                return 2.0
            if lo <= c * (1 - sl * vol):
                return 0.0
        return 1.0

    one = over_slices(df, ["symbol"], [labels.add_triple_barrier], 0, h, rows=9)
    assert [x for (x,) in ordered(one, "label")] == [want(t, 1.5, 1.0, h) for t in range(n)]
    grid = [(1.0, 0.75, 3), (2.0, 1.5, 7), (1.0, 1.5, 5)]
    many = over_slices(df, ["symbol"], [lambda d, w: labels.add_barrier_grid(d, w, grid)], 0, 7, rows=11)
    assert [x for (x,) in ordered(many, "labels")] == [[want(t, *g) for g in grid] for t in range(n)]


@pytest.mark.parametrize("seed", range(5))
def test_rsi_divergence(frame, seed):
    rng = random.Random(seed)
    n, k, hold = 160, 3, 5
    hi = [float(rng.randint(1, 12)) for _ in range(n)]
    lo = [x - rng.randint(1, 4) for x in hi]
    rsi = [None if i < 13 else rng.random() for i in range(n)]
    bull, bear, peaks, dips = [0.0] * n, [0.0] * n, [], []
    for t in range(2 * k, n):
        span = range(t - 2 * k, t + 1)
        if any(rsi[i] is None for i in span):
            continue
        mid = t - k
        if max(span, key=lambda i: (hi[i], -i)) == mid:
            if peaks and hi[mid] > peaks[-1][0] and rsi[mid] < peaks[-1][1]:
                bear[t] = 1.0
            peaks.append((hi[mid], rsi[mid]))
        if min(span, key=lambda i: (lo[i], i)) == mid:
            if dips and lo[mid] < dips[-1][0] and rsi[mid] > dips[-1][1]:
                bull[t] = 1.0
            dips.append((lo[mid], rsi[mid]))
    held = lambda x: [max(x[max(0, i - hold + 1): i + 1]) for i in range(n)]
    df = keep(frame([("s", i, hi[i], lo[i], rsi[i]) for i in range(n)],
                    "symbol string, rn bigint, high double, low double, rsi double"))
    for rows in (8, 1000):
        out = technical.add_rsi_divergence(df, rows=rows)
        assert ordered(out, "rsi_bull_div", "rsi_bear_div") == list(zip(held(bull), held(bear)))


def fifo(trades):
    lots, closed = [], []
    for t, (side, qty, price, fee, signal) in enumerate(trades):
        if side == "BUY":
            lots.append([qty, price, t, fee / qty, signal])
            continue
        left = qty
        while left > 1e-9:
            lot = lots[0]
            take = min(lot[0], left)
            closed.append((lot[2], t, round(take, 6), round(lot[3] * take, 6), round(fee / qty * take, 6)))
            lot[0] -= take
            left -= take
            if lot[0] <= 1e-9:
                lots.pop(0)
    return sorted(closed), sorted((b, round(q, 6)) for q, _, b, _, _ in lots)


TRADE = "symbol string, ts timestamp_ntz, seq int, side string, qty double, price double, fee double, signal string"


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("fractional", [False, True])
def test_fifo_matches_a_queue(frame, seed, fractional):
    rng = random.Random(seed)
    held, trades = 0.0, []
    for _ in range(120):
        qty = round(rng.uniform(0.1, 4), 2) if fractional else float(rng.randint(1, 5))
        if held >= qty and rng.random() < 0.5:
            trades.append(("SELL", qty, rng.uniform(50, 150), rng.uniform(0, 2), None))
            held = round(held - qty, 6)
        else:
            trades.append(("BUY", qty, rng.uniform(50, 150), rng.uniform(0, 2), "BUY"))
            held = round(held + qty, 6)
    # Several trades share a time: the input order decides.
    rows = [("s", day(i // 3), i, *t) for i, t in enumerate(trades)]
    run = keep(portfolio.with_running_quantity(frame(rows, TRADE), rows=rng.choice([7, 16384])))
    assert portfolio.oversold(run).count() == 0
    closed, open_lots = portfolio.match_fifo(run, rows=rng.choice([9, 16384]))
    want_closed, want_open = fifo(trades)
    price = {t[2]: i for i, t in enumerate(trades)}
    got = sorted((price[r["buy_price"]], price[r["sell_price"]], round(r["qty"], 6), round(r["buy_fee"], 6),
                  round(r["sell_fee"], 6)) for r in closed.collect())
    assert got == want_closed
    assert sorted((price[r["buy_price"]], round(r["qty"], 6)) for r in open_lots.collect()) == want_open


def test_fifo_pinned(frame):
    rows = [("x", day(0), 0, "BUY", 1.0, 100.0, 0.0, None), ("x", day(1), 1, "BUY", 1.0, 200.0, 0.0, None),
            ("x", day(2), 2, "SELL", 1.5, 300.0, 0.0, None), ("f", day(0), 0, "BUY", 2.0, 100.0, 2.0, "BUY"),
            ("f", day(1), 1, "SELL", 1.0, 110.0, 1.0, None)]
    closed, open_lots = portfolio.match_fifo(portfolio.with_running_quantity(frame(rows, TRADE)))
    got = sorted((r["symbol"], r["qty"], r["buy_price"]) for r in closed.collect())
    assert got == [("f", 1.0, 100.0), ("x", 0.5, 200.0), ("x", 1.0, 100.0)]
    fee = closed.where("symbol = 'f'").first()
    assert (fee["cost_basis"], fee["proceeds"], fee["pnl"], fee["hold_days"]) == (101.0, 109.0, 8.0, 1.0)
    assert [(r["qty"], r["buy_price"]) for r in open_lots.where("symbol = 'x'").collect()] == [(0.5, 200.0)]


def test_tiny_trades_of_a_busy_symbol_get_short_ranges(frame):
    """Nine tenths of the trades have a tiny quantity: ranges follow the trades' number."""
    rows = [("hot", day(0), i, "BUY" if i % 2 == 0 else "SELL", 0.001, 10.0, 0.0, None) for i in range(900)]
    rows += [("s", day(i), i, "BUY", 1000.0, 10.0, 0.0, None) for i in range(100)]
    run = keep(portfolio.with_running_quantity(frame(rows, TRADE), rows=50))
    assert run.groupBy(RANGE).count().agg(F.max("count")).first()[0] < 130
    lots = portfolio._lots(run, 50)
    closed, open_lots = portfolio.match_fifo(run, rows=50)
    assert closed.count() == 450 and open_lots.count() == 100
    edges = ranged(run.select("symbol", F.col("bought").alias("edge"), "seq"), ["symbol"], ["edge", "seq"], 50)
    assert edges.groupBy(RANGE).count().agg(F.max("count")).first()[0] < 130
    assert lots.count() == 550


def test_oversell_is_found_and_removed(frame):
    rows = [("bad", day(0), 0, "SELL", 1.0, 10.0, 0.0, None), ("bad", day(1), 1, "BUY", 5.0, 10.0, 0.0, None),
            ("ok", day(0), 0, "BUY", 1.0, 10.0, 0.0, None)]
    run = portfolio.with_running_quantity(frame(rows, TRADE))
    assert [(r["symbol"], r["worst_gap"]) for r in portfolio.oversold(run).collect()] == [("bad", 1.0)]
    assert {r["symbol"] for r in portfolio.without_oversold(run).collect()} == {"ok"}


def test_snapshots_fall_into_half_open_bars(frame):
    bars = frame([("s", day(i), i) for i in (1, 2, 4)], "symbol string, ts timestamp_ntz, i int").select(
        "symbol", "ts", F.when(F.col("i") == 4, 2).otherwise(F.col("i") - 1).cast("long").alias("rn"))
    snaps = [(0, 0), (0, 12), (1, 0), (1, 1), (2, 0), (3, 5), (4, 0), (4, 1)]
    hist = frame([("s", day(d, h)) for d, h in snaps], "symbol string, ts timestamp_ntz")
    got = {r["ts"]: r["bar_ts"] for r in book.assign_to_bars(hist, bars).collect()}
    # The first bar reaches back as far as the second bar is away.
    assert got == {day(0, 12): day(1), day(1): day(1), day(1, 1): day(2), day(2): day(2), day(3, 5): day(4), day(4): day(4)}


def test_correlation_with_equal_values_is_missing_however_they_are_dealt(spark):
    """Merged partitions of 49 equal values leave a deviation of about 1e-16."""
    df = spark.range(0, 147, 1, 3).unionByName(spark.range(7))
    x = F.col("id").cast("double")
    got = df.agg(safe_corr(x, F.lit(1.0)).alias("c"), safe_corr(F.lit(1.0), x).alias("d"), safe_corr(x, -x).alias("e")).first()
    assert (got["c"], got["d"]) == (None, None) and got["e"] == pytest.approx(-1.0)


def test_short_symbols_are_ordered_without_being_stored(frame, monkeypatch):
    stored = []

    def counted(df):
        stored.append(df.count())
        return keep(df)

    monkeypatch.setattr(ranges, "keep", counted)
    monkeypatch.setattr(portfolio, "keep", counted, raising=False)
    rows = [(f"s{i % 7}", day(i), i, "BUY" if i < 35 else "SELL", 1.0, 10.0, 0.0, None) for i in range(70)]
    closed, open_lots = portfolio.match_fifo(portfolio.without_oversold(portfolio.with_running_quantity(frame(rows, TRADE), rows=10)), rows=10)
    assert (closed.count(), open_lots.count()) == (35, 0)
    assert sum(stored) == 0


def test_short_and_long_symbols_are_judged_alike(frame):
    """Two symbols oversell, one in one piece, one in a late range; two do not."""
    rows = []
    for s, n in (("long", 90), ("long_bad", 90), ("short", 20), ("short_bad", 20)):
        sides = ["BUY" if i % 2 == 0 else "SELL" for i in range(n)]
        if s.endswith("bad"):
            sides[-2] = "SELL"
        rows += [(s, day(i), i, side, 1.0, 10.0 + i, 0.0, None) for i, side in enumerate(sides)]
    run = keep(portfolio.with_running_quantity(frame(rows, TRADE), rows=25))
    assert {r[0] for r in run.where(F.col(RANGE) == ranges.WHOLE).select("symbol").distinct().collect()} == {"short", "short_bad"}
    good = keep(portfolio.without_oversold(run))
    assert {r["symbol"]: r["count"] for r in good.groupBy("symbol").count().collect()} == {"long": 90, "short": 20}
    closed, open_lots = portfolio.match_fifo(good, rows=25)
    got = {(r["symbol"], r["n"], r["gain"]) for r in closed.groupBy("symbol").agg(F.count("*").alias("n"), F.sum("pnl").alias("gain")).collect()}
    assert got == {("long", 45, 45.0), ("short", 10, 10.0)} and open_lots.count() == 0


def test_levels_of_one_large_split_are_dealt_over_tasks(frame):
    rng = random.Random(3)
    rows = [("s", day(i % 3), rng.choice(["bid", "ask"]), float(rng.randint(1, 40)), 1.0 + i, i) for i in range(2000)]
    levels = frame(rows, "symbol string, ts timestamp_ntz, side string, price double, size double, seq bigint", 1)
    dealt = snapshots.deal_levels(levels, 100).groupBy(F.spark_partition_id()).count()
    assert dealt.agg(F.max("count")).first()[0] < 200
    got, want = ({(r["ts"], str(r["bids"]), str(r["asks"])) for r in snapshots.assemble_books(levels, rows=n).collect()} for n in (100, 10**6))
    assert got == want and len(want) == 3
