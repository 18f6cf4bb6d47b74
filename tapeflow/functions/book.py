"""Order-book measures over level arrays, best level first, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeflow.functions.numeric import div


@dataclass(frozen=True)
class BookRules:
    """How a book is read. The published thresholds."""

    imbalance_levels: int = 20
    wall_levels: int = 50
    wall_factor: float = 3.0
    enter: float = 0.3
    leave: float = 0.15
    alpha: float = 0.3
    min_side_levels: int = 5
    thin_ratio: float = 0.02

    def __post_init__(self):
        # The running form of the hysteresis takes the last crossing as the state.
        if self.leave > self.enter:
            raise ValueError(f"a state entered past {self.enter} can't be left above it, at {self.leave}")

    @property
    def depth(self) -> int:
        """Levels a stored book must keep so that every measure sees all it reads."""
        return max(self.imbalance_levels, self.wall_levels, self.min_side_levels)


BOOK = BookRules()


def side_volume(side: str, levels: int) -> Column:
    return F.aggregate(
        F.slice(F.coalesce(side, F.array()), 1, levels), F.lit(0.0), lambda a, x: a + x["size"]
    )


def imbalance_of(bid: Column, ask: Column) -> Column:
    """Bid minus ask volume over their sum, 0 for an empty book."""
    return F.coalesce(div(bid - ask, bid + ask), F.lit(0.0))


def imbalance(rules: BookRules = BOOK) -> Column:
    n = rules.imbalance_levels
    return imbalance_of(side_volume("bids", n), side_volume("asks", n))


def best(side: str, field: str = "price") -> Column:
    return F.try_element_at(F.col(side), F.lit(1)).getField(field)


def mid_of(bid: Column, ask: Column) -> Column:
    """Middle of the best prices; the one side there is; 0 for an empty book."""
    return F.coalesce((bid + ask) / 2.0, bid, ask, F.lit(0.0))


def mid_price() -> Column:
    return mid_of(best("bids"), best("asks"))


def abs_spread() -> Column:
    return F.coalesce(best("asks") - best("bids"), F.lit(0.0))


def rel_spread_of(bid: Column, ask: Column, mid: Column) -> Column:
    two_sided = bid.isNotNull() & ask.isNotNull() & (mid > 0)
    return F.when(two_sided, div(ask - bid, mid)).otherwise(F.lit(0.0))


def rel_spread() -> Column:
    return rel_spread_of(best("bids"), best("asks"), mid_price())


def walls(side: str, rules: BookRules = BOOK) -> Column:
    """Levels whose size is above ``wall_factor`` times the side's mean."""
    top = F.slice(F.coalesce(side, F.array()), 1, rules.wall_levels)
    mean = div(F.aggregate(top, F.lit(0.0), lambda a, x: a + x["size"]), F.size(top))
    # The limit is bound once per book; inside the filter it would be summed per level.
    limit = F.array(mean * rules.wall_factor)
    found = F.transform(limit, lambda m: F.filter(top, lambda x: x["size"] > m))
    return F.element_at(found, 1)


def microprice_of(bid: Column, ask: Column, mid: Column) -> Column:
    """Best prices weighted by the opposite side's size; the mid price as fallback."""
    bv, av = bid["size"], ask["size"]
    return F.coalesce(div(bid.price * av + ask.price * bv, bv + av), mid)


def microprice() -> Column:
    b, a = (F.try_element_at(F.col(c), F.lit(1)) for c in ("bids", "asks"))
    return microprice_of(b, a, mid_price())


def micro_skew() -> Column:
    mid = mid_price()
    return F.when(mid > 0, div(microprice() - mid, mid)).otherwise(F.lit(0.0))


def reliable_of(bid: Column, ask: Column, n_bid: Column, n_ask: Column, rules: BookRules) -> Column:
    """Deep enough on both sides, and the weaker side holds its minimum share."""
    deep = (n_bid >= rules.min_side_levels) & (n_ask >= rules.min_side_levels)
    share = div(F.least(bid, ask), bid + ask)
    return deep & (bid + ask > 0) & F.coalesce(share >= rules.thin_ratio, F.lit(False))


def reliable(rules: BookRules = BOOK) -> Column:
    n = rules.imbalance_levels
    return reliable_of(
        side_volume("bids", n), side_volume("asks", n),
        F.size(F.coalesce("bids", F.array())), F.size(F.coalesce("asks", F.array())), rules,
    )


def pressure(value: Column, rules: BookRules = BOOK) -> Column:
    return (
        F.when(value > rules.enter, "BUY PRESSURE")
        .when(value < -rules.enter, "SELL PRESSURE")
        .otherwise("BALANCED")
    )


def confidence(value: Column) -> Column:
    return F.least(F.abs(value) * 100.0, F.lit(100.0))
