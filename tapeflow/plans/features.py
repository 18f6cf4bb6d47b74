"""The feature table: every requested family over all symbols as one plan."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from tapeflow import config
from tapeflow.config import HORIZON, FeatureSpec
from tapeflow.operators import book, cross_asset, events, micro, news, reference, smoothing, social
from tapeflow.operators import technical as tech
from tapeflow.operators.validate import SchemaError, check_columns, complete_rows
from tapeflow.plans.slices import over_slices
from tapeflow.plans.tables import keep

KEYS = ["symbol"]


@dataclass(frozen=True)
class Inputs:
    """Side tables of the optional families; a missing one gives neutral columns."""

    pair: str | None = None
    basket: tuple[str, ...] = ()
    lead: str | None = None
    reference: DataFrame | None = None
    book_history: DataFrame | None = None
    calendar: DataFrame | None = None
    posts: DataFrame | None = None
    news: DataFrame | None = None
    lexicon: dict[str, Any] | None = None


def bar_features(bars: DataFrame, spec: FeatureSpec, horizon: int = HORIZON) -> DataFrame:
    """All families that need only the symbol's own bars: one shuffle, one sort.

    Every step shares the window spec, so the physical plan is a single exchange
    followed by stacked windows over the same order. Needs ``rn``.
    """
    check_columns(bars)
    steps = [
        tech.add_returns, tech.add_rsi, tech.mark_swings, tech.add_macd, tech.add_bollinger,
        tech.add_atr, tech.add_volume, tech.add_ma_distances,
    ]
    if spec.smooth:
        steps.append(smoothing.add_smoothing)
    if spec.micro:
        steps.append(micro.add_micro)
    steps.append(lambda df, w: tech.add_target(df, w, horizon))
    return over_slices(bars, KEYS, steps, tech.SMOOTH_BACK, horizon, tech.SMOOTH_ROWS)


def engineer(
    bars: DataFrame, spec: FeatureSpec, inputs: Inputs = Inputs(), horizon: int = HORIZON,
    drop_incomplete: bool = True,
) -> DataFrame:
    """Numbered bars to the feature table with its target.

    The bar families are stored once. Every other family starts from the stored bars
    and meets the table on (symbol, ts), so work grows with the number of families
    and a hot symbol spreads over its times. Only a family's own columns are
    zero-filled. ``drop_incomplete=False`` keeps the newest rows, whose target is not
    known yet.
    """
    stored = keep(bar_features(bars, spec, horizon))
    slim = stored.select("symbol", "ts", "rn", "close", "volume")
    families: list[tuple[DataFrame, tuple[str, ...]]] = []
    if spec.cross_asset:
        if not (inputs.pair and inputs.lead):
            raise ValueError("cross-asset features need a pair, a basket and its lead")
        crossed = cross_asset.add_cross_asset(slim, inputs.pair, inputs.basket, inputs.lead)
        families.append((crossed, config.CROSS_ASSET))
    if spec.reference:
        if inputs.reference is None:
            raise ValueError("reference features need the series table")
        families.append((reference.add_reference(slim, inputs.reference), config.REFERENCE_NAMES))
    if spec.orderbook:
        families.append((book.add_book_features(slim, inputs.book_history), config.ORDER_BOOK))
    if spec.macro_events:
        families.append((events.add_events(slim, inputs.calendar), config.MACRO_EVENTS))
    if spec.social:
        posted = social.add_social(slim, inputs.posts, lexicon=inputs.lexicon)
        families.append((posted, config.SOCIAL))
    if spec.news:
        if inputs.news is None:
            raise ValueError("news features need the news table")
        daily = news.daily_sentiment(news.score_news(inputs.news, inputs.lexicon))
        families.append((news.merge_news(slim, daily), config.NEWS))
    df = tech.add_rsi_divergence(stored, marked=True)
    for family, cols in families:
        df = df.join(family.select("symbol", "ts", *cols), ["symbol", "ts"])
    if drop_incomplete:
        df = complete_rows(df, [*spec.columns(), "target"])
    return df


def select_features(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Keys, the requested feature columns and the target; an absent column is an error."""
    missing = [c for c in spec.columns() if c not in df.columns]
    if missing:
        raise SchemaError(f"Missing feature columns: {missing}")
    return df.select("symbol", "ts", *spec.columns(), "target")
