"""Feature-table queries: all families together."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeflow.config import FeatureSpec, MICRO
from tapeflow.operators.book import signals
from tapeflow.plans.features import Inputs, bar_features, engineer, select_features
from tapeflow.plans.tables import keep
from tapeflow.queries.context import WORDS
from tapeflow.queries.registry import (
    DAILY, HOURLY, daily, hourly, query, rs, show,
)
from tapeflow.queries.prices import MICRO_CTE
from tapeflow.sources import tables

_PLAIN = ("ret_1d", "ret_5d", "ret_10d", "bb_pband", "vol_chg", "vol_ratio", "sma50_dist")
_SQL = f"""WITH {MICRO_CTE}
  SELECT symbol, ts, {rs(**{c: c for c in (*_PLAIN, *MICRO, 'target')})} FROM m3
  WHERE {' AND '.join(f'{c} IS NOT NULL' for c in (*_PLAIN, *MICRO, 'target'))}"""


@query("feature_table", _SQL)
def feature_table(spark, sf):
    """The complete table; columns that need no recursion are compared."""
    return show(engineer(hourly(spark, sf), FeatureSpec(micro=True)), *_PLAIN, *MICRO, "target")


_DAILY_CTE = MICRO_CTE.replace(HOURLY, f"{DAILY}, hourly AS (SELECT * FROM daily)")


@query("technical_features", f"""WITH {_DAILY_CTE} SELECT symbol, ts, {rs(**{c: c for c in (*_PLAIN, 'target')})} FROM m3
  WHERE {' AND '.join(f'{c} IS NOT NULL' for c in (*_PLAIN, 'target'))}""")
def technical_features(spark, sf):
    """Daily bars with smoothing; columns that need no recursion are compared."""
    out = select_features(engineer(daily(spark, sf), FeatureSpec(smooth=True)), FeatureSpec(smooth=True))
    return show(out, *_PLAIN, "target")


EVERYTHING = FeatureSpec(news=True, micro=True, cross_asset=True, smooth=True, reference=True, orderbook=True,
                         macro_events=True, social=True)


@query("all_families")
def all_families(spark, sf):
    """Every family at once on hourly bars; news, posts, events, series and books are of the same month and symbols."""
    history = keep(signals(tables.january_books(spark, sf)))
    side = Inputs("purchase", ("click", "view", "error"), "click", tables.january_reference(spark, sf), history,
                  tables.january_calendar(spark, sf), tables.posts(spark, sf), tables.news(spark, sf), WORDS)
    return select_features(engineer(hourly(spark, sf), EVERYTHING, side), EVERYTHING)


@query("live_features", f"""WITH {MICRO_CTE} SELECT symbol, ts, {rs(**{c: c for c in _PLAIN})} FROM m3
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1""")
def live_features(spark, sf):
    """The newest row per symbol, target not required; columns that need no recursion are compared."""
    df = engineer(hourly(spark, sf), FeatureSpec(), drop_incomplete=False)
    cols = FeatureSpec().columns()
    last = df.groupBy("symbol").agg(F.max_by(F.struct("ts", "close", *cols), "rn").alias("l"))
    return show(last.select("symbol", "l.*"), *_PLAIN)


@query("projected_families", f"""WITH {HOURLY} SELECT symbol, ts, {rs(hl_range='(high - low) / nullif(close, 0)')} FROM hourly""")
def projected_families(spark, sf):
    """Asking for one column prunes the rest of the plan."""
    return show(bar_features(hourly(spark, sf), FeatureSpec(micro=True)), "hl_range")
