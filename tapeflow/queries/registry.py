"""The query register and the SQL fragments that several twins share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeflow.plans.slices import number_rows, time_bucket
from tapeflow.plans.tables import keep
from tapeflow.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is its DuckDB twin, if SQL can say it."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# Compared values are nudged by 1e-11 of their size before rounding. Decimal ties such
# as 0.0000125 then round the same way in both engines, whatever their last bit.
NUDGE = 1.00000000001


def r6(c):
    """Six digits for comparison, without the sign of zero."""
    return F.round(c * F.lit(NUDGE), 6) + F.lit(0.0)


def show(df: DataFrame, *cols: str, keys=("symbol", "ts")) -> DataFrame:
    """Keys plus rounded measures."""
    return df.select(*keys, *[r6(F.col(c)).alias(c) for c in cols])


def numbered(bars: DataFrame, days: float = 365.0) -> DataFrame:
    """Stored bars with their position; hourly bars put at most 8760 rows in a bucket."""
    return number_rows(keep(bars), ["symbol"], ["ts"], time_bucket(F.col("ts"), days))


def hourly(spark, sf):
    return numbered(tables.hourly_bars(spark, sf))


def daily(spark, sf):
    return numbered(tables.daily_bars(spark, sf), days=3650.0)


def brands(spark, sf):
    return numbered(tables.brand_bars(spark, sf), days=3650.0)


# --- DuckDB side ---------------------------------------------------------------

HOURLY = """hourly AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts,
         first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume
  FROM events GROUP BY 1, 2)"""
DAILY = """daily AS (
  SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS ts,
         first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS open,
         max(o_totalprice) AS high, min(o_totalprice) AS low,
         last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS close,
         count(*)::DOUBLE AS volume
  FROM orders GROUP BY 1, 2)"""
BRAND = """brand AS (
  SELECT p_brand AS symbol, date_trunc('day', l_shipdate)::TIMESTAMP AS ts,
         first(l_extendedprice / l_quantity
               ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS open,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         last(l_extendedprice / l_quantity
              ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS close,
         sum(l_quantity) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def r(expr: str) -> str:
    """SQL form of ``r6``."""
    return f"(round(({expr}) * {NUDGE}::DOUBLE, 6) + 0.0)"


def rs(**exprs: str) -> str:
    return ", ".join(f"{r(e)} AS {n}" for n, e in exprs.items())


def win(n: int, part: str = "symbol", order: str = "ts") -> str:
    return (
        f"(PARTITION BY {part} ORDER BY {order} "
        f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    )


ORD = "(PARTITION BY symbol ORDER BY ts)"


def gate(agg: str, x: str, n: int, need: int | None = None, part: str = "symbol") -> str:
    """A trailing aggregate that is NULL until enough inputs are present."""
    f = win(n, part)
    return f"CASE WHEN count({x}) OVER {f} >= {need or n} THEN {agg}({x}) OVER {f} END"


def zscore(x: str, n: int, need: int | None = None, part: str = "symbol") -> str:
    return f"(({x}) - ({gate('avg', x, n, need, part)})) / nullif({gate('stddev_samp', x, n, need, part)}, 0)"
