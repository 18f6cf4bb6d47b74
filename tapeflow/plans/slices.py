"""Ordered work over long series without one task per series.

One symbol may hold a third of all rows, so no window here spans a whole symbol.
Three tools replace such windows:

* ``number_rows`` - dense row positions from per-bucket counts and a prefix sum
  over the (small) bucket table;
* ``over_slices`` - cuts each series into slices of a fixed number of rows, copies
  the look-back and look-ahead rows each slice needs from its neighbours (the
  halo), runs bounded windows inside the slices and drops the copies;
* ``running`` - unbounded running values (sum, max, last known) from a local
  window per bucket plus the carried value of all earlier buckets.

Bucket tables are joined back on (keys, bucket), never on the bare key, so a hot
key spreads over as many tasks as it has buckets. No broadcast is forced; AQE
broadcasts the bucket side when its measured size allows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tapeflow.functions.times import epoch_seconds

RN = "rn"
SLICE = "_slice"
_OWN = "_own"
_B = "_bucket"

Step = Callable[[DataFrame, WindowSpec], DataFrame]


def time_bucket(ts: Column, days: float) -> Column:
    """Bucket number of a timestamp; ``days`` sets how many rows one task orders."""
    return F.floor(epoch_seconds(ts) / F.lit(days * 86400.0)).cast("long")


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    name: str = RN,
    total: str | None = None,
) -> DataFrame:
    """Add the 0-based position of each row within its key, and optionally the key's row count.

    ``bucket`` must never decrease along ``order`` and ``order`` must be unique per key.
    """
    df = df.withColumn(_B, bucket)
    sizes = df.groupBy(*keys, _B).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")]
    if total:
        cols.append(F.sum("_n").over(whole).alias(total))
    offsets = sizes.select(*keys, _B, *cols)
    local = F.row_number().over(Window.partitionBy(*keys, _B).orderBy(*order)) - 1
    return (
        df.withColumn("_i", local)
        .join(offsets, [*keys, _B])
        .withColumn(name, (F.col("_i") + F.col("_off")).cast("long"))
        .drop("_i", "_off", _B)
    )


def over_slices(
    df: DataFrame,
    keys: Sequence[str],
    steps: Sequence[Step],
    back: int,
    ahead: int = 0,
    rows: int = 16384,
) -> DataFrame:
    """Run window steps that look at most ``back`` rows behind and ``ahead`` rows on.

    ``df`` needs the dense position column ``rn``. Nested windows add up: pass the
    composed depth. Each row is copied at most ``ceil((back+ahead)/rows)`` times.
    """
    first = F.floor(F.greatest(F.col(RN) - ahead, F.lit(0)) / rows).cast("long")
    last = F.floor((F.col(RN) + back) / rows).cast("long")
    home = F.floor(F.col(RN) / rows).cast("long")
    out = df.withColumn(SLICE, F.explode(F.sequence(first, last))).withColumn(
        _OWN, F.col(SLICE) == home
    )
    w = Window.partitionBy(*keys, SLICE).orderBy(RN)
    for step in steps:
        out = step(out, w)
    return out.where(F.col(_OWN)).drop(SLICE, _OWN)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column | str,
    measures: dict[str, tuple[str, Column]],
) -> DataFrame:
    """Running values over a whole key: ``{out: (kind, column)}``.

    Kinds: ``sum``, ``max`` and ``min`` up to the row; ``last`` non-null value up to
    the row and ``before`` it; ``next`` non-null value from the row on. All measures
    share one pass over the bucket ends, so ask for them together. The input is read
    twice (rows and bucket ends): pass a stored table, see ``plans.tables.keep``. A bucket
    given by a column's name stays, and the result lies by (keys, bucket) for the next step.
    """
    b = bucket if isinstance(bucket, str) else _B
    if b == _B:
        df = df.withColumn(_B, bucket)
    df = df.withColumns({f"_v_{n}": c for n, (_, c) in measures.items()})
    whole, part = Window.partitionBy(*keys), Window.partitionBy(*keys, b)
    up = [F.col(c).asc() for c in order]
    down = [F.col(c).desc() for c in order]
    start = Window.unboundedPreceding
    aggs, prefix, here, merged = [], [], {}, {}
    for n, (kind, _) in measures.items():
        v, t, p, h = F.col(f"_v_{n}"), f"_t_{n}", f"_p_{n}", f"_h_{n}"
        local = part.orderBy(*(down if kind == "next" else up)).rowsBetween(
            start, -1 if kind == "before" else 0
        )
        carry = whole.orderBy(F.col(b).desc() if kind == "next" else F.col(b)).rowsBetween(start, -1)
        if kind in ("last", "before", "next"):
            packed = F.when(v.isNotNull(), F.struct(*order, v.alias("v")))
            pick = F.min(packed) if kind == "next" else F.max(packed)
            aggs.append(pick.getField("v").alias(t))
            prefix.append(F.last(t, ignorenulls=True).over(carry).alias(p))
            here[h] = F.last(v, ignorenulls=True).over(local)
            merged[n] = F.coalesce(F.col(h), F.col(p))
        elif kind == "sum":
            aggs.append(F.sum(v).alias(t))
            prefix.append(F.sum(t).over(carry).alias(p))
            here[h] = F.sum(v).over(local)
            zero = F.lit(0)
            merged[n] = F.coalesce(F.col(h), zero) + F.coalesce(F.col(p), zero)
        elif kind in ("max", "min"):
            f, both = (F.max, F.greatest) if kind == "max" else (F.min, F.least)
            aggs.append(f(v).alias(t))
            prefix.append(f(t).over(carry).alias(p))
            here[h] = f(v).over(local)
            merged[n] = both(F.col(h), F.col(p))
        else:
            raise ValueError(f"unknown running kind {kind!r}")
    ends = df.groupBy(*keys, b).agg(*aggs).select(*keys, b, *prefix)
    out = df.withColumns(here).join(ends, [*keys, b]).withColumns(merged)
    spare = [_B, *(f"{x}{n}" for n in measures for x in ("_v_", "_p_", "_h_"))]
    return out.drop(*spare)


def rn_bucket(rows: int = 16384) -> Column:
    """Bucket of a numbered row, for ``running`` after ``number_rows``."""
    return F.floor(F.col(RN) / rows).cast("long")
