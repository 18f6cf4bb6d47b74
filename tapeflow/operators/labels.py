"""Forward-looking labels. Codes: 0 SELL, 1 HOLD, 2 BUY; NULL where the future is missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tapeflow.config import BUY, HOLD, HORIZON, SELL
from tapeflow.functions.numeric import change

MIN_VOL = 1e-4


def forward_return(w: WindowSpec, h: int = HORIZON) -> Column:
    return change(F.lead("close", h).over(w), F.col("close"))


def add_fixed_labels(
    df: DataFrame, w: WindowSpec, h: int = HORIZON, threshold: float = 0.0,
    vol: str | None = "atr_pct", out: str = "label",
) -> DataFrame:
    """Direction of the h-bar return; inside the band it is HOLD.

    With ``vol`` the band is threshold times that column, otherwise the threshold
    itself. A missing volatility compares as neither up nor down.
    """
    band = F.lit(threshold) * F.col(vol) if vol else F.lit(float(threshold))
    df = df.withColumn("_fwd", forward_return(w, h))
    label = (
        F.when(F.col("_fwd").isNull(), F.lit(None))
        .when(F.col("_fwd") > band, F.lit(BUY))
        .when(F.col("_fwd") < -band, F.lit(SELL))
        .otherwise(F.lit(HOLD))
    )
    return df.withColumn(out, label.cast("double")).drop("_fwd")


def _floor_vol(vol: Column) -> Column:
    return F.coalesce(F.greatest(vol, F.lit(MIN_VOL)), F.lit(MIN_VOL))


def barrier_label(
    highs: Sequence[Column], lows: Sequence[Column], last_close: Column, close: Column,
    vol: Column, pt: float, sl: float,
) -> Column:
    """First barrier touched along the path; the upper one wins inside one bar."""
    up, down = close * (1.0 + pt * vol), close * (1.0 - sl * vol)
    label = F.when(last_close.isNull(), F.lit(None))
    for hi, lo in zip(highs, lows):
        label = label.when(hi >= up, F.lit(BUY)).when(lo <= down, F.lit(SELL))
    return label.otherwise(F.lit(HOLD)).cast("double")


def add_triple_barrier(
    df: DataFrame, w: WindowSpec, h: int = HORIZON, pt: float = 1.5, sl: float = 1.0,
    vol: str = "atr_pct", out: str = "label",
) -> DataFrame:
    """Profit, stop or time-out within h bars, as a short chain over leads.

    Look-ahead is ``h`` rows: run it with ``over_slices(..., ahead=h)``.
    """
    leads = {f"_hi{i}": F.lead("high", i).over(w) for i in range(1, h + 1)}
    leads |= {f"_lo{i}": F.lead("low", i).over(w) for i in range(1, h + 1)}
    leads["_end"] = F.lead("close", h).over(w)
    df = df.withColumns(leads)
    label = barrier_label(
        [F.col(f"_hi{i}") for i in range(1, h + 1)],
        [F.col(f"_lo{i}") for i in range(1, h + 1)],
        F.col("_end"), F.col("close"), _floor_vol(F.col(vol)), pt, sl,
    )
    return df.withColumn(out, label).drop(*leads)


def _first_touch(hits: Sequence[Column]) -> Column:
    """Number of the first bar whose condition holds, NULL when none does."""
    return F.coalesce(*[F.when(hit, F.lit(i)) for i, hit in enumerate(hits, 1)])


def add_barrier_grid(
    df: DataFrame, w: WindowSpec, grid: Sequence[tuple[float, float, int]],
    vol: str = "atr_pct", out: str = "labels",
) -> DataFrame:
    """All (pt, sl, h) variants at once as an array, in grid order.

    The first touch of a barrier does not depend on the other barrier or on h, so
    one position per distinct pt and per distinct sl serves every variant.
    """
    top = max(h for _, _, h in grid)
    leads = {f"_hi{i}": F.lead("high", i).over(w) for i in range(1, top + 1)}
    leads |= {f"_lo{i}": F.lead("low", i).over(w) for i in range(1, top + 1)}
    leads |= {f"_end{h}": F.lead("close", h).over(w) for h in {h for _, _, h in grid}}
    df = df.withColumns(leads).withColumn("_vol", _floor_vol(F.col(vol)))
    close, v = F.col("close"), F.col("_vol")
    pts, sls = sorted({g[0] for g in grid}), sorted({g[1] for g in grid})
    touch = {
        f"_up{i}": _first_touch(
            [F.col(f"_hi{j}") >= close * (1.0 + pt * v) for j in range(1, top + 1)]
        )
        for i, pt in enumerate(pts)
    } | {
        f"_dn{i}": _first_touch(
            [F.col(f"_lo{j}") <= close * (1.0 - sl * v) for j in range(1, top + 1)]
        )
        for i, sl in enumerate(sls)
    }
    df = df.withColumns(touch)
    labels = []
    for pt, sl, h in grid:
        up, dn = F.col(f"_up{pts.index(pt)}"), F.col(f"_dn{sls.index(sl)}")
        labels.append(
            F.when(F.col(f"_end{h}").isNull(), F.lit(None))
            .when((up <= h) & (dn.isNull() | (up <= dn)), F.lit(BUY))
            .when(dn <= h, F.lit(SELL))
            .otherwise(F.lit(HOLD))
            .cast("double")
        )
    return df.withColumn(out, F.array(*labels)).drop("_vol", *leads, *touch)


def label_distribution(df: DataFrame, label: str = "label", keys=("symbol",)) -> DataFrame:
    share = lambda code: F.avg((F.col(label) == code).cast("double"))
    return (
        df.where(F.col(label).isNotNull())
        .groupBy(*keys)
        .agg(share(SELL).alias("sell"), share(HOLD).alias("hold"), share(BUY).alias("buy"))
    )


def add_sequences(
    df: DataFrame, w: WindowSpec, features: Sequence[str], target: str, length: int = 30,
    out: str = "sequence",
) -> DataFrame:
    """The previous ``length`` feature rows as one array, with the current row's target."""
    frame = w.rowsBetween(-length, -1)
    rows = F.collect_list(F.struct(*features)).over(frame)
    df = df.withColumn(out, F.when(F.count(F.lit(1)).over(frame) == length, rows))
    return df.withColumn("sequence_target", F.when(F.col(out).isNotNull(), F.col(target)))
