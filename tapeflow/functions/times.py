"""Clock arithmetic on naive timestamps, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _epoch() -> Column:
    return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def epoch_seconds(ts: Column) -> Column:
    return F.timestamp_diff("SECOND", _epoch(), ts)


def epoch_millis(ts: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", _epoch(), ts)


def from_seconds(s: Column) -> Column:
    return F.timestamp_add("SECOND", s, _epoch())


def from_millis(ms: Column) -> Column:
    return F.timestamp_add("MILLISECOND", ms, _epoch())


def to_instant(ts: Column) -> Column:
    """A naive time as an instant read in UTC; event-time watermarks need one."""
    return F.timestamp_millis(epoch_millis(ts))


def from_instant(at: Column) -> Column:
    return from_millis(F.unix_millis(at))
