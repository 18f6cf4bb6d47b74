"""Maximal periodic runs of words, found online on sparse diagonals.

A run of period q is a streak of words that equal the word q before. Lags are followed while
their streak lasts, each with the position where it began. A run has at least 16 matches in a
row, so it is enough to open lags at every ninth word: the word's earlier occurrences whose
last eight words match too. From then on every word lengthens the active lags or ends them, and
a lag whose streak is long enough is emitted as it ends.

While a run is being followed, lags that lie whole inside it need no look: multiples of its
period end with it, and no other lag can match for a whole period there. Where it ends, the
occurrences are looked at once more. So one word repeated a million times opens one lag.
"""

from __future__ import annotations

import array
import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, TIMES = 24, 3
_BACK, _EVERY = 8, 9  # _BACK + _EVERY - 1 <= the least number of matches in a run
_MANY = 64


def least_length(period: int) -> int:
    return max(LEAST, TIMES * period)


def _streak_start(words: list, i: int, lag: int) -> int:
    """First position of the streak of matches at ``lag`` that ends at i."""
    while i > lag and words[i - 1] == words[i - 1 - lag]:
        i -= 1
    return i


def _opened(words: list, codes, before, i: int, active: dict[int, int], most: int) -> None:
    """Open the lags at which the _BACK words up to i match; ``before``: the word's earlier places."""
    lead, has = words[i - 1], active.__contains__
    if len(before) > _MANY:
        at = np.frombuffer(before, np.int64)
        at = at[np.searchsorted(at, max(_BACK - 1, i - most)) :]
        for k in range(1, _BACK):
            at = at[codes[at - k] == codes[i - k]]
        before = at.tolist()
    for j in before:
        lag = i - j
        if j >= _BACK - 1 and words[j - 1] == lead and lag <= most and not has(lag) and all(
                words[i - k] == words[j - k] for k in range(2, _BACK)):
            active[lag] = _streak_start(words, i, lag)


def periodic_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run, by start, then period.

    A run is a stretch with smallest period q and a length of at least max(24, 3q) that no word beside it extends.
    """
    n = len(words)
    if n < LEAST:
        return []
    most = n // TIMES
    codes = None
    places: dict = {}
    active: dict[int, int] = {}  # lag -> position of its first match
    found: dict[tuple[int, int], int] = {}
    run = None  # a lag among the active ones that is long enough already

    def end(lag: int, i: int) -> bool:
        start = active[lag] - lag
        if i - start < least_length(lag):
            return False
        # Multiples of a period end with it, over the same stretch: the smallest stays.
        found[start, i] = min(lag, found.get((start, i), lag))
        return True

    for i, word in enumerate(words):
        look = i % _EVERY == 0 and i >= _BACK
        if active:
            for lag in [g for g in active if words[i - g] != word]:
                look |= end(lag, i)
                del active[lag]
                if lag == run:
                    run = None
            if run is None:
                run = next((g for g, at in active.items() if i + 1 - at + g >= least_length(g)), None)
        before = places.get(word)
        if before is None:
            places[word] = array.array("q", (i,))
            continue
        if look and i >= _BACK:
            some = before
            if run is not None:
                # Not those a period or more behind i and a period or more behind the run's start.
                some = before[: bisect.bisect_left(before, active[run])] + before[bisect.bisect_right(before, i - run) :]
            if codes is None and len(some) > _MANY:
                numbers: dict = {}
                codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
            _opened(words, codes, some, i, active, most)
        before.append(i)
    for lag in active:
        end(lag, n)
    return sorted((start, stop - start, lag) for (start, stop), lag in found.items())


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """Words without those that a run holds after its first period."""
    if not runs:
        return words
    keep = bytearray(b"\1") * len(words)
    for start, length, period in runs:
        keep[start + period : start + length] = bytes(length - period)
    return [w for w, k in zip(words, keep, strict=True) if k]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_words, runs (array of start, length, period), collapsed.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text, numbered from 0; ``collapsed`` is the text without what runs
    repeat, words joined by one space. Null and empty texts have no words and no runs; repeated rows each get a row; a
    null doc_id stays null; other columns are ignored.
    """
    def run(batches):
        for batch in batches:
            counts, runs, texts = [], [], []
            for text in batch.column(1):
                words = (text.as_py() or b"").split()
                own = periodic_runs(words)
                counts.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                texts.append(b" ".join(collapsed(words, own)).decode(errors="replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(_RUN)),
                                              pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def summary(found: DataFrame) -> DataFrame:
    """Number of runs, the run of greatest length / period, digests of all runs and of the collapsed text.

    Ratios are compared exactly by cross products; ties go to the smaller start, then the smaller period, which
    is the order of the runs. Without a run its four columns are null.
    """
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda b, r: F.when(
        b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    line = F.transform("runs", lambda r: F.concat(*_with_commas(r), F.lit("\n")))
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def _with_commas(r: Column) -> list[Column]:
    a, b, c = (r[k].cast("string") for k in ("start", "length", "period"))
    return [a, F.lit(","), b, F.lit(","), c]


def with_loops(documents: DataFrame) -> DataFrame:
    """Texts with planted runs: of documents with h = crc32(doc_id) divisible by 10, each word i >= a becomes
    word a + (i - a) % p, where g = h div 10, a = g % n, p = 1 + (n - a) div (3 + g % 8); n words, joined by one space.
    A null doc_id has no h; its text stays."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1))
    rows = documents.select("doc_id", "text", h.alias("h"), F.floor(h / 10).cast("long").alias("g"))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w").cast("long"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("long"))
    at = lambda x, i: F.get(F.col("w"), F.when(i < F.col("a"), i).otherwise(
        F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.transform("w", at), " ")).otherwise(F.col("text")).alias("text"))
