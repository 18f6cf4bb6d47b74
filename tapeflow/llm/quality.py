"""Quality classifier: histogram gradient-boosted trees over document statistics.

Spark computes the statistics of whole texts in parallel. The trees are fitted with numpy on
a bounded sample of labelled rows, flattened into arrays and broadcast; scoring walks all
trees for a batch of rows at once.
"""

from __future__ import annotations

import operator
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeflow.llm.shared import bloom, filter_words, might_hold
from tapeflow.plans.tables import keep

#: Most labelled rows a fit uses: 60,000 rows of 30 numbers are 15 MB on the driver.
SAMPLE = 60_000
THRESHOLD = 0.3
_SIGNS = np.zeros(256, bool)
_SIGNS[[b for b in range(33, 127) if not chr(b).isalnum()]] = True

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "lower", "upper", "digits", "blanks", "signs", "high", "entropy",
    "doubled_signs", "doubled_bytes", "word_len", "word_len_sd", "longest_word", "short_words", "distinct_words",
    "distinct_pairs", "repeated_next", "commonest_word", "distinct_lines", "line_len", "commonest_line",
    "commas", "stops", "bars", "lone_signs", "ends_with_sign", "sign_kinds",
)


def statistics(text: bytes | None) -> list[float]:
    """Numbers in the order of STATISTICS; all zero for null and empty texts."""
    if not text:
        return [0.0] * len(STATISTICS)
    a = np.frombuffer(text, np.uint8)
    n = len(a)
    hist = np.bincount(a, minlength=256)
    share = hist[hist > 0] / n
    signs = int(hist[_SIGNS].sum())
    same = a[1:] == a[:-1]
    words, lines = text.split(), text.split(b"\n")
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts, line_counts = Counter(words), Counter(x for x in lines if x.strip())
    n_lines = max(1, sum(line_counts.values()))
    last = Counter(x[-1] for x in words)
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(np.log1p(len(lines))),
        hist[97:123].sum() / n, hist[65:91].sum() / n, hist[48:58].sum() / n, (hist[32] + hist[9:14].sum()) / n, signs / n,
        hist[128:].sum() / n, float(-(share * np.log2(share)).sum()),
        float((same & _SIGNS[a[1:]]).sum()) / n, float(same.sum()) / n,
        float(sizes.mean()), float(sizes.std()), float(np.log1p(sizes.max())), float((sizes <= 2).mean()),
        len(counts) / w, len(set(zip(words, words[1:]))) / w, sum(map(operator.eq, words, words[1:])) / w,
        max(counts.values(), default=0) / w, len(line_counts) / n_lines, float(np.log1p(n / n_lines)),
        max(line_counts.values(), default=0) / n_lines,
        hist[44] / w, hist[46] / w, hist[124] / w,
        sum(c for x, c in counts.items() if len(x) == 1 and _SIGNS[x[0]]) / w,
        sum(c for b, c in last.items() if _SIGNS[b]) / w, float((hist[_SIGNS] > 0).sum()),
    ]


# --- the trees ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Trees:
    """All trees in flat arrays; a leaf points to itself. ``roots`` are the trees' first nodes."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of statistics."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for first in range(0, len(self.roots), 16):  # bounds the memory of a batch
            at = np.broadcast_to(self.roots[first : first + 16], (len(x), len(self.roots[first : first + 16]))).copy()
            for _ in range(self.depth):
                go = x[rows[:, None], self.feature[at]] <= self.limit[at]
                at = np.where(go, self.left[at], self.right[at])
            total += self.value[at].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64,
        least_rows: int = 20, ridge: float = 1.0) -> Trees:
    """Boosting on binned statistics with logistic loss. One class, or no row, gives a constant."""
    n, m = x.shape
    share = float(np.clip((y.sum() + 0.5) / (n + 1.0), 1e-4, 1 - 1e-4))
    base = float(np.log(share / (1 - share)))
    parts: dict[str, list] = {k: [] for k in ("feature", "limit", "left", "right", "value")}
    roots: list[int] = []

    def leaf(value: float) -> int:
        me = len(parts["value"])
        for k, v in (("feature", 0), ("limit", np.inf), ("left", me), ("right", me), ("value", value)):
            parts[k].append(v)
        return me

    if n and 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)])
        total = np.full(n, base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-total))
            g, h = y - p, p * (1 - p)
            root = leaf(0.0)
            roots.append(root)
            ids, where = [root], np.zeros(n, np.int64)  # nodes of this level; a row's place among them, -1 when settled
            step = np.zeros(n)
            for level in range(depth + 1):
                inside = where >= 0
                k = len(ids)
                gs = np.bincount(where[inside], g[inside], k)
                hs = np.bincount(where[inside], h[inside], k)
                for i, node in enumerate(ids):
                    parts["value"][node] = rate * gs[i] / (hs[i] + ridge)
                best = np.full(k, 1e-6)
                choice = np.full((k, 2), -1)
                if level < depth:
                    for j in range(m):
                        if not len(cuts[j]):
                            continue
                        slot = where[inside] * bins + binned[j][inside]
                        gl, hl, cl = (np.bincount(slot, w, k * bins).reshape(k, bins).cumsum(axis=1) for w in (g[inside], h[inside], None))
                        gain = gl**2 / (hl + ridge) + (gs[:, None] - gl) ** 2 / (hs[:, None] - hl + ridge) - (gs**2 / (hs + ridge))[:, None]
                        size = cl[:, -1:]
                        gain[(cl < least_rows) | (size - cl < least_rows)] = -1
                        gain = gain[:, : len(cuts[j])]
                        top = gain.argmax(axis=1)
                        better = gain[np.arange(k), top] > best
                        best = np.where(better, gain[np.arange(k), top], best)
                        choice[better] = np.stack([np.full(k, j), top], axis=1)[better]
                new_ids, moved = [], np.full(n, -1)
                for i, node in enumerate(ids):
                    own = where == i
                    j, cut = choice[i]
                    if j < 0:
                        step[own] = parts["value"][node]
                        continue
                    parts["feature"][node], parts["limit"][node] = int(j), float(cuts[j][cut])
                    parts["left"][node], parts["right"][node] = leaf(0.0), leaf(0.0)
                    go = binned[j] <= cut
                    moved[own & go], moved[own & ~go] = len(new_ids), len(new_ids) + 1
                    new_ids += [parts["left"][node], parts["right"][node]]
                ids, where = new_ids, moved
                if not ids:
                    break
            total += step
    if not roots:
        roots.append(leaf(0.0))
    a = {k: np.array(v, np.float64 if k in ("limit", "value") else np.int64) for k, v in parts.items()}
    return Trees(**a, roots=np.array(roots), depth=depth, base=base)


# --- Spark side --------------------------------------------------------------------------

def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned: CRC-32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Trees:
    """Trees from labelled documents that are not held out, at most about ``most`` rows of them.

    Beyond that a share of the ids, chosen by a hash, is used. Rows with the same id and text
    are one row; where ids have several texts, the bound holds for the rows of the chosen ids
    as well. Null labels are ignored; a
    document with several labels counts as 0 if any is 0. Only documents that may be in the
    sample are read through, found by a bounded filter.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).cast("double").alias("y"))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    known = keep(known)
    words = filter_words(min(n, most))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("th"))
    key = F.xxhash64("doc_id")
    docs = might_hold(docs, key, bloom(known, key, words), words, "_in").where("_in").select("doc_id", "text", "th")

    def run(batches):
        for batch in batches:
            rows = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "th", "x"])

    rows = docs.mapInArrow(run, "doc_id long, th long, x array<double>").dropDuplicates(["doc_id", "th"])
    rows = keep(rows.join(known, "doc_id"))
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("th", "doc_id"), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    t = rows.select("doc_id", "x", "y").toArrow()
    x = np.array(t.column("x").to_pylist(), np.float64).reshape(-1, len(STATISTICS))
    y = t.column("y").to_numpy().astype(np.float64)
    order = np.lexsort((*x.T[::-1], t.column("doc_id").to_numpy()))  # the same trees whatever order rows came in
    return fit(x[order], y[order])


def _scores(trees: Trees, texts) -> np.ndarray:
    x = np.array([statistics(t.as_py()) for t in texts], np.float64).reshape(-1, len(STATISTICS))
    return trees.score(x)


def quality_scores(documents: DataFrame, trees: Trees) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from 0.3 on).

    Null and empty texts get the score of a text without content. Repeated rows each get a
    row; other columns are ignored; a null doc_id is not held out.
    """
    model = documents.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(model.value, batch.column(1)), pa.float64())], names=["doc_id", "score"])

    docs = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    scored = docs.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good_documents(documents: DataFrame, trees: Trees) -> DataFrame:
    """Documents with a score from 0.3 on; columns as they came. Nothing is shuffled."""
    model = documents.sparkSession.sparkContext.broadcast(trees)
    at = documents.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(model.value, batch.column(at).cast(pa.binary())) >= THRESHOLD))

    return documents.mapInArrow(run, documents.schema)
