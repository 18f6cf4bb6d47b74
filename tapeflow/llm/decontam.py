"""Benchmark decontamination by a prefix-filtered join with exact verification.

An item's windows hold ``width`` consecutive words. A window occurs in a document only if its
rarest word does, so that word is the window's necessary prefix. Words are ordered by the
number of documents that hold them. A document is read word by word; only at a prefix word
are windows considered, each at the one place that word's offset allows, inside the
document's bounds, and there all words are compared.
"""

from __future__ import annotations

import itertools
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tapeflow.llm.shared import aside, letter_words
from tapeflow.plans.tables import keep

WIDTH = 10
#: Code points of items that one pass carries to the tasks: about 64 MB of windows.
BLOCK_CHARS = 1_000_000


def windows_of(words: list[bytes], width: int = WIDTH) -> list[tuple[bytes, ...]]:
    """All runs of ``width`` words; fewer words, but not none, are one window."""
    if len(words) <= width:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]


class Index:
    """Prefix word -> (offset, length) -> window -> numbers of the items that hold it."""

    def __init__(self, items: list[tuple[str, list[bytes]]], rarity: dict[bytes, int], width: int):
        self.ids = [i for i, _ in items]
        self.by_word: dict[bytes, dict[tuple[int, int], dict[tuple[bytes, ...], set[int]]]] = {}
        for number, (_, words) in enumerate(items):
            for window in windows_of(words, width):
                at = min(range(len(window)), key=lambda i: (rarity.get(window[i], 0), window[i], i))
                places = self.by_word.setdefault(window[at], {})
                places.setdefault((at, len(window)), {}).setdefault(window, set()).add(number)

    def occurrences(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans (start, end) of occurring windows in order of their prefix, and the items' ids."""
        spans, items, n, by_word = [], set(), len(words), self.by_word
        for p in [p for p, w in enumerate(words) if w in by_word]:
            for (at, length), windows in by_word[words[p]].items():
                start = p - at
                if start >= 0 and start + length <= n:
                    own = windows.get(tuple(words[start : start + length]))
                    if own:
                        spans.append((start, start + length))
                        items |= own
        return spans, {self.ids[i] for i in items}


def covered(spans) -> int:
    """Words inside any span."""
    total, reach = 0, 0
    for start, end in sorted(spans):
        if end > reach:
            total += end - max(start, reach)
            reach = end
    return total


def _blocks(benchmark: DataFrame, most_chars: int):
    """The items in parts of bounded size, each part a list on the driver for one pass.

    The parts are disjoint ranges of item ids' hashes, or of the texts' where an id is null;
    they are read one after the other.
    """
    size = F.coalesce(F.char_length("text"), F.lit(0)) + 16
    items = keep(benchmark.select(
        F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"), size.alias("size")))
    total = items.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-2 * total // most_chars)) if total > most_chars else 1
    for part in range(parts):
        own = items.where(F.pmod(F.when(F.col("item_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("item_id")), F.lit(parts)) == part)
        rows = [(r.item_id, letter_words(bytes(r.text) if r.text else None)) for r in own.toLocalIterator()]
        rows = [r for r in rows if r[1]]
        if rows:
            yield rows


def document_frequency(documents: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many documents each word of a bounded vocabulary occurs, over all documents."""
    known = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        counts = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(known.value.intersection(letter_words(text.as_py())))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = documents.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "word binary, n long")
    return {bytes(r.word): r.n for r in rows.groupBy("word").agg(F.sum("n").alias("n")).toLocalIterator()}


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, most_chars: int = BLOCK_CHARS) -> DataFrame:
    """All columns of ``documents`` and n_words, n_hit, n_items (long), items (sorted array).

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. n_hit counts words
    inside any occurrence of an item's window of ``width`` words; an item with fewer words is
    one window. Null or empty texts have no words; items without words never occur.
    Repeated rows each get a row; items that share an id are one item. Items without an id count
    for n_hit and are one item in n_items; ``items`` leaves them out. Extra columns stay,
    except that the four added names are replaced. Empty tables give no row or no hit.

    A benchmark over ``most_chars`` is taken in blocks of bounded size, each with its own pass
    over the documents; spans and items of the passes are then merged.
    """
    own, back = aside(documents.drop("n_words", "n_hit", "n_items", "items"), ("_spans", "_dk", "_th"))
    blocks = _blocks(benchmark, most_chars)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return back(_one_pass(own, first, width).drop("_spans").withColumn("items", F.array_compact("items")))
    key = [F.coalesce("doc_id", F.lit(-(2**63))).alias("_dk"), F.xxhash64("text").alias("_th")]
    found = None
    for rows in itertools.chain([first, second], blocks):
        part = _one_pass(own.select("doc_id", "text"), rows, width).where("n_hit > 0").select(
            *key, "_spans", "items").dropDuplicates(["_dk", "_th"])
        part = keep(part)
        found = part if found is None else found.union(part)
    merged = keep(found.groupBy("_dk", "_th").agg(
        F.flatten(F.collect_list("_spans")).alias("_spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")))
    rows = _one_pass(own, [], width).drop("items", "_spans", "n_items", "n_hit").withColumns(
        {"_dk": key[0], "_th": key[1]}).join(merged, ["_dk", "_th"], "left")
    reach = F.aggregate(
        F.sort_array(F.coalesce("_spans", F.array().cast("array<struct<s:int,e:int>>"))),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, x: F.struct((a.n + F.greatest(x.e - F.greatest(x.s, a.to), F.lit(0))).alias("n"),
                              F.greatest(a.to, x.e).alias("to")), lambda a: a.n)
    items = F.sort_array(F.coalesce("items", F.array().cast("array<string>")))
    return back(rows.select(*own.columns, "n_words", reach.cast("long").alias("n_hit"),
                            F.size(items).cast("long").alias("n_items"), F.array_compact(items).alias("items")))


def _one_pass(documents: DataFrame, items: list[tuple[str, list[bytes]]], width: int) -> DataFrame:
    rarity = document_frequency(documents, {w for _, words in items for w in words}) if items else {}
    index = documents.sparkSession.sparkContext.broadcast(Index(items, rarity, width))
    at = documents.columns.index("text")
    added = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
                       ("items", pa.list_(pa.string())),
                       ("_spans", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))])

    def run(batches):
        for batch in batches:
            cols = [[], [], [], [], []]
            for text in batch.column(at).cast(pa.binary()):
                words = letter_words(text.as_py())
                spans, ids = index.value.occurrences(words)
                row = (len(words), covered(spans), len(ids), sorted(ids, key=lambda i: (i is None, i or "")), [{"s": s, "e": e} for s, e in spans])
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            new = [pa.array(c, t.type) for c, t in zip(cols, added, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *added.names])

    new = "n_words long, n_hit long, n_items long, items array<string>, _spans array<struct<s:int,e:int>>"
    return documents.mapInArrow(run, StructType([*documents.schema.fields, *StructType.fromDDL(new).fields]))


def clean_documents(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Documents without any occurrence of a window; columns as they came."""
    own, back = aside(documents, ("n_words", "n_hit", "n_items", "items"))
    marked = contamination(own, benchmark, width)
    return back(marked.where("n_hit = 0").select(*own.columns))
