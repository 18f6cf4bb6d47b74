"""Helpers of this folder: word splitting on bytes, 64-bit mixing and a bounded Bloom filter."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of `[\x20\x09-\x0D]`, on which bytes.split() splits.
SPACE = r"[\x20\x09-\x0D]+"
#: Largest Bloom filter: 2^20 words of 64 bits are 8 MB. Beyond some eight million keys more
#: rows pass it, which costs time only: an exact join always follows.
MAX_WORDS = 1 << 20


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def aside(df: DataFrame, inner: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Rename the columns whose names an operator uses itself; the function gives them their names back."""
    inner = set(inner)
    names = {c: f"_own{i}_{c}" for i, c in enumerate(df.columns) if c in inner}
    back = {v: k for k, v in names.items()}
    return df.withColumnsRenamed(names), lambda out: out.withColumnsRenamed(back)


def _fold_table() -> bytes:
    """A-Z to a-z; ASCII that is no letter or digit to a space; other bytes stay."""
    out = bytearray(range(256))
    for c in range(128):
        ch = chr(c)
        out[c] = ord(ch.lower()) if ch.isalnum() else 0x20
    return bytes(out)


_FOLD = _fold_table()


def letter_words(text: bytes | None) -> list[bytes]:
    r"""Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the text with A-Z lower-cased; null has none."""
    return text.translate(_FOLD).split() if text else []


def spaced_words(text: bytes | None) -> list[bytes]:
    r"""Words `[^\x20\x09-\x0D]+` of the text with A-Z lower-cased; null has none."""
    return text.lower().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (the public splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


# --- Bloom filter with 64-bit blocks ---------------------------------------------------

def filter_words(n_keys: int, most: int = MAX_WORDS) -> int:
    """A power of two with about 16 bits a key, at most ``most`` words of 64 bits."""
    words = 1 << 8
    while words < most and words * 4 < n_keys:
        words *= 2
    return words


def word_of(h: Column, words: int) -> Column:
    """The block of a hashed key. ``words`` is a power of two."""
    return h.bitwiseAND(F.lit(words - 1).cast("long"))


def bits_of(h: Column) -> Column:
    """Three bits inside the key's block, from hash bits that do not choose the block."""
    one = F.lit(1).cast("long")

    def bit(shift: int) -> Column:
        return F.call_function(
            "shiftleft", one, F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63).cast("long")).cast("int")
        )

    return bit(40).bitwiseOR(bit(48)).bitwiseOR(bit(56))


def bloom(keys: DataFrame, h: Column, words: int) -> DataFrame:
    """Rows (word, bits) of the filter: at most ``words`` of them, or-ed map-side first."""
    return (
        keys.where(h.isNotNull())
        .groupBy(word_of(h, words).alias("word"))
        .agg(F.bit_or(bits_of(h)).alias("bits"))
    )


def might_hold(df: DataFrame, h: Column, filter_rows: DataFrame, words: int, name: str) -> DataFrame:
    """Add boolean ``name``: false only for keys that are surely absent; false for a null hash.

    ``filter_rows`` is broadcast: it holds at most ``words`` (<= MAX_WORDS) rows of 16 bytes.
    """
    if words > MAX_WORDS:
        raise ValueError(f"a filter of {words} words is over the broadcast bound {MAX_WORDS}")
    word, held = (next(n for k in range(len(df.columns) + 1) if (n := f"{w}{k}") not in df.columns) for w in ("_word", "_bits"))
    bits = F.broadcast(filter_rows.select(F.col("word").alias(word), F.col("bits").alias(held)))
    out = df.join(bits, word_of(h, words) == F.col(word), "left")
    own = bits_of(h)
    hit = F.coalesce(F.col(held).bitwiseAND(own) == own, F.lit(False))
    return out.withColumn(name, hit).drop(word, held)


class BitFilter:
    """The same filter on numpy, for use inside Python tasks; ``bits`` has ``words`` items."""

    def __init__(self, rows, words: int):
        self.words = words
        self.bits = np.zeros(words, np.uint64)
        for word, bits in zip(*rows, strict=True):
            self.bits[int(word)] = np.int64(bits).view(np.uint64)

    def holds(self, h: int) -> bool:
        h &= 0xFFFFFFFFFFFFFFFF
        own = (1 << (h >> 40 & 63)) | (1 << (h >> 48 & 63)) | (1 << (h >> 56 & 63))
        return int(self.bits[h & (self.words - 1)]) & own == own


def bit_filter(keys: DataFrame, h: Column, n_keys: int) -> BitFilter:
    """Collects at most MAX_WORDS short rows, whatever the number of keys."""
    words = filter_words(n_keys)
    t = bloom(keys, h, words).toArrow()
    return BitFilter((t.column("word").to_numpy(), t.column("bits").to_numpy()), words)
