"""Text scoring inside a projection: no explode, no join, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A small market lexicon, -1 bad to +1 good.
LEXICON = {
    "beat": 1.0, "beats": 1.0, "gain": 1.0, "gains": 1.0, "growth": 0.5, "inflow": 0.5,
    "optimistic": 0.5, "outlook": 0.25, "positive": 0.5, "profit": 1.0, "rallies": 1.0,
    "rally": 1.0, "record": 0.5, "strong": 0.5, "surge": 1.0, "surges": 1.0,
    "upgrade": 0.5, "bearish": -0.5, "crash": -1.0, "decline": -0.5, "drop": -0.5,
    "drops": -0.5, "fear": -0.5, "fraud": -1.0, "hack": -1.0, "loss": -1.0,
    "losses": -1.0, "plunge": -1.0, "plunges": -1.0, "pressure": -0.25,
    "selloff": -1.0, "tumbles": -1.0, "warning": -0.5, "weak": -0.5,
}


def score_text(text: Column, lexicon: dict[str, float] | None = None) -> Column:
    """Mean weight of the lexicon words in the whole text, 0.0 when it holds none."""
    words = lexicon or LEXICON
    weights = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    # Longer words first, so that a word never hides a longer one it begins.
    listed = "|".join(sorted(words, key=lambda w: (-len(w), w)))
    whole_word = F.lit(rf"(?<!\p{{L}})({listed})(?!\p{{L}})")
    hits = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), whole_word, F.lit(1))
    # One fold with its own ending, so that the text is searched once.
    return F.aggregate(
        hits,
        F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n")),
        lambda a, t: F.struct(
            (a.total + F.element_at(weights, t)).alias("total"), (a.n + 1).alias("n")
        ),
        lambda a: F.when(a.n > 0, a.total / a.n).otherwise(F.lit(0.0)),
    )
