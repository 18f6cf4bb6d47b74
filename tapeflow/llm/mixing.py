"""Sources mixed to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeflow.llm.shared import aside
from tapeflow.plans.tables import keep

#: Means above this are drawn as a sum of independent parts, so that exp(-mean) stays normal.
PART = 500.0
BROADCAST_SOURCES = 100_000


def uniform(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) with 52 bits from the MD5 of the seed and the keys; null reads as '?'."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("?")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(documents: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5) -> DataFrame:
    """(source, n_docs, chars, rate): the mean number of copies that brings each source to its share.

    A source's size is its code points plus one a document, so no size is zero. The target
    share is ``weights[source]`` over the sum of the weights of the sources present, or
    ``size ** power`` where no weights are given; a source without a weight gets none.
    The expected size of the output is that of the input. Null is a source of its own.
    """
    size = F.char_length(F.coalesce("text", F.lit(""))).cast("long") + 1
    sizes = documents.select("source", size.alias("size")).groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum("size").alias("chars")
    )
    if weights is None:
        w = F.pow(F.col("chars").cast("double"), F.lit(power))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        w = F.coalesce(F.try_element_at(given, F.coalesce("source", F.lit(""))), F.lit(0.0)).cast("double")
    sizes = sizes.withColumn("w", w)
    total = sizes.agg(F.sum("chars").alias("all_chars"), F.sum("w").alias("all_w"))
    # One row meets the sources: a join on a constant with a table that is one row by definition.
    both = sizes.withColumn("_one", F.lit(1)).join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one")
    rate = F.coalesce(F.col("all_chars") * F.col("w") / F.nullif("all_w", F.lit(0.0)) / F.col("chars"), F.lit(0.0))
    return both.select("source", "n_docs", "chars", rate.alias("rate"))


def _steps(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... of a Poisson variable, far enough that the rest is below 1e-15."""
    last = F.ceil(mean + F.lit(12.0) * F.sqrt(mean) + F.lit(24.0)).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))
    return F.aggregate(
        F.sequence(F.lit(1), last), start,
        lambda acc, k: F.struct(
            (acc.p * mean / k).alias("p"),
            F.concat(acc.cdf, F.array(F.element_at(acc.cdf, -1) + acc.p * mean / k)).alias("cdf"),
        ),
        lambda acc: acc.cdf,
    )


def replicate(documents: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, seed: str = "mix") -> DataFrame:
    """Each document as often as a Poisson draw says, in random order over the whole result.

    Adds ``copy`` (1, 2, ...). The draw inverts the distribution function at a hash of
    (seed, doc_id), so it does not depend on partitions, order or retries; repeated rows of
    one doc_id are drawn alike. Rows come sorted by a hash of (seed, doc_id, copy), so the
    parts of the output in order are one global shuffle and sources are dealt evenly.
    Null doc_id, text and source are allowed; an empty table gives no row; extra columns
    stay, but one named ``copy`` is replaced.
    """
    rates = source_rates(documents, weights, power)
    parts = F.greatest(F.ceil(F.col("rate") / F.lit(PART)).cast("int"), F.lit(1))
    rates = rates.withColumn("_parts", parts).withColumn("_mean", F.col("rate") / F.col("_parts"))
    rates = rates.select(F.col("source").alias("_src"), "_parts", _steps(F.col("_mean")).alias("_cdf"))
    docs, back = aside(documents.drop("copy"), ("_src", "_parts", "_cdf", "_n", "_at"))
    rates = keep(rates)
    # A source's steps take some 40 numbers: BROADCAST_SOURCES of them stay below 40 MB. More
    # sources than that meet their documents by a shuffled join, whose hot keys AQE splits.
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    both = docs.join(rates, docs["source"].eqNullSafe(rates["_src"]))
    draws = F.transform(F.sequence(F.lit(1), F.col("_parts")), lambda i: uniform(seed, i, F.col("doc_id")))
    drawn = F.aggregate(draws, F.lit(0), lambda acc, u: acc + F.size(F.filter("_cdf", lambda c: c <= u)))
    out = both.withColumn("_n", drawn).where("_n > 0").select(
        *[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy")
    )
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("?")), "copy"))
    return back(out.withColumn("_at", order).orderBy("_at", "doc_id", "copy").drop("_at"))
