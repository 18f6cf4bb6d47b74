"""Distributed union-find: connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.plans.tables import keep, scratch


def components(links: DataFrame) -> DataFrame:
    """``links(a long, b long)`` to ``(node, root)``: the smallest node reachable.

    Every round points each node's larger neighbours, then its smaller ones, at the
    least node in its neighbourhood; the links end as stars around the roots. Both steps
    are a pre-aggregated minimum and a join on the node, which AQE splits where one node
    has very many links; no list of neighbours is ever built. Rounds grow with the
    logarithm of the longest path. Each round is written to shared storage.
    Null ends, loops and repeated links are ignored; no link gives no row.
    """
    a, b = F.col("a"), F.col("b")
    with scratch() as last:
        edges = keep(
            links.where(a.isNotNull() & b.isNotNull() & (a != b))
            .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
        )
        before = None
        while True:
            seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if not seen[0] or tuple(seen) == before:
                break
            before = tuple(seen)
            edges = keep(_small_star(_large_star(edges)))
        roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root"))
        return last(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots).distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # The larger end of each link goes to the least neighbour of the smaller end.
    larger = edges.select(F.col("v").alias("u"), F.col("u").alias("w"))
    return larger.join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    pairs = edges.join(least, "u")
    moved = pairs.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).union(moved).distinct()
