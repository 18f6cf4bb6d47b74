"""Exact duplicates by deterministic block naming, in DataFrame functions only.

A normalised text is cut into blocks of a fixed number of code points. The distinct
blocks are sorted and numbered; the number is the block's name. Adjacent names are
paired, the distinct pairs sorted and numbered, and so on until one name is left.
Equal (level, name) means equal text: no hash decides equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tapeflow.llm.shared import SPACE
from tapeflow.plans.tables import keep

BLOCK = 4096
_SHELF_BITS = 16


def normal(text: Column) -> Column:
    r"""The text without characters of `[\x20\x09-\x0D]`; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def _blocks(text: Column, size: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def _numbered(distinct: DataFrame, cols: list[str]) -> DataFrame:
    """Integer ``name`` of each distinct row: its place in sorted order within its shelf, the
    shelf being the leading bits of a hash. Shelves are many, even and independent of the data."""
    shelf = F.shiftrightunsigned(F.xxhash64(*cols), 64 - _SHELF_BITS)
    place = F.row_number().over(Window.partitionBy("_shelf").orderBy(*cols)).cast("long")
    named = distinct.withColumn("_shelf", shelf).withColumn("_place", place)
    return named.select(*cols, F.shiftleft("_shelf", 62 - _SHELF_BITS).bitwiseOR(F.col("_place")).alias("name"))


def block_names_clash(documents: DataFrame, size: int, key=F.xxhash64) -> bool:
    """Whether two different blocks of the corpus share a short key. One pass; a row a key."""
    blocks = documents.select(F.explode(_blocks(normal(F.col("text")), size)).alias("b"))
    spans = blocks.select(key("b").alias("k"), "b").groupBy("k").agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
    return bool(spans.where("lo <> hi").limit(1).count())


def exact_groups(documents: DataFrame, size: int = BLOCK, key=F.xxhash64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, level, name.

    Of equal normalised texts the row with the most code points in its original text stays,
    then the smallest doc_id; among repeated rows of that doc_id exactly one is ``kept``.
    Null text counts as empty; all empty texts form one group. A null doc_id sorts first.
    Other columns are ignored, whatever their names. An empty table gives no row.

    Blocks travel as 64-bit keys after one pass has proved that no two blocks of this corpus
    share a key; if some do, the blocks themselves travel. Both ways give the same names up
    to their numbers, so the groups never depend on a hash.
    """
    t = F.col("text")
    base = documents.select("doc_id", "text").withColumn("_norm", normal(t))
    clash = block_names_clash(documents.select("text"), size, key)
    blocks = _blocks(F.col("_norm"), size)
    base = keep(base.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        F.char_length(F.coalesce(t, F.lit(""))).cast("long").alias("n_points"),
        F.sha2(F.col("_norm"), 256).alias("text_sha256"),
        (blocks if clash else F.transform(blocks, lambda b: key(b))).alias("blocks"),
    ))
    named = _identities(base.select("row", "blocks"))
    rows = base.drop("blocks").join(named, "row")
    best = F.struct((-F.col("n_points")).alias("p"), F.col("doc_id").alias("d"), F.col("row").alias("r"))
    groups = rows.groupBy("level", "name").agg(F.count("*").alias("group_size"), F.min(best).alias("best"))
    # Texts of a large group meet their group row by a join that AQE splits.
    return rows.join(groups, ["level", "name"]).select(
        "doc_id", F.col("best.d").alias("keep_id"), "group_size", (F.col("row") == F.col("best.r")).alias("kept"),
        "text_sha256", "level", "name",
    )


def _identities(base: DataFrame) -> DataFrame:
    """(row, level, name) from (row, blocks)."""
    parts = base.select("row", F.size("blocks").alias("n"), F.posexplode("blocks").alias("at", "b"))
    names = _numbered(parts.select("b").distinct(), ["b"])
    done = [base.where(F.size("blocks") == 0).select("row", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("name"))]
    longest = base.agg(F.max(F.size("blocks"))).first()[0] or 0
    parts = parts.join(names, "b").select("row", "at", "name", "n")
    level = 0
    while longest > 1:
        parts = keep(parts)
        done.append(parts.where("n = 1").select("row", F.lit(level).alias("level"), "name"))
        even = F.col("at") % 2 == 0
        pairs = keep(
            parts.where("n > 1").groupBy("row", F.expr("at div 2").cast("int").alias("at"))
            .agg(F.max(F.when(even, F.col("name"))).alias("x"), F.max(F.when(~even, F.col("name"))).alias("y"),
                 F.max(F.expr("(n + 1) div 2").cast("int")).alias("n"))
            .withColumn("y", F.coalesce("y", F.lit(0).cast("long")))
        )
        names = _numbered(pairs.select("x", "y").distinct(), ["x", "y"])
        parts = pairs.join(names, ["x", "y"]).select("row", "at", "name", "n")
        level, longest = level + 1, (longest + 1) // 2
    done.append(parts.where("n = 1").select("row", F.lit(level).alias("level"), "name"))
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out
