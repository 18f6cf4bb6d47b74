"""Order-book snapshots: assembling books from levels, and reading recorded history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeflow.functions.book import BOOK, BookRules
from tapeflow.functions.times import from_millis

LEVELS = "array<struct<price:double,size:double>>"
#: Levels, about, that one task orders.
TASK_ROWS = 1 << 20

# Fixed layout of a recorded snapshot.
SNAPSHOT_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("mid_price", T.DoubleType()),
        T.StructField("microprice", T.DoubleType()),
        T.StructField("micro_skew", T.DoubleType()),
        T.StructField("imbalance", T.DoubleType()),
        T.StructField("rel_spread", T.DoubleType()),
        T.StructField("bid_walls", T.LongType()),
        T.StructField("ask_walls", T.LongType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)


def deal_levels(levels: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """Levels dealt out by ``seq``, about ``rows`` to a task; as they are where all would fit one."""
    tasks = -(-levels.count() // rows)
    return levels.repartition(tasks, "seq") if tasks > 1 else levels


def assemble_books(levels: DataFrame, rules: BookRules = BOOK, rows: int = TASK_ROWS) -> DataFrame:
    """Books from single levels(symbol, ts, side, price, size, seq), best price first.

    A book is ``rules.depth`` levels deep by definition. The rank filter becomes a
    per-task group limit, so a crowded snapshot never gathers more than that. The limit
    orders all levels of its task, which a split of the input would make as large as
    files happen to be cut, so levels are dealt out first.
    """
    levels = deal_levels(levels, rows)
    best_first = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    rank = F.row_number().over(
        Window.partitionBy("symbol", "ts", "side").orderBy("_p", "seq")
    )
    kept = levels.withColumn("_p", best_first).withColumn("_r", rank).where(
        F.col("_r") <= rules.depth
    )
    level = F.struct(F.col("_r").alias("r"), F.col("price"), F.col("size"))

    def side(name):
        rows = F.sort_array(F.collect_list(F.when(F.col("side") == name, level)))
        return F.transform(rows, lambda x: F.struct(x.price.alias("price"), x["size"].alias("size")))

    return kept.groupBy("symbol", "ts").agg(side("bid").alias("bids"), side("ask").alias("asks"))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Recorded snapshots with a naive UTC time; ordering is left to the windows that need it."""
    raw = spark.read.schema(SNAPSHOT_SCHEMA).parquet(path)
    return raw.withColumn("ts", from_millis(F.col("timestamp")))
