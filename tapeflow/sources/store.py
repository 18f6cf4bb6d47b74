"""Dataset store: Parquet partitioned by kind and symbol, with a catalog from the data."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tapeflow.functions.times import seconds_between

KINDS = ("price", "news", "dataset", "dataset_news")
MAX_AGE_HOURS = 12.0


def dataset_kind(with_news: Column) -> Column:
    """Price-only and with-news variants never share a partition."""
    return F.when(with_news, "dataset_news").otherwise("dataset")


def save(df: DataFrame, path: str, kind: str, saved_at) -> None:
    """Replace the partitions this frame covers and leave the rest untouched."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}, got {kind!r}")
    # Files are cut by time inside a symbol so that a large symbol is not one task.
    out = df.withColumns({"kind": F.lit(kind), "saved_at": saved_at}).repartitionByRange(
        "symbol", "ts"
    )
    (
        out.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("kind", "symbol")
        .parquet(path)
    )


def load(spark: SparkSession, path: str, kind: str, symbol: str | None = None) -> DataFrame | None:
    """One kind (and symbol); partition filters prune the files. None when nothing is stored."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        return None
    df = df.where(F.col("kind") == kind)
    if symbol is not None:
        df = df.where(F.col("symbol") == symbol)
    return df if df.limit(1).count() else None


def delete(spark: SparkSession, path: str, symbol: str, kind: str | None = None) -> int:
    """Drop the folders of one kind, or of all kinds; returns how many went."""
    jvm, gone = spark._jvm, 0
    fs_of = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(
        spark.sparkContext._jsc.hadoopConfiguration()
    )
    for k in [kind] if kind else KINDS:
        name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(symbol)
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/kind={k}/symbol={name}")
        if fs_of.exists(folder):
            fs_of.delete(folder, True)
            gone += 1
    return gone


def catalog(df: DataFrame) -> DataFrame:
    """Rows, first and last time and save time per dataset; a map-side combined aggregate."""
    return df.groupBy("symbol", "kind").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.max("saved_at").alias("saved_at"),
    )


def with_age(cat: DataFrame, as_of: Column, max_age: float = MAX_AGE_HOURS) -> DataFrame:
    """Age in hours at a given moment, and whether it is still fresh."""
    seconds = seconds_between(F.col("saved_at"), as_of)
    return cat.withColumn("age_hours", seconds / F.lit(3600.0)).withColumn(
        "is_fresh", F.col("age_hours") <= max_age
    )


def scratch_folder(spark: SparkSession) -> str:
    """A new folder on the cluster's shared checkpoint path.

    Without that setting a job in one process takes a temporary folder; on a cluster,
    where executors do not share one, it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="tapeflow-")
    return f"{base.rstrip('/')}/run-{uuid.uuid4().hex}"
