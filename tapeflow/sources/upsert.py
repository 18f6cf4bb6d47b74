"""Changes to stored tables: new rows, replaced rows and deletions, by rewriting touched partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tapeflow.plans.tables import drop_folder, keep, scratch

GONE = "gone"
#: Rows, about, that one task orders and writes; a large partition becomes several files.
FILE_ROWS = 1 << 18


def versions(spark: SparkSession, path: str) -> DataFrame | None:
    """(version, rows, partitions) of the changes applied so far."""
    try:
        return spark.read.schema("version string, rows bigint, partitions bigint").parquet(f"{path}/_versions")
    except AnalysisException:
        return None


def applied(spark: SparkSession, path: str, version: str) -> bool:
    done = versions(spark, path)
    return done is not None and bool(done.where(F.col("version") == version).head(1))


def upsert(
    spark: SparkSession, path: str, changes: DataFrame, keys: Sequence[str], partition: str, version: str,
    file_rows: int = FILE_ROWS,
) -> bool:
    """Apply changes to the Parquet table under ``path``, partitioned by ``partition``; False if ``version`` is known.

    ``changes`` has the table's columns; rows with a true ``gone`` (optional) delete their key, others insert or
    replace it. ``keys`` include the partition column, and a key may occur once. Only partitions that hold a changed
    key are read and rewritten; those left without a row are dropped. The marker is written last: a run that
    fails before it is repeated and leaves the same. A missing table is created. Files are cut by key inside a
    partition, so that a large partition is not one task.
    """
    keys = list(keys)
    if partition not in keys:
        raise ValueError("the partition column must be one of the keys, or a change could leave its old row behind")
    if applied(spark, path, version):
        return False
    if GONE not in changes.columns:
        changes = changes.withColumn(GONE, F.lit(False))
    with scratch():
        changes = keep(changes)
        touched = keep(changes.select(partition).distinct())
        columns = [c for c in changes.columns if c != GONE]
        live = changes.where(~F.coalesce(F.col(GONE), F.lit(False))).select(*columns)
        try:
            there = _matched(spark.read.schema(live.schema).parquet(path), touched, [partition], "left_semi")
        except AnalysisException:
            merged = live
        else:
            merged = _matched(there, changes, keys, "left_anti").select(*columns).unionByName(live)
        # The table is read and replaced: the new rows are stored before the old ones go.
        merged = keep(merged)
        tasks = max(1, -(-merged.count() // file_rows))
        cut = merged.repartitionByRange(tasks, partition, *[k for k in keys if k != partition])
        cut.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
        for row in _matched(touched, merged.select(partition).distinct(), [partition], "left_anti").toLocalIterator():
            drop_folder(spark, f"{path}/{_folder(spark, partition, row[0])}")
        one = changes.agg(F.count(F.lit(1)).alias("rows")).crossJoin(touched.agg(F.count(F.lit(1)).alias("partitions")))
        one.select(F.lit(version).alias("version"), "rows", "partitions").write.mode("append").parquet(f"{path}/_versions")
    return True


def _matched(df: DataFrame, other: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A semi or anti join in which a missing key equals a missing key."""
    right = other.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(right, same, how)


def _folder(spark: SparkSession, column: str, value) -> str:
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    return f"{escape(column)}={'__HIVE_DEFAULT_PARTITION__' if value is None else escape(str(value))}"
