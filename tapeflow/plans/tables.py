"""Intermediate tables on shared storage."""

from __future__ import annotations

import contextlib
import contextvars
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from tapeflow.sources.store import scratch_folder

#: Folders to delete, a list per open ``scratch`` block, the innermost last.
_BLOCKS: contextvars.ContextVar[tuple[list, ...]] = contextvars.ContextVar("blocks", default=())


def keep(df: DataFrame) -> DataFrame:
    """Write a frame once and read it back: cuts lineage and stops repeated work.

    The folder lies under the cluster's ``spark.checkpoint.dir``, so a lost executor
    costs a re-read of Parquet and nothing else. Later steps prune its columns.
    Use it where a frame feeds several passes, after it has become small.
    """
    return _written(df, _BLOCKS.get())


def _written(df: DataFrame, blocks: tuple[list, ...]) -> DataFrame:
    spark = df.sparkSession
    folder = scratch_folder(spark)
    if blocks:
        blocks[-1].append((spark, folder))
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block whose kept tables are deleted at its end, however deep the calls that kept them.

    The block gets a function that keeps a result beyond it. Nothing lazy may leave the block
    in any other way.
    """
    own, outer = [], _BLOCKS.get()
    token = _BLOCKS.set((*outer, own))
    try:
        yield lambda df: _written(df, outer)
    finally:
        _BLOCKS.reset(token)
        for spark, folder in own:
            drop_folder(spark, folder)
