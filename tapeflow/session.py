"""Session settings that every job in this package assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "tapeflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, skew-join splitting and UTC; ``conf`` overrides any key.

    On a cluster leave ``master`` unset and size ``spark.sql.shuffle.partitions``
    for the data; AQE coalesces what turns out small.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession, fallback: str) -> str:
    """The cluster's shared checkpoint folder, or ``fallback`` where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = fallback
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder
