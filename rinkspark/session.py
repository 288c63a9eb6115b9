"""Session settings the library expects, none of them tied to a machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # frames are wide: an Arrow batch is bounded by its bytes
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
}


def build_session(app: str = "rinkspark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; where none is named, one under the warehouse."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    # All executors share the warehouse, too; a machine's own folder would hide a missing setting.
    return (named or context.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints").rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def for_python(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle by ``keys`` into the configured number of partitions ahead of a grouped Python stage.

    Adaptive coalescing goes by bytes; Python work on few bytes can still be long, so the
    partitions are fixed here. The grouping that follows adds no shuffle of its own.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *keys)
