"""Which downloads have landed whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkspark.functions.naming import file_name


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Name and length of the files of a folder; contents are not read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(file_name(F.col("path")).alias("filename"), "length")


def landing_status(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Bytes present of each manifest entry and ``status``.

    ``missing``: no file; ``unknown``: the announced total is 0 or absent; ``complete`` or
    ``partial`` otherwise. ``pct`` is NULL when the total is unknown.
    """
    have = F.coalesce("length", F.lit(0)).cast("bigint")
    total = F.coalesce("content_length", F.lit(0)).cast("bigint")
    status = (
        F.when(F.col("length").isNull(), F.lit("missing"))
        .when(total == 0, F.lit("unknown"))
        .when(have >= total, F.lit("complete"))
        .otherwise(F.lit("partial"))
    )
    return manifest.join(files, "filename", "left").select(
        "filename",
        have.alias("bytes_done"),
        total.alias("total"),
        F.try_divide(100.0 * have, total).alias("pct"),
        status.alias("status"),
    )
