"""What the operators share: staged tables in the cluster's shared folder, word rules, batches."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where none is named, one under the warehouse."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = context.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return named.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.staged_at = path
    return back


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of jobs that nothing refers to: it does when their plans are collected.

    The scheduler may hold the last job until another one has run.
    """
    gc.collect()
    spark.range(1).count()
    spark._jvm.System.gc()


def drop_staged(df: DataFrame) -> None:
    """Remove a table that ``staged`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(column: str = "text") -> Column:
    """A NULL text counts as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def words(text: str) -> list[bytes]:
    """Words of a text, A-Z in lower case: ``bytes`` fold and split by the ASCII rules alone."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number per row that stays the same in every job of a query.

    The number follows from the scan's splits, whose size would follow the executors at hand; the
    number of splits that Spark aims at is pinned for the session, so that a lost one changes nothing.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return df.withColumn(name, F.monotonically_increasing_id())


def slices(n: int, step: int) -> Iterator[slice]:
    for start in range(0, n, step):
        yield slice(start, min(n, start + step))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_value(spark: SparkSession, value):
    """Broadcast a driver value whose size has a stated bound."""
    context: SparkContext = spark.sparkContext
    return context.broadcast(value)
