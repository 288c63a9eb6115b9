"""Image scans and frame tables, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.readwriter import DataFrameWriter
from pyspark.sql.streaming.readwriter import DataStreamWriter

from rinkspark.functions.naming import file_name

IMAGE_SUFFIXES = ("jpg", "png")


def scan_images(
    spark: SparkSession,
    path: str,
    suffixes: tuple[str, ...] | None = IMAGE_SUFFIXES,
    drop_invalid: bool = False,
    streaming: bool = False,
) -> DataFrame:
    """Decode the images of a folder or of one file (``image`` struct column, BGR).

    Suffixes are case-sensitive and the scan does not descend; ``suffixes=None`` takes every
    file. Undecodable files come back with height -1 unless ``drop_invalid``.
    """
    reader = (spark.readStream.schema(_image_schema()) if streaming else spark.read).format("image")
    if suffixes:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}")
    return reader.option("dropInvalid", drop_invalid).load(path)


def keyed_frames(images: DataFrame) -> DataFrame:
    """``video_id, frame_idx, name, image`` of scanned images, from the place each came from.

    ``video_id`` is the name of the folder, ``frame_idx`` the number at the end of the file's stem; a
    file without one gets a number that follows from its name.
    """
    origin = F.col("image.origin")
    name = file_name(origin)
    digits = F.regexp_extract(name, r"(\d{1,18})\.[^.]*$", 1)
    number = F.when(digits != "", digits.cast("bigint")).otherwise(F.xxhash64(name).bitwiseAND(F.lit(2**62 - 1)))
    folder = F.regexp_extract(origin, r"([^/]+)/[^/]*$", 1)
    return images.select(folder.alias("video_id"), number.alias("frame_idx"), name.alias("name"), "image")


def _image_schema() -> T.StructType:
    ints = [T.StructField(c, T.IntegerType()) for c in ("height", "width", "nChannels", "mode")]
    image = T.StructType([T.StructField("origin", T.StringType()), *ints, T.StructField("data", T.BinaryType())])
    return T.StructType([T.StructField("image", image)])


def read_frames(
    spark: SparkSession, path: str, streaming: bool = False, schema: T.StructType | None = None, files_per_trigger: int | None = None
) -> DataFrame:
    """Frame rows from parquet. A stream needs a schema, or takes it from the files present."""
    if not streaming:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _rebalanced(frames: DataFrame, max_frames_per_file: int, *by: str) -> DataFrameWriter:
    """A writer with few files per folder: rows of a folder meet in tasks of a target size, which Spark measures and splits."""
    return frames.hint("rebalance", *by).write.mode("overwrite").option("maxRecordsPerFile", max_frames_per_file).partitionBy(*by)


def write_frames(frames: DataFrame, path: str, max_frames_per_file: int = 1000, rebalance: bool = True) -> None:
    """Frames as parquet, one folder per video, replacing what was there.

    Tasks that hold a few frames of each video would write a file for each; rows are therefore rebalanced by video.
    ``rebalance=False`` leaves the pixels in the tasks that made them, for frames that come video by video.
    """
    if rebalance:
        _rebalanced(frames, max_frames_per_file, "video_id").parquet(path)
    else:
        frames.write.mode("overwrite").option("maxRecordsPerFile", max_frames_per_file).partitionBy("video_id").parquet(path)


def write_frame_table(frames: DataFrame, name: str, buckets: int) -> None:
    """Frames as a table that is dealt into buckets by frame: joins by frame move the other side only."""
    dealt = frames.repartition(buckets, "video_id", "frame_idx")
    dealt.write.mode("overwrite").bucketBy(buckets, "video_id", "frame_idx").format("parquet").saveAsTable(name)


def write_frame_stream(frames: DataFrame, path: str, checkpoint: str, max_frames_per_file: int = 1000) -> DataStreamWriter:
    """A stream of frames as parquet, one folder per batch and video; the caller starts it.

    A batch that is run again after a failure replaces its own folders and no others, so each frame is there once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        numbered = batch.withColumn("batch", F.lit(batch_id).cast("long"))
        _rebalanced(numbered, max_frames_per_file, "batch", "video_id").option("partitionOverwriteMode", "dynamic").parquet(path)

    return frames.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
