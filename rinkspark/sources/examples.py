"""Training examples as two tables: frames, and their boxes keyed by frame.

A frame's boxes are rows, not an array, so a crowded frame is no larger a row than any other, and
pixels are not shuffled to meet their boxes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkspark.operators.detections import FRAME


def box_rows(boxes: DataFrame, id_col: str = "gt_id") -> DataFrame:
    """``video_id, frame_idx, id, class_id, x, y, w, h``"""
    return boxes.select(*FRAME, F.col(id_col).alias("id"), "class_id", *"xywh")


def export_examples(frames: DataFrame, boxes: DataFrame, path: str, id_col: str = "gt_id", max_frames_per_file: int = 1000) -> None:
    """Write ``frames`` and ``boxes`` under ``path``, replacing what was there.

    Frames stay in the task that made them. Boxes are sorted by frame, so that a reader of one video
    skips the others' files; the number of files follows from their size.
    """
    frames.write.mode("overwrite").option("maxRecordsPerFile", max_frames_per_file).parquet(f"{path}/frames")
    ordered = box_rows(boxes, id_col).repartitionByRange(*FRAME).sortWithinPartitions(*FRAME, "id")
    ordered.write.mode("overwrite").parquet(f"{path}/boxes")


def read_examples(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """Frames and boxes of one or more exports."""
    return tuple(spark.read.parquet(*[f"{p}/{part}" for p in paths]) for part in ("frames", "boxes"))


def with_objects(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """Frames with their boxes as an array, for a consumer that wants whole examples of ordinary size."""
    fields = [c for c in boxes.columns if c not in FRAME]
    gathered = boxes.groupBy(*FRAME).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("objects"))
    joined = frames.join(gathered, list(FRAME), "left")
    return joined.withColumn("objects", F.coalesce("objects", F.array().cast(gathered.schema["objects"].dataType)))
