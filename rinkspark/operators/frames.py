"""Frame tables: sampling and the training set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkspark.functions.naming import frame_interval


def sample_frames(frames: DataFrame, videos: DataFrame, seconds: int = 1, on_zero: str = "raise") -> DataFrame:
    """Keep every ``int(fps * seconds)``-th frame, counted on the original frame index.

    A video with less than one frame per interval has interval 0: the query fails, or with
    ``on_zero="skip"`` the video yields nothing. The same holds for frames whose video or rate is unknown.
    """
    if on_zero not in ("raise", "skip"):
        raise ValueError("on_zero must be 'raise' or 'skip'")
    rates = videos.select("video_id", frame_interval(F.col("fps"), seconds).alias("frame_interval"))
    # No hint: Spark broadcasts the rates when their size allows, else the skew join splits a long video.
    joined = frames.join(rates, "video_id", "left")
    why = F.when(F.col("frame_interval").isNull(), "no frame rate for video ").otherwise("sampling interval below one frame in video ")
    bad = F.raise_error(F.concat(why, F.coalesce(F.col("video_id").cast("string"), F.lit("NULL"))))
    on_sample = F.col("frame_idx") % F.col("frame_interval") == 0
    if on_zero == "skip":
        on_sample = F.when(F.col("frame_interval") >= 1, on_sample)
    else:
        on_sample = F.when(F.col("frame_interval") >= 1, on_sample).otherwise(bad.cast("boolean"))
    return joined.filter(on_sample)


def training_frames(labelled: DataFrame, augmented: DataFrame) -> DataFrame:
    """Labelled frames and their augmented copies, as a bag."""
    return labelled.unionByName(augmented)


def in_frame_order(df: DataFrame) -> DataFrame:
    return df.orderBy("video_id", "frame_idx")
