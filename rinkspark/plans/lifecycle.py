"""The jobs a user runs end to end, composed of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rinkspark.functions.naming import aug_name, frame_label
from rinkspark.operators import curves, detections, frames, goals, matching, models, pixels, tracking
from rinkspark.sources.examples import export_examples
from rinkspark.sources.frames import keyed_frames, scan_images, write_frames
from rinkspark.streaming.alerts import class_ids, goal_alerts


def recognise_goals(
    frame_table: DataFrame,
    make_predict_fn: Callable,
    label_map: DataFrame,
    rule: str = "presence",
) -> DataFrame:
    """Frames of any sizes through a detector to the messages of the goal frames, in frame order."""
    raw = models.detect(frame_table, make_predict_fn)
    found = detections.explode_detections(detections.trim_detections(raw))
    sized = detections.to_pixels(found, F.col("width"), F.col("height"))
    named = detections.with_labels(sized, label_map).withColumnRenamed("det_pos", "det_id")
    return frames.in_frame_order(goals.goal_messages(goals.goal_frames(named, rule)))


def annotate_video(
    frame_table: DataFrame, raw: DataFrame, label_map: DataFrame, height: int, width: int
) -> DataFrame:
    """Frames with the borders of their best detections drawn in; the texts stay in ``texts``.

    Lazy: a consumer that wants frames one by one calls ``toLocalIterator`` on the result.
    """
    found = detections.explode_detections(detections.trim_detections(raw))
    drawn = detections.overlay(found, label_map, width, height)
    # the overlay is capped per frame, so are these arrays
    ranked = F.transform(F.array_sort(F.collect_list(F.struct("box_rank", "text"))), lambda t: t["text"])
    return pixels.draw_boxes(frame_table, drawn, gathered={"texts": ranked})


def prepare_training(
    frame_table: DataFrame,
    videos: DataFrame,
    truth: DataFrame,
    path: str,
    seconds: int = 1,
) -> None:
    """Sampled frames, their labels and truth boxes, written as training examples."""
    sampled = frames.sample_frames(frame_table, videos, seconds).drop("frame_interval")
    labelled = sampled.withColumn("label", frame_label(F.col("name")))
    kept = truth.join(sampled.select(*detections.FRAME), list(detections.FRAME), "left_semi")
    export_examples(labelled, kept, path)


def augmented_training_frames(labelled: DataFrame, seed: int) -> DataFrame:
    """Labelled frames and one augmented copy of each, named ``aug_...``."""
    copies = pixels.augment(labelled, seed).withColumn("name", aug_name(F.col("name")))
    return frames.training_frames(labelled, copies)


def folder_frames(spark: SparkSession, path: str) -> DataFrame:
    """The images of a folder as keyed frames; files that cannot be decoded are left out."""
    return keyed_frames(scan_images(spark, path, drop_invalid=True))


def _audited(images: DataFrame, write: Callable[[DataFrame], None]) -> dict[str, int]:
    """Write what was decoded; how many images were, and how many not, counted by the same scan."""
    audit = Observation("decode")
    bad = F.col("image.height") < 0
    seen = images.observe(audit, F.count_if(~bad).alias("loaded"), F.count_if(bad).alias("skipped"))
    write(keyed_frames(seen.filter(~bad)))
    return audit.get


def augment_folder(spark: SparkSession, path: str, out: str, seed: int) -> dict[str, int]:
    """One augmented copy of each image of a folder, named ``aug_...``, written as frames. Returns ``loaded`` and ``skipped``."""

    def write(found: DataFrame) -> None:
        copies = pixels.augment(found, seed)
        write_frames(copies.withColumn("name", aug_name(F.col("name"))), out)

    return _audited(scan_images(spark, path), write)


def label_folder(spark: SparkSession, path: str, out: str) -> dict[str, int]:
    """The images of a folder with their labels, written as frames. Returns ``loaded`` and ``skipped``."""
    return _audited(scan_images(spark, path), lambda found: write_frames(found.withColumn("label", frame_label(F.col("name"))), out))


def score_image(spark: SparkSession, path: str, make_predict_fn: Callable) -> DataFrame:
    """Raw detections of a model on one image, or on a folder of images of any sizes."""
    return models.detect(keyed_frames(scan_images(spark, path, suffixes=None, drop_invalid=True)), make_predict_fn)


def live_goals(frame_stream: DataFrame, make_predict_fn: Callable, label_map: DataFrame, min_score: float = detections.EVAL_SCORE) -> DataFrame:
    """Frames of a stream (or table) through a detector to goal messages, frame by frame, without state."""
    raw = models.detect(frame_stream, make_predict_fn).drop("height", "width")
    return goal_alerts(raw, class_ids(label_map), min_score)


def follow_players(
    raw: DataFrame, init_boxes: DataFrame, videos: DataFrame, height: int, width: int, algorithm: str = "iou",
    min_score: float = detections.DRAW_SCORE,
) -> tuple[DataFrame, DataFrame]:
    """From raw detections to annotated track rows and one summary per track.

    ``init_boxes`` are in pixels. The annotated rows that succeed have the columns ``draw_boxes`` wants.
    """
    found = detections.above_score(detections.explode_detections(detections.trim_detections(raw)), min_score)
    det = detections.to_pixels(found, width, height).withColumnRenamed("det_pos", "det_id")
    followed = tracking.track(det, init_boxes, raw.select(*detections.FRAME), algorithm)
    return tracking.annotate_tracks(followed), tracking.track_summary(followed, videos)


def draw_players(frame_table: DataFrame, notes: DataFrame) -> DataFrame:
    """Frames with the boxes of the players that were seen, and in ``failures`` the message of each track that was not.

    ``notes`` are the annotated rows of :func:`follow_players`.
    """
    seen = notes.withColumns({c: F.when(F.col("success"), F.col(c)) for c in tracking.BOX})
    lost = F.collect_list(F.when(~F.col("success"), F.struct("track_id", "message")))
    return pixels.draw_boxes(frame_table, seen, gathered={"failures": F.transform(F.array_sort(lost), lambda t: t["message"])})


def evaluate(
    det: DataFrame,
    truth: DataFrame,
    min_score: float = detections.EVAL_SCORE,
    min_iou: float = matching.IOU_THRESHOLD,
) -> DataFrame:
    """``(class_id, key, value, message)``: precision, recall and F1 of the sure detections, AP of all.

    Overall mAP values have a NULL ``class_id``.
    """
    sure = matching.match_voc(detections.above_score(det, min_score, strict=False), truth, min_iou)
    prf = curves.metric_rows(matching.detection_prf(sure, truth), ["class_id"])
    per_level = curves.coco_ap(det, truth)
    by_class = per_level.groupBy("class_id").agg(F.avg("ap").alias("ap"))
    overall = curves.coco_map(per_level).withColumn("class_id", F.lit(None).cast(det.schema["class_id"].dataType))
    rest = [curves.metric_rows(by_class, ["class_id"]), curves.metric_rows(overall, ["class_id"])]
    return prf.unionByName(rest[0]).unionByName(rest[1])
