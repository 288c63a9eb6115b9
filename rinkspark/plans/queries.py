"""The registered queries: every operator over the whole of the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinkspark.functions.naming import aug_name, file_name, frame_index, frame_label, frame_path
from rinkspark.operators import curves, detections, frames, goals, matching, models, pixels, runs, tracking, training
from rinkspark.plans import fixtures as fx
from rinkspark.plans import lifecycle
from rinkspark.sources.examples import box_rows, export_examples, read_examples, with_objects
from rinkspark.sources.frames import read_frames, write_frame_stream
from rinkspark.sources.label_map import parse_label_maps
from rinkspark.sources.landing import landing_status
from rinkspark.session import shared_folder
from rinkspark.streaming import tracker
from rinkspark.streaming.alerts import class_ids, goal_alerts
from rinkspark.streaming.tracker import use_rocksdb

Query = Callable[[SparkSession, str], DataFrame]
AUG_SEED = 7


def _exploded(spark: SparkSession, d: str) -> DataFrame:
    return detections.explode_detections(detections.trim_detections(fx.raw_detections(spark, d)))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return detections.with_labels(_exploded(spark, d), fx.label_map(spark))


def goal_frames(spark: SparkSession, d: str) -> DataFrame:
    return goals.goal_frames(_labelled(spark, d), "presence")


def goal_containment(spark: SparkSession, d: str) -> DataFrame:
    scene = detections.with_labels(fx.scene(spark, d), fx.label_map(spark))
    return goals.goal_frames(scene, "containment", min_score=0.0, inner="player")


def contained_pairs(spark: SparkSession, d: str) -> DataFrame:
    scene = detections.with_labels(fx.scene(spark, d), fx.label_map(spark))
    return goals.contained_pairs(scene)


def goal_messages(spark: SparkSession, d: str) -> DataFrame:
    return goals.goal_messages(goal_frames(spark, d))


def goal_alerts_batch(spark: SparkSession, d: str) -> DataFrame:
    return goal_alerts(fx.raw_detections(spark, d), class_ids(fx.label_map(spark)))


def trim_explode(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(spark, d).select("video_id", "frame_idx", "det_pos", "class_id", "score", "box.*")


def labelled_detections(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).select("video_id", "frame_idx", "det_pos", "class_id", "name")


def score_filter(spark: SparkSession, d: str) -> DataFrame:
    return detections.above_score(_exploded(spark, d)).select("video_id", "frame_idx", "det_pos", "score")


def pixel_boxes(spark: SparkSession, d: str) -> DataFrame:
    return detections.to_pixels(_exploded(spark, d), fx.WIDTH, fx.HEIGHT).select(
        "video_id", "frame_idx", "det_pos", *"xywh"
    )


def overlay_rows(spark: SparkSession, d: str) -> DataFrame:
    drawn = detections.overlay(_exploded(spark, d), fx.label_map(spark), fx.WIDTH, fx.HEIGHT, max_boxes=5)
    return drawn.select("video_id", "frame_idx", "det_pos", "box_rank", "text", *"xywh")


def top_boxes(spark: SparkSession, d: str) -> DataFrame:
    return detections.top_boxes(fx.crowded(spark, d)).select("video_id", "frame_idx", "det_id", "score", "box_rank")


def sample_frames(spark: SparkSession, d: str) -> DataFrame:
    all_frames = fx.frames(spark, d)
    return frames.sample_frames(all_frames, fx.videos_of(all_frames)).select("video_id", "frame_idx", "frame_interval")


def frame_names(spark: SparkSession, d: str) -> DataFrame:
    folder = F.concat(F.lit("out/"), F.col("video_id").cast("string"))
    named = fx.frames(spark, d).withColumn("path", frame_path(folder, F.col("frame_idx")))
    name = file_name(F.col("path"))
    return named.select(
        "video_id",
        "path",
        frame_index(F.col("path")).alias("frame_idx"),
        frame_label(name).alias("label"),
        aug_name(name).alias("aug_name"),
    )


def training_union(spark: SparkSession, d: str) -> DataFrame:
    labelled = fx.frames(spark, d).withColumn("name", F.concat(F.lit("frame"), F.col("frame_idx").cast("string"), F.lit(".jpg")))
    augmented = labelled.withColumn("name", aug_name(F.col("name")))
    return frames.training_frames(labelled, augmented)


def landing(spark: SparkSession, d: str) -> DataFrame:
    return landing_status(fx.manifest(spark, d), fx.landed(spark, d))


def label_map(spark: SparkSession, d: str) -> DataFrame:
    return parse_label_maps(fx.label_texts(spark, d), keys=("map_id",)).select("map_id", "id", "name")


def example_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    whole = with_objects(fx.frames(spark, d), box_rows(fx.truth(spark, d)))
    return whole.select("video_id", "frame_idx", F.explode("objects").alias("o")).select("video_id", "frame_idx", "o.*")


def examples_written(spark: SparkSession, d: str) -> DataFrame:
    """Training examples written to files, and their boxes read back."""
    at = f"{shared_folder(spark)}/examples-{uuid.uuid4().hex}"
    export_examples(fx.frames(spark, d), fx.truth(spark, d), at)
    whole = with_objects(*read_examples(spark, at))
    return whole.select("video_id", "frame_idx", F.explode("objects").alias("o")).select("video_id", "frame_idx", "o.*")


def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    return matching.iou_pairs(fx.detections(spark, d), fx.truth(spark, d), min_iou=0.1)


def _matches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    det, truth = fx.detections(spark, d), fx.truth(spark, d)
    return matching.match_voc(det, truth), truth


def voc_match(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d)[0]


def coco_match(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_coco(fx.detections(spark, d), fx.truth(spark, d))


def prf_by_class(spark: SparkSession, d: str) -> DataFrame:
    return matching.detection_prf(*_matches(spark, d))


def pr_curve(spark: SparkSession, d: str) -> DataFrame:
    return curves.pr_curve(*_matches(spark, d))


def average_precision(spark: SparkSession, d: str) -> DataFrame:
    matches, truth = _matches(spark, d)
    points = curves.pr_curve(matches, truth)
    both = None
    for method in ("all_point", "coco101"):
        ap = curves.area_under(points, truth, method).select(
            "class_id", F.lit(method).alias("method"), F.round("ap", 9).alias("ap"), "n_truth"
        )
        both = ap if both is None else both.unionByName(ap)
    return both


def coco_ap(spark: SparkSession, d: str) -> DataFrame:
    ap = curves.coco_ap(fx.detections(spark, d), fx.truth(spark, d))
    return ap.select("class_id", "min_iou", F.round("ap", 9).alias("ap"))


def coco_map(spark: SparkSession, d: str) -> DataFrame:
    ap = curves.coco_ap(fx.detections(spark, d), fx.truth(spark, d))
    return curves.coco_map(ap).select(*[F.round(c, 9).alias(c) for c in ("map", "map_50", "map_75")])


def metric_rows(spark: SparkSession, d: str) -> DataFrame:
    metrics = prf_by_class(spark, d)
    return curves.metric_rows(metrics, ["class_id"]).select("class_id", "key", "value")


def _tracks(spark: SparkSession, d: str, algorithm: str = "iou", chunk_boxes: int = tracking.CHUNK_BOXES) -> DataFrame:
    det = fx.motion(spark, d)
    return tracking.track(det, fx.start_boxes(det), fx.motion_frames(spark, d), algorithm, chunk_boxes=chunk_boxes)


def track_iou(spark: SparkSession, d: str) -> DataFrame:
    return _tracks(spark, d)


def track_centroid(spark: SparkSession, d: str) -> DataFrame:
    """Small chunks, so that routes cross many of them."""
    return _tracks(spark, d, "centroid", 512)


def track_stream(spark: SparkSession, d: str) -> DataFrame:
    """The frames arrive in slices, out of order; after each the stream goes on from its checkpoint."""
    use_rocksdb(spark)
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    arriving = fx.arriving_frames(spark, d)
    arriving.write.partitionBy("slice").parquet(f"{at}/arrived")
    init = fx.start_boxes(fx.motion(spark, d))
    schema = arriving.drop("slice").schema
    for part in range(fx.SLICES + 1):
        landed = spark.read.schema(schema).parquet(f"{at}/arrived/slice={part}")
        landed.write.mode("append").parquet(f"{at}/frames")
        followed = tracker.track_stream(spark.readStream.schema(schema).parquet(f"{at}/frames"), init)
        sink = followed.writeStream.format("parquet").option("path", f"{at}/tracks").option("checkpointLocation", f"{at}/state")
        sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(followed.schema).parquet(f"{at}/tracks").drop("late_dropped")


def _player_tracks(spark: SparkSession, d: str) -> DataFrame:
    """A track table of its own: each player one track, missed detections as failures."""
    events = fx.table(spark, d, "events")
    return events.select(
        (F.col("user_id") % fx.CAMERAS).alias("video_id"),
        F.col("user_id").alias("track_id"),
        F.col("event_id").alias("frame_idx"),
        (F.col("event_type") != "error").alias("success"),
        (F.col("value") * 10 + F.col("event_id") % 100).alias("x"),
        (F.col("event_id") % 5 + 200).cast("double").alias("y"),
        F.lit(60.5).alias("w"),
        F.lit(120.0).alias("h"),
    )


def track_annotation(spark: SparkSession, d: str) -> DataFrame:
    rows = tracking.annotate_tracks(_player_tracks(spark, d))
    return rows.select(
        "video_id",
        "track_id",
        "frame_idx",
        F.col("p1.x").alias("p1_x"),
        F.col("p1.y").alias("p1_y"),
        F.col("p2.x").alias("p2_x"),
        F.col("p2.y").alias("p2_y"),
        "message",
    )


def trajectory(spark: SparkSession, d: str) -> DataFrame:
    tracks = _player_tracks(spark, d)
    return tracking.trajectory(tracks, fx.videos_of(tracks)).select(
        "video_id", "track_id", "frame_idx", "dx", "dy", "distance", "speed"
    )


def track_summary(spark: SparkSession, d: str) -> DataFrame:
    tracks = _player_tracks(spark, d)
    return tracking.track_summary(tracks, fx.videos_of(tracks)).select(
        "video_id",
        "track_id",
        "frames_seen",
        "failures",
        F.round("path_length", 6).alias("path_length"),
        F.round("mean_speed", 8).alias("mean_speed"),
        "max_speed",
    )


def early_stop(spark: SparkSession, d: str) -> DataFrame:
    return runs.early_stop(fx.run_log(spark, d))


def checkpoints_kept(spark: SparkSession, d: str) -> DataFrame:
    return runs.keep_latest(fx.checkpoints(spark, d))


def latest_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    return runs.latest(fx.checkpoints(spark, d))


def aug_params(spark: SparkSession, d: str) -> DataFrame:
    return pixels.aug_params(fx.frames(spark, d), AUG_SEED)


def channel_swap(spark: SparkSession, d: str) -> DataFrame:
    swapped = pixels.swap_channels(fx.pictures(spark, d))
    return swapped.select("video_id", "frame_idx", F.lower(F.hex("image.data")).alias("data"), F.col("image.nChannels").alias("channels"))


def tensor_sums(spark: SparkSession, d: str) -> DataFrame:
    total = F.aggregate("tensor", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return pixels.image_tensor(fx.pictures(spark, d)).select("video_id", "frame_idx", total.alias("total"))


def decode_counts(spark: SparkSession, d: str) -> DataFrame:
    return pixels.decode_audit(fx.pictures(spark, d))


def augmented_sizes(spark: SparkSession, d: str) -> DataFrame:
    grown = pixels.augment(fx.pictures(spark, d), AUG_SEED)
    size = F.octet_length("image.data").cast("bigint")
    return grown.select("video_id", "frame_idx", F.col("image.height").alias("height"), F.col("image.width").alias("width"), size.alias("n_bytes"))


def _pixel_reader():
    """A linear stand-in for a detector: two boxes per picture, read off its first bytes."""

    def predict(batch: np.ndarray) -> dict:
        flat = batch.reshape(len(batch), -1)[:, :12].astype(np.float64)
        return {
            "num_detections": np.where(flat.sum(axis=1) > 1500, 2, 1),
            "detection_boxes": flat[:, :8] / 256,
            "detection_classes": flat[:, 8:10] % 4 + 1,
            "detection_scores": flat[:, 10:12] / 256,
        }

    return predict


def detect(spark: SparkSession, d: str) -> DataFrame:
    raw = models.detect(fx.pictures(spark, d), _pixel_reader).drop("height", "width")
    found = detections.explode_detections(detections.trim_detections(raw))
    return found.select("video_id", "frame_idx", "det_pos", "class_id", "score", "box.*")


def live_goals(spark: SparkSession, d: str) -> DataFrame:
    """Pictures stream through the detector to goal messages."""
    at = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    pictures = fx.pictures(spark, d)
    pictures.write.parquet(f"{at}/frames")
    stream = read_frames(spark, f"{at}/frames", streaming=True, schema=pictures.schema)
    messages = lifecycle.live_goals(stream, _pixel_reader, fx.label_map(spark))
    sink = messages.writeStream.format("parquet").option("path", f"{at}/messages").option("checkpointLocation", f"{at}/state")
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(messages.schema).parquet(f"{at}/messages")


def augmented_pixels(spark: SparkSession, d: str) -> DataFrame:
    grown = pixels.augment(fx.pictures(spark, d), AUG_SEED)
    return grown.select("video_id", "frame_idx", F.col("image.height").alias("height"), F.lower(F.hex("image.data")).alias("data"))


def drawn_pixels(spark: SparkSession, d: str) -> DataFrame:
    pictures = fx.pictures(spark, d)
    drawn = pixels.draw_boxes(pictures, fx.marks(pictures), thickness=1)
    return drawn.select("video_id", "frame_idx", F.lower(F.hex("image.data")).alias("data"))


def frames_landed(spark: SparkSession, d: str) -> DataFrame:
    """Pictures stream into the frame sink and are read back."""
    at = f"{shared_folder(spark)}/frames-{uuid.uuid4().hex}"
    pictures = fx.pictures(spark, d)
    pictures.write.parquet(f"{at}/source")
    stream = read_frames(spark, f"{at}/source", streaming=True, schema=pictures.schema)
    sink = write_frame_stream(stream, f"{at}/landed", f"{at}/state")
    sink.trigger(availableNow=True).start().awaitTermination()
    landed = spark.read.schema(pictures.schema).parquet(f"{at}/landed")
    size = F.octet_length("image.data").cast("bigint")
    return landed.select("video_id", "frame_idx", F.col("image.height").alias("height"), size.alias("n_bytes"))


def players_summary(spark: SparkSession, d: str) -> DataFrame:
    det = fx.motion(spark, d)
    videos = det.select("video_id").distinct().withColumn("fps", F.lit(25.0))
    summary = lifecycle.follow_players(fx.raw_players(spark, d), fx.start_boxes(det), videos, fx.HEIGHT, fx.WIDTH)[1]
    return summary.select("video_id", "track_id", "frames_seen", "failures")


def frames_in_order(spark: SparkSession, d: str) -> DataFrame:
    return frames.in_frame_order(fx.frames(spark, d))


def _row_sums():
    def predict(batch: np.ndarray) -> np.ndarray:
        return batch.astype(np.float64).sum(axis=1)

    return predict


def score_linear(spark: SparkSession, d: str) -> DataFrame:
    scored = models.score(fx.features(spark, d), _row_sums, "embedding", [64], T.DoubleType())
    return scored.select("vec_id", F.round("prediction", 4).alias("prediction"))


def _fitted(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """The log of three epochs of two batches on the feature vectors, and where the run is."""
    at = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    held_out, batch = F.col("vec_id") % 5 == 0, F.col("vec_id") % 2
    log = training.train(fx.features(spark, d), at, fx.FEATURE_CLASSES, epochs=3, batches=2, rate=0.5, held_out=held_out, batch_of=batch)
    return log, at


def evaluate_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    report = training.evaluate_latest(fx.features(spark, d), _fitted(spark, d)[1])
    return report.select("step", "n", F.round("loss", 9).alias("loss"), F.round("accuracy", 9).alias("accuracy"))


def fit_log(spark: SparkSession, d: str) -> DataFrame:
    log, _ = _fitted(spark, d)
    return log.select("step", F.round("val_loss", 9).alias("val_loss"))


QUERIES: dict[str, Query] = {
    "goal_frames": goal_frames,
    "goal_containment": goal_containment,
    "contained_pairs": contained_pairs,
    "goal_messages": goal_messages,
    "goal_alerts": goal_alerts_batch,
    "trim_explode": trim_explode,
    "labelled_detections": labelled_detections,
    "score_filter": score_filter,
    "pixel_boxes": pixel_boxes,
    "overlay_rows": overlay_rows,
    "top_boxes": top_boxes,
    "sample_frames": sample_frames,
    "frame_names": frame_names,
    "training_union": training_union,
    "landing_status": landing,
    "label_map": label_map,
    "example_roundtrip": example_roundtrip,
    "examples_written": examples_written,
    "iou_pairs": iou_pairs,
    "voc_match": voc_match,
    "coco_match": coco_match,
    "prf_by_class": prf_by_class,
    "pr_curve": pr_curve,
    "average_precision": average_precision,
    "coco_ap": coco_ap,
    "coco_map": coco_map,
    "metric_rows": metric_rows,
    "track_iou": track_iou,
    "track_centroid": track_centroid,
    "track_stream": track_stream,
    "track_annotation": track_annotation,
    "trajectory": trajectory,
    "track_summary": track_summary,
    "early_stop": early_stop,
    "checkpoints_kept": checkpoints_kept,
    "latest_checkpoint": latest_checkpoint,
    "frames_in_order": frames_in_order,
    "aug_params": aug_params,
    "channel_swap": channel_swap,
    "tensor_sums": tensor_sums,
    "decode_counts": decode_counts,
    "augmented_sizes": augmented_sizes,
    "detect": detect,
    "live_goals": live_goals,
    "augmented_pixels": augmented_pixels,
    "drawn_pixels": drawn_pixels,
    "frames_landed": frames_landed,
    "players_summary": players_summary,
    "score_linear": score_linear,
    "fit_log": fit_log,
    "evaluate_checkpoint": evaluate_checkpoint,
}
