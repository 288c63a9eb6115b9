import numpy as np
import pytest
from pyspark.sql import functions as F

from rinkspark.plans import lifecycle
from rinkspark.sources.examples import read_examples

from helpers import DET, TRUTH, image_rows, picture, pixels_of, png, random_scene, rows

LABELS = [(1, "player"), (2, "puck"), (3, "goal")]


def black(count, height=20, width=40):
    return [np.zeros((height, width, 3), np.uint8) for _ in range(count)]


def test_recognise_goals_by_containment(spark):
    def make():
        def predict(batch):
            n = len(batch)
            moved = np.where(batch[:, 0, 0, 0] > 0, 0.3, 0.8)  # a red first pixel: puck inside
            boxes = np.zeros((n, 8))
            boxes[:, :4] = [0.1, 0.2, 0.6, 0.6]
            boxes[:, 4], boxes[:, 5], boxes[:, 6], boxes[:, 7] = 0.3, moved, 0.35, moved + 0.02
            return {
                "num_detections": np.full(n, 2.0),
                "detection_boxes": boxes,
                "detection_classes": np.tile([3.0, 2.0], (n, 1)),
                "detection_scores": np.tile([0.75, 0.75], (n, 1)),
            }

        return predict

    pictures = black(4)
    pictures[2][0, 0, 2] = 255
    labels = spark.createDataFrame(LABELS, "id int, name string")
    frames = image_rows(spark, pictures)
    seen = lifecycle.recognise_goals(frames, make, labels, rule="containment")
    assert [r.message for r in seen.collect()] == ["Goal detected at frame 2"]
    assert lifecycle.recognise_goals(frames, make, labels).count() == 4


def test_live_goals_from_a_stream_of_frames(spark, tmp_path):
    """Frame in, message out, the model in the stream."""

    def make():
        def predict(batch):
            n = len(batch)
            seen = batch[:, 0, 0, 0] > 100
            return {"num_detections": seen, "detection_boxes": np.zeros((n, 4)), "detection_classes": np.full((n, 1), 3), "detection_scores": np.full((n, 1), 0.9)}

        return predict

    pictures = black(6)
    pictures[4][0, 0, 2] = 255
    frames, labels = image_rows(spark, pictures), spark.createDataFrame(LABELS, "id int, name string")
    frames.write.parquet(str(tmp_path / "in"))
    stream = lifecycle.live_goals(spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in")), make, labels)
    sink = stream.writeStream.format("memory").queryName("live_goals").option("checkpointLocation", str(tmp_path / "state"))
    sink.trigger(availableNow=True).start().awaitTermination()
    assert [r.message for r in spark.table("live_goals").collect()] == ["Goal detected at frame 4"]


def test_annotate_video(spark):
    raw = spark.createDataFrame(
        [(0, 0, 2.0, [[0.25, 0.25, 0.5, 0.5], [0.0, 0.0, 1.0, 1.0]], [1.0, 9.0], [0.9, 0.31]), (0, 1, 1.0, [[0.0, 0.0, 1.0, 1.0]], [1.0], [0.2])],
        "video_id long, frame_idx long, num_detections float, detection_boxes array<array<float>>, "
        "detection_classes array<float>, detection_scores array<float>",
    )
    labels = spark.createDataFrame(LABELS, "id int, name string")
    out = lifecycle.annotate_video(image_rows(spark, black(2)), raw, labels, 20, 40).orderBy("frame_idx").collect()
    assert out[0].texts == ["player: 90%", "N/A: 31%"] and out[1].texts is None
    assert (pixels_of(out[0])[5, 10] == [255, 0, 0]).all() and not pixels_of(out[1]).any()


def test_prepare_training(spark, tmp_path):
    frames = image_rows(spark, black(10)).withColumn("name", F.concat(F.lit("frame"), F.col("frame_idx").cast("string"), F.lit(".jpg")))
    videos = spark.createDataFrame([(0, 4.9)], "video_id long, fps double")
    truth = spark.createDataFrame([(0, f, 1, f, 1.0, 1.0, 2.0, 2.0) for f in range(10)], TRUTH)
    lifecycle.prepare_training(frames, videos, truth, str(tmp_path / "train"))
    back, objects = read_examples(spark, str(tmp_path / "train"))
    assert rows(back, "frame_idx", "label") == [(0, "frame0"), (4, "frame4"), (8, "frame8")]
    assert rows(objects, "id") == [(0,), (4,), (8,)]
    both = lifecycle.augmented_training_frames(frames, seed=1)
    assert both.count() == 20 and both.filter("name LIKE 'aug_frame%'").count() == 10


def test_evaluate(spark):
    det, truth = random_scene(21, frames=20, most=5)
    out = lifecycle.evaluate(spark.createDataFrame(det, DET), spark.createDataFrame(truth, TRUTH))
    keys = {(r["class_id"], r["key"]): r["value"] for r in out.collect()}
    assert {k for c, k in keys if c is None} == {"map", "map_50", "map_75"}
    assert keys[(None, "map")] == pytest.approx((keys[(1, "ap")] + keys[(2, "ap")]) / 2)
    assert 0 < keys[(1, "precision")] <= 1 and all(r["message"].startswith(r["key"]) for r in out.collect())


def test_folders_and_one_image(spark, tmp_path):
    folder = tmp_path / "camera7"
    folder.mkdir()
    for k in (3, 12):
        (folder / f"frame{k}.png").write_bytes(png(picture(k, 4, 6)))
    (folder / "cover.png").write_bytes(png(picture(1, 4, 6)))
    (folder / "broken.png").write_bytes(b"no picture")
    assert lifecycle.augment_folder(spark, str(folder), str(tmp_path / "aug"), seed=2) == {"loaded": 3, "skipped": 1}
    made = spark.read.parquet(str(tmp_path / "aug"))
    assert {r.name for r in made.collect()} == {"aug_frame3.png", "aug_frame12.png", "aug_cover.png"}
    assert lifecycle.label_folder(spark, str(folder), str(tmp_path / "labelled")) == {"loaded": 3, "skipped": 1}
    got = {r.name: r for r in spark.read.parquet(str(tmp_path / "labelled")).collect()}
    assert (got["frame12.png"].frame_idx, got["frame12.png"].video_id, got["frame12.png"].label) == (12, "camera7", "frame12")
    assert got["cover.png"].frame_idx >= 0

    def make():
        def predict(batch):
            n = len(batch)
            return {"num_detections": np.ones(n), "detection_boxes": np.zeros((n, 4)), "detection_classes": np.ones((n, 1)), "detection_scores": batch.mean(axis=(1, 2, 3)).reshape(n, 1)}

        return predict

    one = lifecycle.score_image(spark, str(folder / "frame3.png"), make).collect()
    assert [(r.name, r.num_detections) for r in one] == [("frame3.png", 1.0)]


def test_follow_players(spark):
    raw = spark.createDataFrame(
        [(0, f, 2.0, [[0.5, 0.1 + f / 100, 0.9, 0.3 + f / 100], [0.0, 0.0, 0.1, 0.1]], [1.0, 1.0], [0.9, 0.2]) for f in range(6)] + [(0, 6, 0.0, [], [], [])],
        "video_id long, frame_idx long, num_detections double, detection_boxes array<array<double>>, detection_classes array<double>, detection_scores array<double>",
    )
    start = spark.createDataFrame([(0, 0, 10.0, 10.0, 20.0, 8.0)], "video_id long, frame_idx long, x double, y double, w double, h double")
    videos = spark.createDataFrame([(0, 25.0)], "video_id long, fps double")
    notes, summary = lifecycle.follow_players(raw, start, videos, 20, 100)
    assert [r.success for r in notes.orderBy("frame_idx").collect()] == [True] * 5 + [False]
    row = summary.first()
    assert row.frames_seen == 5 and row.failures == 1 and row.path_length == pytest.approx(4.0)


def test_draw_players(spark):
    notes = spark.createDataFrame(
        [(0, 0, 1, True, 3.0, 2.0, 8.0, 6.0, None), (0, 1, 1, False, 9.0, 9.0, 1.0, 1.0, "lost"), (0, 0, 2, False, 3.0, 2.0, 8.0, 6.0, "lost")],
        "video_id long, track_id long, frame_idx long, success boolean, x double, y double, w double, h double, message string",
    )
    out = lifecycle.draw_players(image_rows(spark, black(4)), notes).orderBy("frame_idx").collect()
    assert (pixels_of(out[1])[2, 3] == [255, 0, 0]).all() and not pixels_of(out[1])[9, 9].any() and out[1].failures == ["lost"]
    assert not pixels_of(out[2]).any() and out[2].failures == ["lost"]
    assert not pixels_of(out[0]).any() and out[0].failures is None
