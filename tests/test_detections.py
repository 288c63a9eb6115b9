import os

import pytest
from pyspark.sql import functions as F

from rinkspark.functions.naming import aug_name, frame_index, frame_label, frame_path
from rinkspark.operators import detections, frames, goals
from rinkspark.streaming.alerts import class_ids, goal_alerts

from helpers import rows

RAW = (
    "video_id long, frame_idx long, num_detections float, detection_boxes array<array<float>>, "
    "detection_classes array<float>, detection_scores array<float>, detection_masks array<string>"
)
B = [0.0, 0.25, 0.5, 0.75]
LABELS = [(1, "player"), (2, "puck"), (3, "goal"), (0, "nothing"), (91, "too far")]


def raw(spark, *items):
    return spark.createDataFrame(
        [(0, i, float(n), [B] * len(c), c, s, [str(j) for j in range(len(c))]) for i, (n, c, s) in enumerate(items)], RAW
    )


def test_trim_and_explode(spark):
    table = raw(
        spark, (0, [1.0, 2.0], [0.5, 0.5]), (1, [1.9, 2.0], [0.5, 0.25]), (5, [3.0, 2.0], [0.5, 0.25]), (1.9, [2.0, 9.0], [1.0, 0.0])
    )
    trimmed = detections.trim_detections(table)
    assert [(r.num_detections, r.detection_classes, len(r.detection_masks)) for r in trimmed.orderBy("frame_idx").collect()] == [
        (0, [], 0),
        (1, [1], 1),
        (5, [3, 2], 2),
        (1, [2], 1),
    ]
    flat = detections.explode_detections(trimmed)
    assert set(flat.columns) == {"video_id", "frame_idx", "det_pos", "box", "class_id", "score", "detection_masks"}
    assert rows(flat, "frame_idx", "det_pos", "class_id", "score", "detection_masks") == [
        (1, 0, 1, 0.5, "0"),
        (2, 0, 3, 0.5, "0"),
        (2, 1, 2, 0.25, "1"),
        (3, 0, 2, 1.0, "0"),
    ]
    pixel = detections.to_pixels(flat, 200, 100).first()
    assert (pixel.x, pixel.y, pixel.w, pixel.h) == (50.0, 0.0, 100.0, 50.0)


def test_negative_count_and_nan_class(spark):
    with pytest.raises(Exception, match="negative"):
        detections.trim_detections(raw(spark, (-1, [1.0], [0.5]))).collect()
    bad = raw(spark, (1, [float("nan")], [0.5]))
    with pytest.raises(Exception):
        detections.trim_detections(bad).collect()
    assert detections.trim_detections(bad, nan_class="null").first().detection_classes == [None]


def test_labels_thresholds_and_text(spark):
    label_map = spark.createDataFrame(LABELS, "id int, name string")
    det = spark.createDataFrame(
        [(0, 0, p, c, s) for p, (c, s) in enumerate([(1, 0.3), (2, 0.305), (7, 0.5), (91, 0.995)])],
        "video_id long, frame_idx long, det_pos long, class_id long, score double",
    )
    named = detections.with_labels(det, label_map)
    text = detections.display_text(F.col("name"), F.col("score"))
    assert rows(named, "det_pos", text) == [(0, "player: 30%"), (1, "puck: 31%"), (2, "N/A: 50%"), (3, "too far: 100%")]
    assert detections.above_score(det, 0.3).count() == 3
    assert detections.above_score(det, 0.3, strict=False).count() == 4


def test_every_label_given_is_joined_once(spark):
    labels = spark.createDataFrame([(95, "late", 0), (3, "z first", 1), (3, "a second", 2)], "id int, name string, pos int")
    det = spark.createDataFrame([(0, 0, 0, 95), (0, 0, 1, 3), (0, 0, 2, None)], "video_id long, frame_idx long, det_pos long, class_id long")
    assert rows(detections.with_labels(det, labels), "det_pos", "name") == [(0, "late"), (1, "z first"), (2, "N/A")]


def test_null_arrays_cost_no_rows(spark):
    table = spark.createDataFrame(
        [(0, 0, 2, [[0.0] * 4, [1.0] * 4], [1, 2], [0.5, 0.6], None)],
        "video_id long, frame_idx long, num_detections int, detection_boxes array<array<double>>, detection_classes array<bigint>, detection_scores array<double>, masks array<int>",
    )
    got = detections.explode_detections(table)
    assert rows(got, "det_pos", "class_id", "masks") == [(0, 1, None), (1, 2, None)]


def test_top_boxes_limits_before_the_shuffle(spark):
    det = spark.range(2000).select(
        F.floor(F.col("id") / 5000).alias("video_id"), F.floor(F.col("id") / 3000).alias("frame_idx"), F.col("id").alias("det_id"), (F.col("id") % 10 / 10).alias("score")
    )
    top = detections.top_boxes(det, 5)
    assert sorted(rows(top, "det_id", "box_rank")) == [(9 + 10 * i, i + 1) for i in range(5)]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def scene(spark):
    data = [
        (0, 0, 1, "goal", 0.9, 100.0, 100.0, 400.0, 300.0),
        (0, 0, 2, "puck", 0.6, 490.0, 150.0, 20.0, 20.0),  # centre on the border
        (0, 0, 3, "puck", 0.7, 500.5, 150.0, 20.0, 20.0),  # just outside
        (0, 0, 4, "goal", 0.6, 0.0, 0.0, 900.0, 900.0),
        (0, 1, 5, "puck", 0.9, 150.0, 150.0, 10.0, 10.0),  # no goal in its frame
        (0, 2, 6, "goal", 0.4, 0.0, 0.0, 50.0, 50.0),
    ]
    return spark.createDataFrame(
        data, "video_id long, frame_idx long, det_id long, name string, score double, x double, y double, w double, h double"
    )


def test_goal_rules(spark):
    det = scene(spark)
    assert rows(goals.contained_pairs(det, cell_scale=0.5), "inner_id", "outer_id") == [(2, 1), (2, 4), (3, 4)]
    assert rows(goals.goal_frames(det, "presence")) == [(0, 0, 2, 0.9)]
    assert rows(goals.goal_frames(det, "containment")) == [(0, 0, 2, 0.7)]
    assert rows(goals.goal_frames(det, F.col("name") == "puck")) == [(0, 0, 2, 0.7), (0, 1, 1, 0.9)]
    assert rows(goals.goal_messages(goals.goal_frames(det)), "message") == [("Goal detected at frame 0",)]
    with pytest.raises(ValueError):
        goals.goal_frames(det, "guess")


def test_alert_stream_equals_batch(spark, tmp_path):
    label_map = spark.createDataFrame(LABELS, "id int, name string")
    table = raw(spark, (2, [3.0, 1.0], [0.5, 0.9]), (1, [1.0, 3.0], [0.9, 0.9]), (2, [3.0, 3.0], [0.4, 0.49]), (0, [], []))
    ids = class_ids(label_map)
    assert ids == [3]
    table.write.parquet(str(tmp_path / "raw"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "raw"))
    alerts = goal_alerts(stream, ids)
    query = alerts.writeStream.format("memory").queryName("alerts").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    flat = detections.explode_detections(detections.trim_detections(table))
    batch = goals.goal_messages(goals.goal_frames(detections.with_labels(flat, label_map)))
    assert rows(spark.table("alerts")) == rows(batch) == [(0, 0, "Goal detected at frame 0")]
    assert goal_alerts(table, []).count() == 0


def test_names(spark):
    names = ["frame12.jpg", "a.b.c", ".hidden", "..x", "..x.y", "plain", "dot.", "a b.png", "", "...", ".a.b"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: r.label for r in df.select("name", frame_label(F.col("name")).alias("label")).collect()}
    assert got == {n: os.path.splitext(n)[0] for n in names}
    one = spark.range(1).select(frame_path("out", F.lit(7)).alias("p"), aug_name(F.lit("a.png")).alias("a"))
    assert one.first() == ("out/frame7.jpg", "aug_a.png")
    back = one.select(frame_index(F.col("p")), frame_index(F.lit("out/xframe7.jpg"))).first()
    assert tuple(back) == (7, None)


def test_sampling(spark):
    everything = spark.createDataFrame([(v, f) for v in (1, 2, 3) for f in range(100)], "video_id long, frame_idx long")
    table = everything.filter("video_id < 3")
    videos = spark.createDataFrame([(1, 29.97), (2, 1.0), (4, 0.5)], "video_id long, fps double")
    got = rows(frames.sample_frames(table, videos), "video_id", "frame_idx")
    assert [r[1] for r in sorted(got) if r[0] == 1] == [0, 29, 58, 87]
    assert sum(r[0] == 2 for r in got) == 100
    with pytest.raises(Exception, match="no frame rate for video 3"):
        frames.sample_frames(everything, videos).collect()
    assert rows(frames.sample_frames(everything, videos, on_zero="skip"), "video_id", "frame_idx") == got
    slow = spark.createDataFrame([(1, 0.5), (2, 30.0)], "video_id long, fps double")
    with pytest.raises(Exception, match="below one frame"):
        frames.sample_frames(table, slow).collect()
    skipped = frames.sample_frames(table, slow, on_zero="skip")
    assert {r.video_id for r in skipped.collect()} == {2}
    assert rows(frames.sample_frames(table, slow, seconds=2), "frame_idx")[0] == (0,)


def test_union_keeps_copies(spark):
    one = spark.createDataFrame([(1, "a")], "frame_idx long, name string")
    other = spark.createDataFrame([("a", 1)], "name string, frame_idx long")
    assert frames.training_frames(one, other).count() == 2


def test_a_class_is_not_one_task_of_the_label_join(spark):
    """Detections of one class are spread over the shuffle's partitions."""
    det = spark.range(20_000).selectExpr("id % 4 AS video_id", "id AS frame_idx", "1 AS class_id", "id AS det_id")
    labels = spark.createDataFrame([(1, "player")], "id int, name string")
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        named = detections.with_labels(det, labels).select("name", F.spark_partition_id().alias("part"))
        sizes = [r["count"] for r in named.filter("name = 'player'").groupBy("part").count().collect()]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 20_000 and max(sizes) < 10_000
