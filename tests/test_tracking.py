import datetime
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rinkspark.operators import tracking
from rinkspark.streaming.tracker import FollowTarget, frame_rows, track_stream, use_rocksdb

from helpers import INIT, POINTS, random_motion, rows, track_rule

OUT = ("video_id", "track_id", "frame_idx", "success", "x", "y", "w", "h")


def starts(det, videos, tracks=3):
    out = []
    for v in range(videos):
        first = [d for d in det if d[0] == v][: 4 * tracks : 4]
        out += [(v, i, d[1], *d[3:]) for i, d in enumerate(first)]
    return out


def tables(spark, det, init, listed):
    frames = spark.createDataFrame(listed, "video_id long, frame_idx long")
    return spark.createDataFrame(det, POINTS), spark.createDataFrame(init, INIT), frames


@pytest.mark.parametrize(
    "seed,algorithm,chunk", [(1, "iou", 64), (2, "iou", 1), (3, "iou", 100_000), (4, "centroid", 40), (5, "centroid", 200)]
)
def test_track_equals_the_sequential_rule(spark, seed, algorithm, chunk):
    det, listed = random_motion(seed, videos=3, frames=200, objects=4)
    init = starts(det, 3)
    d, i, f = tables(spark, det, init, listed)
    want = track_rule(det, init, listed, algorithm)
    got = rows(tracking.track(d, i, f, algorithm, chunk_boxes=chunk), *OUT)
    assert got == want
    assert {r[3] for r in want} == {True, False}


@pytest.mark.parametrize("algorithm", ["iou", "centroid"])
def test_a_crowded_frame(spark, algorithm):
    det = [(0, 1, k, float(k % 200 * 60), float(k // 200 * 60), 40.0, 40.0) for k in range(30_000)]
    det += [(0, f, 100_000 + f, 605.0, 602.0, 40.0, 40.0) for f in (2, 3)]
    init = [(0, 0, 0, 602.0, 601.0, 40.0, 40.0)]
    d, i, f = tables(spark, det, init, [(0, f) for f in range(4)])
    got = rows(tracking.track(d, i, f, algorithm), *OUT)
    assert [r[2:5] for r in got] == [(1, True, 600.0), (2, True, 605.0), (3, True, 605.0)]


def test_ids_of_any_type(spark):
    det = [("cam", f, f"d{f}", 10.0 + f, 10.0, 30.0, 30.0) for f in range(6)]
    d = spark.createDataFrame(det, "video_id string, frame_idx long, det_id string, x double, y double, w double, h double")
    i = spark.createDataFrame([("cam", 0, 7, 10.0, 10.0, 30.0, 30.0)], "video_id string, frame_idx long, track_id long, x double, y double, w double, h double")
    got = tracking.track(d, i, chunk_boxes=2).orderBy("frame_idx").collect()
    assert [(r.track_id, r.frame_idx, r.success, r.x) for r in got] == [(7, f, True, 10.0 + f) for f in range(1, 6)]


def test_path_needs_no_frame_rate(spark):
    table = spark.createDataFrame([(0, 0, f, True, 10.0 * f, 0.0, 2.0, 2.0) for f in range(4)], "video_id long, track_id long, frame_idx long, success boolean, x double, y double, w double, h double")
    videos = spark.createDataFrame([(5, 25.0)], "video_id long, fps double")
    row = tracking.track_summary(table, videos).first()
    assert row.path_length == 30.0 and row.mean_speed is None and row.max_speed is None


def test_one_long_video_spans_chunks(spark):
    """One video holds nearly everything; its target is lost for several chunks and found again."""
    det = [(0, f, f, 100.0 + f % 3, 50.0, 60.0, 90.0) for f in range(300) if f < 40 or f >= 170]
    det += [(1, f, f, 10.0, 10.0, 20.0, 20.0) for f in range(3)]
    init = [(0, 0, 0, 100.0, 50.0, 60.0, 90.0), (1, 0, 0, 10.0, 10.0, 20.0, 20.0)]
    listed = [(0, f) for f in range(300)] + [(1, f) for f in range(3)]
    d, i, f = tables(spark, det, init, listed)
    got = rows(tracking.track(d, i, f, chunk_boxes=20), *OUT)
    assert got == track_rule(det, init, listed)
    assert sum(not r[3] for r in got) == 130


def test_copies_collapse_to_the_lowest_id(spark):
    det = [(0, f, 1000 * f + c, 10.0, 10.0, 30.0, 30.0) for f in range(4) for c in range(500)]
    init = [(0, 0, 0, 10.0, 10.0, 30.0, 30.0)]
    d, i, _ = tables(spark, det, init, [(0, 0)])
    assert [r[3] for r in rows(tracking.track(d, i), *OUT)] == [True] * 3


def test_target_never_seen(spark):
    det = [(0, f, f, 900.0, 900.0, 10.0, 10.0) for f in range(5)]
    init = [(0, 0, 2, 0.0, 0.0, 10.0, 10.0)]
    d, i, _ = tables(spark, det, init, [(0, 0)])
    assert rows(tracking.track(d, i), "frame_idx", "success", "x") == [(3, False, 0.0), (4, False, 0.0)]


def test_unknown_algorithm_fails_when_the_plan_is_built(spark):
    d, i, _ = tables(spark, [(0, 0, 0, 0.0, 0.0, 1.0, 1.0)], [(0, 0, 0, 0.0, 0.0, 1.0, 1.0)], [(0, 0)])
    with pytest.raises(ValueError, match="Invalid tracking algorithm"):
        tracking.track(d, i, algorithm="CSRT")
    with pytest.raises(ValueError, match="Invalid tracking algorithm"):
        track_stream(d, i, algorithm="")


STREAM = "video_id long, frame_idx long, ts timestamp, boxes array<struct<det_id long, x double, y double, w double, h double>>"


def followed(spark, tmp_path, name, init, algorithm, *parts, **options):
    """Each part a file that arrives alone; the stream starts anew from its checkpoint for each."""
    use_rocksdb(spark)
    source = str(tmp_path / "frames")
    for part in parts:
        part.select("video_id", "frame_idx", "ts", "boxes").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(STREAM).parquet(source)
        query = (
            track_stream(stream, init, algorithm, **options)
            .writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


@pytest.mark.parametrize("algorithm", ["iou", "centroid"])
def test_stream_out_of_order_equals_batch(spark, tmp_path, algorithm):
    """Frames come up to eight frames late, across batches and restarts."""
    det, listed = random_motion(11, videos=2, frames=60, objects=3)
    init = starts(det, 2, tracks=2)
    d, i, f = tables(spark, det, init, listed)
    timed = f.withColumn("ts", F.timestamp_seconds(F.col("frame_idx") / 2))
    per_frame = frame_rows(d, timed, "ts").withColumn("arrival", F.col("frame_idx") + F.abs(F.xxhash64("video_id", "frame_idx")) % 9)
    parts = [per_frame.filter(f"arrival >= {low} AND arrival < {low + 23}").orderBy(F.desc("frame_idx")) for low in (0, 23, 46)]
    closing = spark.createDataFrame([(-1, 0, 100, None)], "video_id long, frame_idx long, s long, boxes int")
    closing = closing.select("video_id", "frame_idx", F.timestamp_seconds("s").alias("ts"), F.lit(None).cast(per_frame.schema["boxes"].dataType).alias("boxes"))
    assert parts[0].agg(F.max("frame_idx")).first()[0] > parts[1].agg(F.min("frame_idx")).first()[0]
    got = followed(spark, tmp_path, algorithm, i, algorithm, *parts, closing, delay="5 seconds", slot_ms=700)
    assert rows(got, *OUT) == rows(tracking.track(d, i, f, algorithm, chunk_boxes=64), *OUT)
    assert got.agg(F.max("late_dropped")).first()[0] == 0


class Store:
    """State and timers of one track in plain Python; ``touched`` counts the entries read, written or listed."""

    def __init__(self):
        self.map, self.one, self.timers, self.touched = {}, None, set(), 0

    def getMapState(self, name, *_):
        return self

    def getValueState(self, name, *_):
        held = self
        return SimpleNamespace(get=lambda: held.one, exists=lambda: held.one is not None, update=lambda v: setattr(held, "one", v))

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def containsKey(self, key):
        self.touched += 1
        return key in self.map

    def getValue(self, key):
        self.touched += 1
        return self.map[key]

    def updateValue(self, key, value):
        self.touched += 1
        self.map[key] = value

    def removeKey(self, key):
        self.touched += 1
        del self.map[key]

    def keys(self):
        self.touched += len(self.map)
        return iter(list(self.map))


def test_a_large_batch_is_not_looked_over_per_frame():
    """State operations grow with the frames of a batch, not with their square."""
    n, store = 3000, Store()
    processor = FollowTarget("iou", 0.3, 50.0, 1000)
    processor.init(store)
    first = {"first_frame": -1, "i_x": 0.0, "i_y": 0.0, "i_w": 10.0, "i_h": 10.0}
    listed = [{"at": k * 1000 + 500, "frame_idx": k, "boxes": np.array([0.0, k % 3, 10.0, 10.0]), **first} for k in reversed(range(n))]
    list(processor.handleInputRows((0, 0), iter([pd.DataFrame(listed[:1700]), pd.DataFrame(listed[1700:])]), None))
    out, watermark = [], (n - 10) * 1000 + 700
    while store.timers and min(store.timers) <= watermark:
        at = min(store.timers)
        times, timer = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark), SimpleNamespace(getExpiryTimeInMs=lambda: at)
        out += [r for pdf in processor.handleExpiredTimer((0, 0), times, timer) for r in pdf.itertuples()]
        store.deleteTimer(at)
    assert [(r.frame_idx, r.success, r.y) for r in out] == [(k, True, k % 3) for k in range(n - 10)]
    assert min(store.timers) == (n - 9) * 1000
    assert store.touched <= 5 * n


def test_frames_behind_the_watermark_are_dropped(spark, tmp_path):
    box = [(1, 0.0, 0.0, 10.0, 10.0)]
    init = spark.createDataFrame([(0, 0, 0, 0.0, 0.0, 10.0, 10.0)], INIT)
    part = lambda *frames: spark.createDataFrame([(0, k, datetime.datetime(2024, 1, 1, 0, 0, k), b) for k, b in frames], STREAM)
    parts = [part((5, box), (30, box)), part((6, box), (31, None)), part((31, box), (59, None))]
    got = followed(spark, tmp_path, "late", init, "iou", *parts, delay="10 seconds")
    # 6 comes after the watermark has reached 20; 31 comes twice, the second time in place of the first
    assert rows(got, "frame_idx", "success") == [(30, True), (31, True), (5, True)]


def test_annotation(spark):
    tracks = spark.createDataFrame(
        [(0, 0, 1, True, 10.9, 20.2, 5.3, 6.9), (0, 0, 2, False, 10.9, 20.2, 5.3, 6.9), (0, 0, 3, True, -1.5, 0.0, 1.0, 1.0)],
        "video_id long, track_id long, frame_idx long, success boolean, x double, y double, w double, h double",
    )
    got = [(r.p1, r.p2, r.message) for r in tracking.annotate_tracks(tracks).orderBy("frame_idx").collect()]
    assert got[0] == ((10, 20), (16, 27), None)
    assert got[1] == (None, None, "Tracking failure detected")
    assert got[2] == ((-1, 0), (0, 1), None)


@pytest.mark.parametrize("chunk", [3, 4096])
def test_trajectory_and_summary(spark, chunk):
    data = [(0, 7, f, ok, x, 0.0, 2.0, 2.0) for f, ok, x in [(1, True, 0.0), (2, False, 0.0), (5, True, 3.0), (13, True, 3.0)]]
    data.append((0, 8, 4, True, 1.0, 1.0, 2.0, 2.0))
    tracks = spark.createDataFrame(
        data, "video_id long, track_id long, frame_idx long, success boolean, x double, y double, w double, h double"
    )
    videos = spark.createDataFrame([(0, 2.0)], "video_id long, fps double")
    moves = tracking.trajectory(tracks, videos, chunk).filter("track_id = 7").orderBy("frame_idx")
    assert [(r.frame_idx, r.dx, r.distance, r.speed) for r in moves.collect()] == [
        (1, None, None, None),
        (5, 3.0, 3.0, 1.5),
        (13, 0.0, 0.0, 0.0),
    ]
    assert rows(tracking.track_summary(tracks, videos, chunk)) == [
        (0, 7, 3, 1, 3.0, 0.5, 1.5),
        (0, 8, 1, 0, 0.0, None, None),
    ]
