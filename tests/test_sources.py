import os

import pytest
from pyspark.sql import functions as F

from rinkspark.functions.naming import file_name, frame_label
from rinkspark.operators.pixels import decode_audit
from rinkspark.sources.examples import box_rows, export_examples, read_examples, with_objects
from rinkspark.sources.frames import read_frames, scan_images, write_frame_stream, write_frames
from rinkspark.sources.label_map import parse_label_maps, read_label_map
from rinkspark.sources.landing import landing_status, list_files

from helpers import TRUTH, image_rows, picture, pixels_of, png, rows


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("pictures")
    for i in range(3):
        (path / f"frame{i}.png").write_bytes(png(picture(i, 4, 6)))
    (path / "broken.jpg").write_bytes(b"not a picture")
    (path / "LOUD.JPG").write_bytes(png(picture(7, 4, 6)))
    (path / "notes.txt").write_text("no picture either")
    (path / "deep").mkdir()
    (path / "deep" / "below.png").write_bytes(png(picture(8, 4, 6)))
    return str(path)


def test_scan_filters_by_suffix_and_keeps_bad_files(spark, folder):
    scan = scan_images(spark, folder)
    names = rows(scan.select(file_name(F.col("image.origin")).alias("n"), (F.col("image.height") > 0).alias("ok")))
    assert names == [("broken.jpg", False), ("frame0.png", True), ("frame1.png", True), ("frame2.png", True)]
    assert tuple(decode_audit(scan).first()) == (3, 1)


def test_scan_decodes_to_bgr(spark, folder):
    one = scan_images(spark, os.path.join(folder, "frame1.png")).first()
    assert (pixels_of(one) == picture(1, 4, 6)[..., ::-1]).all()


def test_tolerant_scan(spark, folder):
    scan = scan_images(spark, folder, suffixes=None, drop_invalid=True)
    name = file_name(F.col("image.origin"))
    assert rows(scan.select(frame_label(name).alias("label"))) == [("LOUD",), ("frame0",), ("frame1",), ("frame2",)]


def test_streamed_scan(spark, folder):
    stream = scan_images(spark, folder, drop_invalid=True, streaming=True)
    query = stream.select("image.height").writeStream.format("memory").queryName("pictures").start()
    query.processAllAvailable()
    query.stop()
    assert rows(spark.table("pictures")) == [(4,)] * 3


def test_frames_round_trip_and_stream(spark, tmp_path):
    frames = image_rows(spark, [picture(i, 3, 4) for i in range(5)])
    path = str(tmp_path / "frames")
    write_frames(frames, path)
    write_frames(frames, path)
    back = read_frames(spark, path)
    assert back.count() == 5 and any("video_id=0" in d for d in os.listdir(path))
    assert all((pixels_of(r) == picture(r.frame_idx, 3, 4)).all() for r in back.collect())
    stream = read_frames(spark, path, streaming=True, files_per_trigger=1)
    query = stream.select("frame_idx").writeStream.format("memory").queryName("frames_in").start()
    query.processAllAvailable()
    query.stop()
    assert rows(spark.table("frames_in")) == [(i,) for i in range(5)]


def test_pixels_are_not_read_for_a_key_query(spark, tmp_path):
    path = str(tmp_path / "frames")
    write_frames(image_rows(spark, [picture(1, 3, 4)]), path)
    plan = read_frames(spark, path).filter("video_id = 0").select("frame_idx")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<frame_idx:bigint>" in plan and "PartitionFilters: [isnotnull(video_id" in plan


def test_examples(spark, tmp_path):
    frames = image_rows(spark, [picture(i, 2, 2) for i in range(3)])
    truth = [(0, 0, 1, i, float(i), 0.0, 5.0, 5.0) for i in range(1000)] + [(0, 1, 2, 7, 1.0, 2.0, 3.0, 4.0)]
    boxes = spark.createDataFrame(truth, TRUTH)
    for p in ("train", "val"):
        export_examples(frames, boxes, str(tmp_path / p))
    back, objects = read_examples(spark, str(tmp_path / "train"))
    assert rows(objects, "frame_idx", "id", "class_id", "x") == sorted(((r[1], r[3], r[2], r[4]) for r in truth), key=repr)
    assert rows(back, "frame_idx") == [(0,), (1,), (2,)] and back.filter("image IS NULL").count() == 0
    both = read_examples(spark, str(tmp_path / "train"), str(tmp_path / "val"))
    assert both[0].count() == 6 and both[1].count() == 2 * len(truth)
    whole = {r.frame_idx: r.objects for r in with_objects(frames.drop("image"), box_rows(boxes)).collect()}
    assert len(whole[0]) == 1000 and whole[2] == [] and [tuple(o) for o in whole[1]] == [(7, 2, 1.0, 2.0, 3.0, 4.0)]


def test_label_map_text_that_only_looks_like_items(spark):
    text = """
# item { id: 8 name: 'commented out' }
item { name: 'row id: 9' id: 2 }
item { id: 3 display_name: "brace } # here" keypoints { id: 77 label: "x" } }
item {
  id: 4  # id: 5
  name: "it's"
}
"""
    maps = spark.createDataFrame([(text,)], "value string")
    assert rows(parse_label_maps(maps), "id", "name") == [(2, "row id: 9"), (3, "brace } # here"), (4, "it's")]


def test_label_map(spark, tmp_path):
    (tmp_path / "map.pbtxt").write_text(
        """
item { id: 1 name: 'player' }
item {
  name: "/m/puck"
  id: 2
  display_name: "puck"
}
item{ id:3, name:'goal' }
item { id: 3 name: 'again' }
item { id: 0 name: 'background' }
item { id: 95 name: 'far' }
item { name: 'no id' }
"""
    )
    path = str(tmp_path / "map.pbtxt")
    assert rows(read_label_map(spark, path)) == [(1, "player"), (2, "puck"), (3, "goal")]
    assert rows(read_label_map(spark, path, max_num_classes=100))[-1] == (95, "far")


def test_landing(spark, tmp_path):
    for name, size in (("a.mp4", 10), ("b.mp4", 4), ("d.mp4", 3)):
        (tmp_path / name).write_bytes(b"x" * size)
    files = list_files(spark, str(tmp_path))
    assert rows(files) == [("a.mp4", 10), ("b.mp4", 4), ("d.mp4", 3)]
    assert "content" not in files._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    manifest = spark.createDataFrame(
        [("a.mp4", 10), ("b.mp4", 8), ("c.mp4", 5), ("d.mp4", 0), ("e.mp4", None)], "filename string, content_length long"
    )
    assert rows(landing_status(manifest, files)) == [
        ("a.mp4", 10, 10, 100.0, "complete"),
        ("b.mp4", 4, 8, 50.0, "partial"),
        ("c.mp4", 0, 5, 0.0, "missing"),
        ("d.mp4", 3, 0, None, "unknown"),
        ("e.mp4", 0, 0, None, "missing"),
    ]


def test_streamed_frames_are_there_once(spark, tmp_path):
    """A batch that is run again replaces its own folders; a video has few files, however many tasks hold its frames."""
    frames = image_rows(spark, [picture(k, 3, 4) for k in range(60)]).withColumn("video_id", F.col("frame_idx") % 3)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(2):
        frames.filter(f"frame_idx % 2 = {part}").repartition(6).write.mode("append").parquet(source)
        for _ in range(2):  # the second run finds the batch not marked as done, as after a crash
            sink = write_frame_stream(read_frames(spark, source, streaming=True, schema=frames.schema), out, str(tmp_path / "state"))
            sink.trigger(availableNow=True).start().awaitTermination()
            (tmp_path / "state" / "commits" / str(part)).unlink()
            (tmp_path / "state" / "commits" / f".{part}.crc").unlink(missing_ok=True)
        sink = write_frame_stream(read_frames(spark, source, streaming=True, schema=frames.schema), out, str(tmp_path / "state"))
        sink.trigger(availableNow=True).start().awaitTermination()
    back = spark.read.parquet(out)
    assert sorted(r.frame_idx for r in back.collect()) == list(range(60))
    assert all(len(list(p.glob("*.parquet"))) == 1 for p in (tmp_path / "out").glob("batch=*/video_id=*"))


def test_written_frames_have_few_files(spark, tmp_path):
    frames = image_rows(spark, [picture(k, 3, 4) for k in range(40)]).withColumn("video_id", F.col("frame_idx") % 4).repartition(8)
    write_frames(frames, str(tmp_path / "out"))
    assert [len(list(p.glob("*.parquet"))) for p in (tmp_path / "out").glob("video_id=*")] == [1] * 4
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40
