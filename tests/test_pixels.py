import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinkspark.operators import detections, goals, models, pixels

from rinkspark.sources.frames import write_frame_table

from helpers import image_rows, picture, pixels_of, rows


def in_order(df):
    return [pixels_of(r) for r in df.orderBy("frame_idx").collect()]


@pytest.fixture(scope="module")
def pictures():
    return [picture(1, 5, 7), picture(2, 12, 9), picture(3, 1, 1)]


def test_swap_is_an_involution(spark, pictures):
    frames = image_rows(spark, pictures)
    once = pixels.swap_channels(frames)
    assert once.schema == frames.schema
    assert all((a == b[..., ::-1]).all() for a, b in zip(in_order(once), pictures))
    assert all((a == b).all() for a, b in zip(in_order(pixels.swap_channels(once)), pictures))


def test_tensor(spark, pictures):
    got = [r.tensor for r in pixels.image_tensor(image_rows(spark, pictures)).orderBy("frame_idx").collect()]
    assert got == [p.astype(float).ravel().tolist() for p in pictures]


def test_tensor_rejects_a_wrong_length(spark):
    bad = image_rows(spark, [picture(1, 2, 2)]).withColumn("image", F.col("image").withField("height", F.lit(3)))
    with pytest.raises(Exception, match="channels"):
        pixels.image_tensor(bad).collect()


def test_grey_alpha_and_undecoded_images(spark):
    grey, colour = np.arange(6, dtype=np.uint8).reshape(2, 3, 1), np.arange(24, dtype=np.uint8).reshape(2, 3, 4)
    data = [(0, 0, ("g", 2, 3, 1, 0, grey.tobytes())), (0, 1, ("a", 2, 3, 4, 24, colour.tobytes())), (0, 2, ("bad", -1, -1, -1, -1, b"")), (0, 3, None)]
    frames = spark.createDataFrame(
        data, "video_id long, frame_idx long, image struct<origin:string, height:int, width:int, nChannels:int, mode:int, data:binary>"
    )
    swapped = {r.frame_idx: r.image for r in pixels.swap_channels(frames).collect()}
    assert bytes(swapped[0].data) == np.repeat(grey, 3, axis=2).tobytes() and swapped[0].nChannels == 3 and swapped[0].mode == 16
    assert bytes(swapped[1].data) == colour[..., 2::-1].tobytes()
    assert (swapped[2].height, swapped[2].nChannels, swapped[3]) == (-1, -1, None)
    tensors = {r.frame_idx: r.tensor for r in pixels.image_tensor(frames).collect()}
    assert len(tensors[0]) == 18 and tensors[2] is None and tensors[3] is None
    changed = {r.frame_idx: r.image for r in pixels.augment(frames, 5).collect()}
    assert len(changed[1].data) == 3 * changed[1].height * changed[1].width and changed[2].height == -1
    boxes = spark.createDataFrame([(0, f, 0.0, 0.0, 1.0, 1.0) for f in range(4)], "video_id long, frame_idx long, x double, y double, w double, h double")
    drawn = {r.frame_idx: r.image for r in pixels.draw_boxes(frames, boxes).collect()}
    assert drawn[0].nChannels == 3 and drawn[2].height == -1


def test_augmentation_parameters(spark):
    frames = spark.range(20000).select((F.col("id") % 7).alias("video_id"), F.col("id").alias("frame_idx"))
    params = pixels.aug_params(frames, 1)
    again = {tuple(r) for r in pixels.aug_params(frames.repartition(5), 1).collect()}
    assert {tuple(r) for r in params.collect()} == again
    s = params.agg(
        F.min("angle"), F.max("angle"), F.avg("angle"), F.min("scale"), F.max("scale"), F.avg(F.col("flip").cast("int")),
        F.corr("angle", "scale"), F.corr("angle", F.col("flip").cast("int")),
    ).first()
    assert -25 <= s[0] < -24.9 and 24.9 < s[1] < 25 and abs(s[2]) < 0.5
    assert 0.5 <= s[3] and s[4] < 1.5 and 0.48 < s[5] < 0.52
    assert abs(s[6]) < 0.05 and abs(s[7]) < 0.05
    assert pixels.aug_params(frames, 2).join(params, ["video_id", "frame_idx", "angle"]).count() < 100
    one = params.filter("video_id = 0").orderBy("frame_idx").toPandas()
    for lag in range(1, 9):  # neither steps nor waves over the frames of a video
        assert abs(one["angle"].autocorr(lag)) < 0.08 and abs(one["flip"].astype(float).autocorr(lag)) < 0.08
    shifted = pixels.aug_params(frames, 2).withColumn("frame_idx", F.col("frame_idx") + 1)
    assert shifted.join(params, ["frame_idx", "angle"]).count() < 100
    huge = spark.createDataFrame([(2**62, 2**62)], "video_id long, frame_idx long")
    assert pixels.aug_params(huge, 2**31).count() == 1


def augmented(spark, pictures, angle, scale, flip):
    frames = image_rows(spark, pictures).withColumns({"angle": F.lit(angle), "scale": F.lit(scale), "flip": F.lit(flip)})
    return in_order(pixels.apply_augmentation(frames))


def test_augmentation_identities(spark, pictures):
    assert all((a == b).all() for a, b in zip(augmented(spark, pictures, 0.0, 1.0, False), pictures))
    flipped = augmented(spark, pictures, 0.0, 1.0, True)
    assert all((a == b[:, ::-1]).all() for a, b in zip(flipped, pictures))
    assert all((a == b).all() for a, b in zip(augmented(spark, flipped, 0.0, 1.0, True), pictures))


def test_rotation_and_resize():
    square = picture(4, 9, 9)
    assert (pixels.rotate_nearest(square, 90.0) == np.rot90(square)).all() or (pixels.rotate_nearest(square, 90.0) == np.rot90(square, -1)).all()
    tilted = pixels.rotate_nearest(np.full((41, 41, 3), 255, np.uint8), 25.0)
    assert tilted.shape == (41, 41, 3) and (tilted[0, 0] == 0).all() and (tilted[20, 20] == 255).all()
    assert pixels.resize_nearest(square, 2.0).shape == (18, 18, 3)
    assert (pixels.resize_nearest(square, 2.0)[::2, ::2] == square).all()
    assert pixels.resize_nearest(picture(5, 3, 10), 0.5).shape == (2, 5, 3)
    assert pixels.resize_nearest(picture(5, 1, 1), 0.5).shape == (1, 1, 3)


def test_one_augmented_image_per_input(spark, pictures):
    out = pixels.augment(image_rows(spark, pictures), 3)
    assert out.columns == ["video_id", "frame_idx", "image"] and out.count() == 3
    params = {r.frame_idx: r.scale for r in pixels.aug_params(image_rows(spark, pictures), 3).collect()}
    for r in out.collect():
        h, w = pictures[r.frame_idx].shape[:2]
        assert r.image.height == max(1, int(h * params[r.frame_idx] + 0.5)) and len(r.image.data) == r.image.height * r.image.width * 3


def test_draw_boxes(spark):
    base = [np.zeros((20, 30, 3), np.uint8), picture(6, 20, 30)]
    boxes = spark.createDataFrame(
        [(0, 0, 5.9, 4.0, 10.0, 8.0), (0, 0, 5.9, 4.0, 10.0, 8.0), (0, 0, 25.0, 15.0, 50.0, 50.0), (9, 9, 0.0, 0.0, 1.0, 1.0)],
        "video_id long, frame_idx long, x double, y double, w double, h double",
    )
    frames = image_rows(spark, base)
    drawn = pixels.draw_boxes(frames, boxes)
    assert drawn.schema == frames.schema
    first, second = in_order(drawn)
    assert (second == base[1]).all()
    blue = (first == [255, 0, 0]).all(axis=2)
    assert blue[4, 5] and blue[3, 5] and blue[12, 15] and blue[8, 4] and blue[8, 5] and not blue[8, 6] and not blue[8, 10]
    assert blue[15, 29] and blue[19, 25] and not blue[19, 29]
    assert not base[0].any()


def test_decode_audit(spark):
    frames = image_rows(spark, [picture(1, 2, 2)] * 3)
    bad = frames.limit(1).withColumn("image", F.col("image").withField("height", F.lit(-1)))
    assert tuple(pixels.decode_audit(frames.unionByName(bad)).first()) == (3, 1)


def test_detector_end_to_end(spark):
    """Frames through a batched model to goal frames; the model sees RGB."""

    def make():
        def predict(batch):
            n = len(batch)
            red = batch[:, :, :, 0].mean(axis=(1, 2))
            boxes = np.tile(np.array([0.0, 0.0, 0.5, 0.5, 0.1, 0.1, 0.2, 0.2]), (n, 1))
            return {
                "num_detections": np.where(red > 100, 2.0, 0.0),
                "detection_boxes": boxes,
                "detection_classes": np.tile([3.0, 1.0], (n, 1)),
                "detection_scores": np.tile([0.75, 0.5], (n, 1)),
            }

        return predict

    bgr = [np.zeros((4, 6, 3), np.uint8) for _ in range(5)]
    bgr[1][..., 2] = 200  # red
    bgr[3][..., 0] = 200  # blue
    raw = models.detect(image_rows(spark, bgr), make, batch_size=2)
    flat = detections.explode_detections(detections.trim_detections(raw))
    assert rows(flat, "frame_idx", "det_pos", "class_id", "box.ymax") == [(1, 0, 3, 0.5), (1, 1, 1, pytest.approx(0.2))]
    labels = spark.createDataFrame([(1, "player"), (3, "goal")], "id int, name string")
    found = goals.goal_frames(detections.with_labels(flat, labels))
    assert rows(goals.goal_messages(found), "message") == [("Goal detected at frame 1",)]


def test_detector_takes_frames_of_any_size(spark):
    """Sizes mixed in one table, batches of one size each; undecoded frames have no detections; other columns stay."""

    def make():
        def predict(batch):
            n, height, width, _ = batch.shape
            assert batch.dtype == np.uint8 and n <= 3
            corner = batch[:, 0, 0].astype(float)
            return {
                "num_detections": np.ones(n),
                "detection_boxes": np.tile([0.0, 0.0, height, width], (n, 1, 1)),
                "detection_classes": corner[:, :1],
                "detection_scores": np.full((n, 1), n / 10),
            }

        return predict

    shapes = [(2, 3), (4, 1), (2, 3), (2, 3), (5, 5), (2, 3)]
    bgr = [picture(k, *shape) for k, shape in enumerate(shapes)]
    frames = image_rows(spark, bgr).coalesce(1)
    lost = frames.limit(1).withColumns({"frame_idx": F.lit(9).cast("long"), "image": F.lit(None).cast(frames.schema["image"].dataType)})
    raw = models.detect(frames.unionByName(lost).withColumn("name", F.concat(F.lit("f"), "frame_idx")), make, batch_size=3)
    got = {r.frame_idx: r for r in raw.collect()}
    for k, img in enumerate(bgr):
        r = got[k]
        assert (r.name, r.height, r.width, r.detection_boxes, r.detection_classes) == (f"f{k}", *img.shape[:2], [[0.0, 0.0, *img.shape[:2]]], [img[0, 0, 2]])
    assert (got[9].num_detections, got[9].detection_boxes, got[9].height) == (0.0, [], None)
    assert "Pandas" not in raw._jdf.queryExecution().executedPlan().toString()


def test_drawing_on_a_frame_table_moves_no_pixels(spark):
    base = [picture(k, 6, 8) for k in range(40)]
    frames = image_rows(spark, base)
    write_frame_table(frames, "drawn_frames", 8)
    boxes = spark.createDataFrame([(0, k, 1.0, 1.0, 4.0, 3.0) for k in range(0, 40, 3)], "video_id long, frame_idx long, x double, y double, w double, h double")
    stored = spark.table("drawn_frames")
    drawn = pixels.draw_boxes(stored, boxes)
    assert [a.tobytes() for a in in_order(drawn)] == [a.tobytes() for a in in_order(pixels.draw_boxes(frames, boxes))]
    plan = drawn._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0].splitlines()
    scan = next(k for k, line in enumerate(plan) if "drawn_frames" in line and "Scan" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    above = [line for k, line in enumerate(plan[:scan]) if depth(line) < depth(plan[scan]) and all(depth(x) > depth(line) for x in plan[k + 1 : scan + 1])]
    assert above and not [line for line in above if "Exchange" in line or " Sort " in line]
    spark.sql("DROP TABLE drawn_frames")


def test_score_calls_the_loader_once_per_worker(spark):
    def make():
        calls = []

        def predict(batch):
            calls.append(1)
            return batch[:, 0] * 2 + batch[:, 1]

        return predict

    df = spark.createDataFrame([([float(i), 1.0],) for i in range(50)], "v array<float>")
    got = models.score(df, make, "v", [2], T.FloatType(), batch_size=8)
    assert sorted(r.prediction for r in got.collect()) == [2.0 * i + 1 for i in range(50)]


def test_fit_save_load(spark, tmp_path):
    data = models.as_features(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"), "embedding")
    model = models.fit_classifier(data, max_iter=5)
    models.save_model(model, str(tmp_path / "model"))
    again = models.load_model(str(tmp_path / "model"))
    assert rows(model.transform(data), "vec_id", "prediction") == rows(again.transform(data), "vec_id", "prediction")
