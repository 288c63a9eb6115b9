"""Sports tables derived from the given tables, row by row: no window, join or collect.

Each derivation is mirrored in SQL in :mod:`rinkspark.plans.oracle`; both must stay equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkspark.streaming.tracker import frame_rows

VIDEOS = 16
CAMERAS = 8
EVENTS_PER_FRAME = 32
LANES = 6
PAD = 20
WIDTH, HEIGHT = 1280, 720


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(price: Column) -> Column:
    return F.floor(price * 100 + 0.5).cast("bigint")


def _boxes(lineitem: DataFrame, classes: int = 2) -> DataFrame:
    cents = _cents(F.col("l_extendedprice"))
    return lineitem.select(
        (F.col("l_orderkey") % VIDEOS).alias("video_id"),
        F.floor(F.col("l_orderkey") / VIDEOS).cast("bigint").alias("frame_idx"),
        ((F.col("l_partkey") * 10 + F.col("l_linenumber")) * 100000000 + cents).alias("det_id"),
        (F.col("l_quantity").cast("int") % classes + 1).alias("class_id"),
        (F.col("l_partkey") % 100 * 10).cast("double").alias("x"),
        (F.col("l_suppkey") % 100 * 5).cast("double").alias("y"),
        (F.col("l_quantity") + 40).alias("w"),
        (F.col("l_quantity") + 60).alias("h"),
        ((cents % 1000).cast("double") / 1000).alias("score"),
        (F.floor(F.col("l_tax") * 100 + 0.5).cast("bigint") * 6).cast("double").alias("shift"),
        (F.col("l_returnflag") != "R").alias("is_real"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two detections per line item: the box, and a weaker one 6 pixels to its right that competes with it."""
    base = _boxes(table(spark, sf_dir, "lineitem"))
    copies = F.explode(F.array(F.lit(0), F.lit(1))).alias("copy")
    both = base.select("*", copies)
    return both.select(
        "video_id",
        "frame_idx",
        (F.col("det_id") * 2 + F.col("copy")).alias("det_id"),
        "class_id",
        (F.col("x") + F.col("copy") * 6).alias("x"),
        "y",
        "w",
        "h",
        F.when(F.col("copy") == 1, F.col("score") * 0.9).otherwise(F.col("score")).alias("score"),
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True boxes: items that were not returned, each 0 to 48 pixels off its detection."""
    return (
        _boxes(table(spark, sf_dir, "lineitem"))
        .filter("is_real")
        .select(
            "video_id",
            "frame_idx",
            F.col("det_id").alias("gt_id"),
            "class_id",
            (F.col("x") + F.col("shift")).alias("x"),
            "y",
            "w",
            "h",
        )
    )


def scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of four classes: player, puck, goal and one without a label."""
    return _boxes(table(spark, sf_dir, "lineitem"), classes=4).drop("shift", "is_real")


def crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One video whose frames hold 500 orders each, far above the box cap."""
    boxes = _boxes(table(spark, sf_dir, "lineitem"))
    order = F.col("frame_idx") * VIDEOS + F.col("video_id")
    return boxes.select(
        F.lit(0).cast("bigint").alias("video_id"), F.floor(order / 500).cast("bigint").alias("frame_idx"), "det_id", "class_id", "score"
    )


# The label names of the fixture.
LABELS = ((1, "player"), (2, "puck"), (3, "goal"))


def label_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABELS, "id int, name string")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        (F.col("o_orderkey") % VIDEOS).alias("video_id"),
        F.floor(F.col("o_orderkey") / VIDEOS).cast("bigint").alias("frame_idx"),
    )


def videos_of(frame_table: DataFrame) -> DataFrame:
    """Videos of a frame table with frame rates that are not whole."""
    fps = F.col("video_id") * 2.497 + 1.5
    return frame_table.select("video_id").distinct().select("video_id", fps.alias("fps"))


def raw_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector output per order: 0 to 12 detections in arrays padded to 20 with zeros."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    n = (cust % 13).cast("int")
    used = F.slice(F.sequence(F.lit(0).cast("bigint"), F.lit(PAD - 1).cast("bigint")), F.lit(1), n)

    def padded(value, nothing: Column) -> Column:
        return F.concat(F.transform(used, value), F.array_repeat(nothing, F.lit(PAD) - n))

    def box(j: Column) -> Column:
        ymin = ((key * 7 + j * 53) % 600) / F.lit(720.0)
        xmin = ((cust * 11 + j * 97) % 1100) / F.lit(1280.0)
        ymax = ymin + (40 + (j * 13 + cust) % 80) / F.lit(720.0)
        xmax = xmin + (40 + (key + j * 29) % 120) / F.lit(1280.0)
        return F.array(*[c.cast("float") for c in (ymin, xmin, ymax, xmax)])

    zero = F.lit(0.0).cast("float")
    return table(spark, sf_dir, "orders").select(
        (key % VIDEOS).alias("video_id"),
        F.floor(key / VIDEOS).cast("bigint").alias("frame_idx"),
        n.cast("float").alias("num_detections"),
        padded(box, F.array(zero, zero, zero, zero)).alias("detection_boxes"),
        padded(lambda j: ((cust + j * 7) % 4 + 1).cast("float"), zero).alias("detection_classes"),
        padded(lambda j: (((key * 31 + cust * 17 + j * 271) % 1000) / F.lit(1000.0)).cast("float"), zero).alias("detection_scores"),
    )


def motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players skating to the right in six lanes; errors are missed detections."""
    events = table(spark, sf_dir, "events").filter("event_type <> 'error'")
    frame = F.floor(F.col("event_id") / EVENTS_PER_FRAME).cast("bigint")
    lane = F.floor(F.col("user_id") / CAMERAS).cast("bigint") % LANES
    return events.select(
        (F.col("user_id") % CAMERAS).alias("video_id"),
        frame.alias("frame_idx"),
        F.col("event_id").alias("det_id"),
        (lane * 120 + frame * 1.5 + F.col("event_id") % 7).cast("double").alias("x"),
        (F.col("event_id") % 5 + 200).cast("double").alias("y"),
        F.lit(60.0).alias("w"),
        F.lit(120.0).alias("h"),
    )


def motion_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame with an event of any kind, so some hold no detection."""
    return (
        table(spark, sf_dir, "events")
        .select(
            (F.col("user_id") % CAMERAS).alias("video_id"),
            F.floor(F.col("event_id") / EVENTS_PER_FRAME).cast("bigint").alias("frame_idx"),
        )
        .distinct()
    )


SLICES = 2
JITTER = 8


def arriving_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of :func:`motion` with their boxes and event time (one a second), and ``slice``, when they arrive.

    A frame may come up to eight frames late, in another slice than its neighbours.
    """
    per_frame = frame_rows(motion(spark, sf_dir), motion_frames(spark, sf_dir))
    arrival = F.col("frame_idx") + F.pmod(F.xxhash64("video_id", "frame_idx"), F.lit(JITTER + 1))
    last = table(spark, sf_dir, "events").agg(F.max(F.floor(F.col("event_id") / EVENTS_PER_FRAME)).cast("bigint")).first()[0] or 0
    timed = per_frame.withColumns({"ts": F.timestamp_seconds("frame_idx"), "slice": F.floor(arrival * SLICES / F.lit(last + JITTER + 1))})
    # the camera that nobody watches closes the stream: its frame comes after all others
    end = spark.createDataFrame([(-1, last + 3600)], "video_id long, frame_idx long")
    end = end.select("*", F.lit(None).cast(timed.schema["boxes"].dataType).alias("boxes"), F.timestamp_seconds("frame_idx").alias("ts"), F.lit(SLICES).cast("long").alias("slice"))
    return timed.unionByName(end)


def start_boxes(det: DataFrame) -> DataFrame:
    """Per video the detection with the lowest id, as two tracks: itself, and one 45 pixels off."""
    first = det.groupBy("video_id").agg(F.min(F.struct("frame_idx", "det_id", "x", "y", "w", "h")).alias("d"))
    tracks = F.explode(F.array(*[F.lit(i).cast("bigint") for i in (0, 1)])).alias("track_id")
    return first.select("video_id", tracks, "d.*").select(
        "video_id", "track_id", "frame_idx", (F.col("x") + F.col("track_id") * 45).alias("x"), "y", "w", "h"
    )


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One picture of 2 x 2 pixels per order: grey, colour, colour with alpha, or not decoded."""
    digest = F.unhex(F.md5(F.col("o_orderkey").cast("string").cast("binary")))
    channels = F.element_at(F.array(F.lit(1), F.lit(3), F.lit(4), F.lit(-1)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    side = F.when(channels > 0, F.lit(2)).otherwise(F.lit(-1))
    data = F.when(channels > 0, F.substring(digest, F.lit(1), channels * 4)).otherwise(F.unhex(F.lit("")))
    image = F.struct(
        F.lit("").alias("origin"), side.alias("height"), side.alias("width"), channels.alias("nChannels"), F.lit(-1).alias("mode"), data.alias("data")
    )
    return table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % VIDEOS).alias("video_id"),
        F.floor(F.col("o_orderkey") / VIDEOS).cast("bigint").alias("frame_idx"),
        image.alias("image"),
    )


def marks(pictures: DataFrame) -> DataFrame:
    """A box for two pictures in three, from one corner pixel to itself or past the picture."""
    at = (F.col("frame_idx") % 3).cast("double")
    boxes = pictures.select("video_id", "frame_idx", at.alias("x"), (F.col("video_id") % 2).cast("double").alias("y"), F.lit(5.5).alias("w"), at.alias("h"))
    return boxes.filter("x > 0")


def raw_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The players of :func:`motion` as raw detector output, boxes normalised; some frames hold none."""
    det = motion(spark, sf_dir)
    corner = F.array(F.col("y") / HEIGHT, F.col("x") / WIDTH, (F.col("y") + F.col("h")) / HEIGHT, (F.col("x") + F.col("w")) / WIDTH)
    one = det.select("video_id", "frame_idx", F.struct("det_id", corner.alias("box")).alias("d"))
    found = one.groupBy("video_id", "frame_idx").agg(F.array_sort(F.collect_list("d")).alias("d"))
    every = motion_frames(spark, sf_dir).join(found, ["video_id", "frame_idx"], "left")
    every = every.withColumn("d", F.coalesce("d", F.array().cast(found.schema["d"].dataType)))
    return every.select(
        "video_id",
        "frame_idx",
        F.size("d").cast("double").alias("num_detections"),
        F.col("d.box").alias("detection_boxes"),
        F.transform("d", lambda x: F.lit(1.0)).alias("detection_classes"),
        F.transform("d", lambda x: F.lit(0.9)).alias("detection_scores"),
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), F.col("value").alias("val_loss")
    )


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_log(spark, sf_dir).select(
        "run_id", "step", F.concat(F.lit("ckpt-"), F.col("step").cast("string")).alias("path")
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announced downloads: one per document; only the English ones announce a length."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.col("doc_id").cast("string"), F.lit(".mp4")).alias("filename"),
        F.when(F.col("lang") == "en", F.col("n_chars")).otherwise(F.col("n_chars") * F.lit(0)).alias("content_length"),
    )


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files present: the labelled documents; those of low quality have half their bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    whole = F.when(F.col("quality") == 1, F.col("n_chars")).otherwise(F.floor(F.col("n_chars") / 2).cast("bigint"))
    return (
        table(spark, sf_dir, "labels")
        .join(docs, "doc_id")
        .select(F.concat(F.col("doc_id").cast("string"), F.lit(".mp4")).alias("filename"), whole.alias("length"))
    )


def label_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label-map text per part: comments, a nested block, a quoted key, a repeated id, an id over the bound."""
    size = F.col("p_size")
    text = F.format_string(
        "# item { id: 5 name: 'no' }\nitem {\n  id: %d # id: 6\n  name: '%s'\n}\nitem {\n  name: \"id: 7 } %s\"\n  id: %d\n  display_name: \"%s\"\n}\n"
        "item {\n  keypoints { id: 8 label: 'x' }\n  id: %d\n  name: 'repeat'\n}\nitem {\n  id: %d\n  name: '%s'\n}\n",
        size, F.col("p_name"), F.col("p_type"), size + 1, F.col("p_brand"), size, size * 3, F.col("p_type"),
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("map_id"), text.alias("value"))


FEATURE_CLASSES = 10


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")
