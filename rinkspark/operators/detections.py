"""From padded detector output to labelled, ranked, drawable detection rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAME = ("video_id", "frame_idx")

# The drawing threshold and box cap, the evaluation threshold, the label-id bound.
DRAW_SCORE = 0.30
MAX_BOXES = 200
EVAL_SCORE = 0.5
MAX_CLASSES = 90


def _array_fields(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]


def trim_detections(raw: DataFrame, nan_class: str = "raise") -> DataFrame:
    """Cut every array column to ``num_detections`` and make the classes whole numbers.

    A count above the array length keeps the array; a negative count fails. Classes are
    truncated. A NaN class fails, or becomes NULL with ``nan_class="null"``.
    """
    if nan_class not in ("raise", "null"):
        raise ValueError("nan_class must be 'raise' or 'null'")
    n = F.col("num_detections").cast("int")
    n = F.when(n >= 0, n).otherwise(F.raise_error(F.lit("num_detections is negative or missing")).cast("int"))

    def whole(classes: Column) -> Column:
        if nan_class == "raise":
            return classes.cast("array<bigint>")
        return F.transform(classes, lambda c: c.try_cast("bigint"))

    columns = []
    arrays = set(_array_fields(raw))
    for name in raw.columns:
        if name == "num_detections":
            columns.append(n.alias(name))
        elif name in arrays:
            cut = F.slice(F.col(name), F.lit(1), n)
            columns.append((whole(cut) if name == "detection_classes" else cut).alias(name))
        else:
            columns.append(F.col(name))
    return raw.select(*columns)


def explode_detections(trimmed: DataFrame) -> DataFrame:
    """One row per array position, 0-based in ``det_pos``; frames without detections vanish.

    A NULL array counts as empty, and shorter arrays give NULLs: no other array costs a frame its rows.

    ``detection_boxes`` becomes the struct ``box``, ``detection_classes`` ``class_id``,
    ``detection_scores`` ``score``; any other array keeps its name.
    """
    arrays = _array_fields(trimmed)
    keep = [c for c in trimmed.columns if c not in arrays and c != "num_detections"]
    filled = [F.coalesce(F.col(a), F.array().cast(trimmed.schema[a].dataType)).alias(a) for a in arrays]
    rows = trimmed.select(
        *keep, F.posexplode(F.arrays_zip(*filled)).alias("det_pos", "d")
    )
    out = [F.col(c) for c in keep] + [F.col("det_pos").cast("bigint").alias("det_pos")]
    for a in arrays:
        item = F.col("d").getField(a)
        if a == "detection_boxes":
            out.append(
                F.struct(*[item.getItem(i).cast("double").alias(c) for i, c in enumerate(("ymin", "xmin", "ymax", "xmax"))]).alias("box")
            )
        elif a == "detection_classes":
            out.append(item.alias("class_id"))
        elif a == "detection_scores":
            out.append(item.cast("double").alias("score"))
        else:
            out.append(item.alias(a))
    return rows.select(*out)


#: Shares of a class in the join with the label map.
SHARES = 1024


def above_score(det: DataFrame, threshold: float = DRAW_SCORE, strict: bool = True) -> DataFrame:
    """Strict for drawing, inclusive for evaluation and goals."""
    score = F.col("score")
    return det.filter(score > threshold if strict else score >= threshold)


def to_pixels(det: DataFrame, width: int | Column, height: int | Column) -> DataFrame:
    """Replace the normalised ``box`` by pixel columns ``x, y, w, h``; frames of several sizes bring theirs as columns."""
    b = F.col("box")
    return det.withColumns(
        {
            "x": b["xmin"] * width,
            "y": b["ymin"] * height,
            "w": (b["xmax"] - b["xmin"]) * width,
            "h": (b["ymax"] - b["ymin"]) * height,
        }
    ).drop("box")


def one_name_per_id(label_map: DataFrame) -> DataFrame:
    """``id, name``; of a repeated id the row with the lowest ``pos`` if there is one, else the lowest name."""
    order = F.struct("pos", "name") if "pos" in label_map.columns else F.struct("name")
    return label_map.groupBy("id").agg(F.min(order).alias("first")).select("id", F.col("first.name").alias("name"))


def with_labels(det: DataFrame, label_map: DataFrame) -> DataFrame:
    """Add ``name`` by class id; ids without a label become ``N/A``. Which ids count is the map's affair."""
    # Detections have few classes: shuffled by class alone, each would be one task. A copy of the map per share spreads them.
    copies = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("_label_share")
    labels = one_name_per_id(label_map).toDF("_label_id", "_label").select("*", copies)
    spread = [c for c in (*FRAME, "det_id", "det_pos", "score") if c in det.columns] or det.columns
    shared = det.withColumn("_share", F.pmod(F.hash(*spread), F.lit(SHARES)))
    joined = shared.join(labels, (F.col("class_id") == F.col("_label_id")) & (F.col("_share") == F.col("_label_share")), "left")
    return joined.withColumn("name", F.coalesce("_label", F.lit("N/A"))).drop("_label_id", "_label", "_share", "_label_share")


def display_text(name: Column, score: Column) -> Column:
    """``goal: 87%``"""
    percent = F.floor(score * 100 + F.lit(0.5)).cast("bigint").cast("string")
    return F.concat(name, F.lit(": "), percent, F.lit("%"))


def top_boxes(det: DataFrame, n: int = MAX_BOXES, tie: str = "det_id") -> DataFrame:
    """The ``n`` best-scored boxes of each frame, ties by the ``tie`` column.

    Spark plans a group limit before the shuffle, so a crowded frame ships at most ``n``
    rows per input partition.
    """
    w = Window.partitionBy(*FRAME).orderBy(F.col("score").desc(), F.col(tie).asc())
    return det.withColumn("box_rank", F.row_number().over(w)).filter(F.col("box_rank") <= n)


def overlay(
    det: DataFrame,
    label_map: DataFrame,
    width: int,
    height: int,
    threshold: float = DRAW_SCORE,
    max_boxes: int = MAX_BOXES,
) -> DataFrame:
    """What to draw on each frame: pixel corners, rank and text of the boxes that pass."""
    kept = top_boxes(above_score(det, threshold, strict=True), max_boxes, tie="det_pos")
    drawn = with_labels(to_pixels(kept, width, height), label_map)
    return drawn.withColumn("text", display_text(F.col("name"), F.col("score")))
