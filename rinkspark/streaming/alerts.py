"""Live goal alerts: stateless, one output row per goal frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkspark.operators.detections import EVAL_SCORE, FRAME, one_name_per_id, trim_detections
from rinkspark.operators.goals import goal_messages


def class_ids(label_map: DataFrame, name: str = "goal") -> list[int]:
    """Ids of one label, read at plan time; a label map has no more ids than its text lists."""
    labels = one_name_per_id(label_map).filter(F.col("name") == name)
    return sorted(row["id"] for row in labels.select("id").collect())


def goal_alerts(raw: DataFrame, goal_ids: list[int], min_score: float = EVAL_SCORE) -> DataFrame:
    """Frames of a raw detection stream (or table) with a goal detection >= ``min_score``.

    Each frame decides on its own arrays: no state, no watermark, no shuffle.
    """
    trimmed = trim_detections(raw)
    both = F.arrays_zip("detection_classes", "detection_scores")
    wanted = [F.lit(i).cast("bigint") for i in goal_ids] or [F.lit(None).cast("bigint")]
    is_goal = F.exists(
        both,
        lambda d: d["detection_classes"].isin(*wanted) & (d["detection_scores"].cast("double") >= min_score),
    )
    return goal_messages(trimmed.filter(is_goal).select(*FRAME))
