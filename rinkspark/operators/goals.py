"""Goal recognition: frames that hold a goal, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinkspark.functions.boxes import box_of, contains_centre, in_covered_cells, in_level_cell, same_cell, with_level
from rinkspark.operators.detections import EVAL_SCORE, FRAME, above_score


def _inner_outer(det: DataFrame, inner: str, outer: str, cell_scale: float) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides of the containment join and its condition; the keys of the outer side are renamed.

    Outer boxes are copied to the cells of their level that they touch; a centre is looked up once for
    each level at which its frame has outer boxes at all.
    """
    goals = det.filter(F.col("name") == outer).select(
        *[F.col(k).alias(f"o_{k}") for k in FRAME], F.col("det_id").alias("outer_id"), *[F.col(n).alias(f"o_{n}") for n in "xywh"]
    )
    big = in_covered_cells(goals, "o_", cell_scale)
    levels = with_level(goals, "o_").select(*[F.col(f"o_{k}").alias(k) for k in FRAME], F.col("o_level").alias("i_level")).distinct()
    small = det.filter(F.col("name") == inner).select(
        *FRAME,
        F.col("det_id").alias("inner_id"),
        F.col("score").alias("inner_score"),
        *[F.col(n).alias(f"i_{n}") for n in "xywh"],
        F.monotonically_increasing_id().alias("inner_row"),
    )
    small = in_level_cell(small.join(levels, [*FRAME]), "i_", cell_scale)
    inside = contains_centre(box_of("o_"), box_of("i_")) & same_cell("i_", "o_")
    for k in FRAME:
        inside = inside & (F.col(k) == F.col(f"o_{k}"))
    return small, big, inside


def contained_pairs(
    det: DataFrame, inner: str = "puck", outer: str = "goal", cell_scale: float = 1.0
) -> DataFrame:
    """Pairs of one frame where the centre of an ``inner`` box lies in an ``outer`` box."""
    small, big, inside = _inner_outer(det, inner, outer, cell_scale)
    return small.join(big, inside).select(*FRAME, "inner_id", "outer_id", "inner_score")


def goal_frames(
    det: DataFrame,
    rule: str | Column = "presence",
    min_score: float = EVAL_SCORE,
    goal: str = "goal",
    inner: str = "puck",
    cell_scale: float = 1.0,
) -> DataFrame:
    """One row per goal frame: number of detections that say so and their best score.

    ``presence``: a detection named ``goal`` with score >= ``min_score``.
    ``containment``: an ``inner`` detection centred in a ``goal`` box, both >= ``min_score``.
    A Column is the caller's own test on labelled detections.
    """
    sure = above_score(det, min_score, strict=False)
    if isinstance(rule, Column):
        evidence = det.filter(rule).select(*FRAME, "score")
    elif rule == "presence":
        evidence = sure.filter(F.col("name") == goal).select(*FRAME, "score")
    elif rule == "containment":
        # A semi join: each inner box counts once, however many goal boxes lie over it.
        small, big, inside = _inner_outer(sure, inner, goal, cell_scale)
        seen = small.join(big, inside, "left_semi").dropDuplicates([*FRAME, "inner_row"])
        evidence = seen.select(*FRAME, F.col("inner_score").alias("score"))
    else:
        raise ValueError("rule must be 'presence', 'containment' or a boolean Column")
    return evidence.groupBy(*FRAME).agg(F.count("*").alias("n_evidence"), F.max("score").alias("best_score"))


def goal_messages(goals: DataFrame) -> DataFrame:
    return goals.select(
        *FRAME, F.concat(F.lit("Goal detected at frame "), F.col("frame_idx").cast("string")).alias("message")
    )
