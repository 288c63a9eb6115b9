"""Detections against truth: candidate pairs, the two matching rules, precision and recall.

All matching happens inside one ``(video_id, frame_idx, class_id)``. Detections keep one
copy each, in the grid cell of their centre; truth boxes are copied to the cells where a
partner of sufficient IoU can be centred. A crowded frame thereby spreads over its cells,
and the per-detection and per-truth choices are partial aggregations, never windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinkspark.functions.boxes import box_of, in_own_cell, in_partner_cells, iou, same_cell
from rinkspark.functions.joins import null_safe_join
from rinkspark.operators.detections import FRAME
from rinkspark.operators.rivals import greedy

GROUP = (*FRAME, "class_id")
IOU_THRESHOLD = 0.5


def _truth_in_cells(truth: DataFrame, min_iou: float, cell_scale: float) -> DataFrame:
    renamed = truth.select(*[F.col(k).alias(f"t_{k}") for k in GROUP], "gt_id", *[F.col(c).alias(f"t_{c}") for c in "xywh"])
    return in_partner_cells(renamed, min_iou, "t_", cell_scale)


def _same_group() -> Column:
    cond = same_cell("", "t_")
    for k in GROUP:
        cond = cond & (F.col(k) == F.col(f"t_{k}"))
    return cond


def _overlap() -> Column:
    return iou(box_of(), box_of("t_"))


def iou_pairs(
    det: DataFrame, truth: DataFrame, min_iou: float = IOU_THRESHOLD, cell_scale: float = 1.0
) -> DataFrame:
    """Every (detection, truth) pair of equal frame and class with IoU >= ``min_iou`` > 0, boxes of any size and unit."""
    own = in_own_cell(det.select(*GROUP, "det_id", "score", *"xywh"), scale=cell_scale)
    pairs = own.join(
        # Two fact tables: merge-joined whatever their compressed size promises, so that a hot
        # cell is split by the adaptive skew join and nothing must fit in memory.
        _truth_in_cells(truth, min_iou, cell_scale).hint("merge"),
        _same_group() & (_overlap() >= min_iou),
    )
    return pairs.select(*GROUP, "det_id", "gt_id", "score", _overlap().alias("iou"))


def best_hits(
    det: DataFrame, truth: DataFrame, min_iou: float = IOU_THRESHOLD, cell_scale: float = 1.0
) -> DataFrame:
    """The best truth (highest IoU, then lowest ``gt_id``) of every detection that has one at ``min_iou``."""
    # Copies of a truth box can never win against the lowest id, so they go first.
    distinct_truth = truth.groupBy(*GROUP, *"xywh").agg(F.min("gt_id").alias("gt_id"))
    pairs = iou_pairs(det.filter(F.col("det_id").isNotNull()), distinct_truth, min_iou, cell_scale)
    # the score rides along instead of being a key, so that later joins by detection find the rows in place
    choice = F.min(F.struct((-F.col("iou")).alias("neg_iou"), F.col("gt_id").alias("gt_id"), F.col("score").alias("score")))
    best = pairs.groupBy(*GROUP, "det_id").agg(choice.alias("best"))
    return best.select(
        *GROUP,
        "det_id",
        F.col("best.score").alias("score"),
        F.col("best.gt_id").alias("gt_id"),
        (-F.col("best.neg_iou")).alias("iou"),
    )


def last_score() -> Column:
    """Falling score as a rising key; a NULL score comes last, with NaN."""
    return F.coalesce(-F.col("score"), F.lit(float("nan")))


def _first_claims(hits: DataFrame, group: tuple[str, ...] = GROUP) -> DataFrame:
    """For each truth the claimant with the highest score, NULL last, then the lowest ``det_id``."""
    claim = F.min(F.struct(last_score().alias("neg_score"), F.col("det_id").alias("det_id")))
    return (
        hits.groupBy(*group, "gt_id")
        .agg(claim.alias("claim"))
        .select(*group, "gt_id", F.col("claim.det_id").alias("det_id"))
    )


def match_voc(
    det: DataFrame, truth: DataFrame, min_iou: float = IOU_THRESHOLD, cell_scale: float = 1.0
) -> DataFrame:
    """PASCAL VOC rule: each detection claims its best truth, the best-scored claimant is the true positive.

    Returns one row per detection with ``gt_id`` and ``iou`` of its best truth (NULL when no
    truth reaches ``min_iou``) and ``tp``. ``det_id`` must be unique within frame and class.
    """
    # The hits feed the claims and the result: their shuffle by detection is planned once and
    # reused. A caller who reads only ``tp`` drops the last join, its keys being distinct.
    hits = best_hits(det, truth, min_iou, cell_scale)
    winners = _first_claims(hits).select(*GROUP, "det_id", F.lit(True).alias("tp"))
    key = [*GROUP, "det_id"]
    flagged = det.select(*GROUP, "det_id", "score").join(winners.hint("merge"), key, "left")
    found = hits.select(*key, "gt_id", "iou")
    return flagged.join(found.hint("merge"), key, "left").select(
        *key, "score", "gt_id", "iou", F.coalesce("tp", F.lit(False)).alias("tp")
    )


def match_coco(
    det: DataFrame, truth: DataFrame, min_iou: float = IOU_THRESHOLD, cell_scale: float = 1.0
) -> DataFrame:
    """COCO rule: by falling score, NULL last, each detection takes the best truth that is still free.

    Sequential inside a set of rivals only (:mod:`rinkspark.operators.rivals`). Rows with a NULL id cannot be
    told apart: such detections are misses, such truth boxes stay unfound.
    """
    pairs = iou_pairs(named(det, "det_id"), named(truth, "gt_id"), min_iou, cell_scale)
    settled = greedy(pairs, det, last_score(), GROUP, [min_iou]).select(*GROUP, "det_id", "gt_id", "iou")
    return det.select(*GROUP, "det_id", "score").join(settled, [*GROUP, "det_id"], "left").withColumn("tp", F.col("gt_id").isNotNull())


def named(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.filter(F.col(id_col).isNotNull())


def detection_prf(matches: DataFrame, truth: DataFrame, by: tuple[str, ...] = ("class_id",)) -> DataFrame:
    """True positives, precision, recall and F1 per group; a zero denominator gives NULL."""
    found = matches.groupBy(*by).agg(F.count("*").alias("n_det"), F.count_if("tp").alias("tp"))
    wanted = truth.groupBy(*by).agg(F.count("*").alias("n_truth"))
    both = null_safe_join(found, wanted, by, "full").na.fill(0, ["n_det", "tp", "n_truth"])
    tp = F.col("tp")
    return both.select(
        *by,
        "n_det",
        "n_truth",
        "tp",
        (F.col("n_det") - tp).alias("fp"),
        (F.col("n_truth") - tp).alias("fn"),
        F.try_divide(tp, F.col("n_det")).alias("precision"),
        F.try_divide(tp, F.col("n_truth")).alias("recall"),
        F.try_divide(2 * tp, F.col("n_det") + F.col("n_truth")).alias("f1"),
    )
