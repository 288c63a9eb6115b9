"""Precision-recall curves and average precision.

There are few classes, so a window over a class would be one huge task. Scores are merged
first (equal scores are one point of the curve), then cut into SCORE_BUCKETS ranges of about
equally many points; only the per-bucket totals, at most SCORE_BUCKETS + 1 rows per class, are
scanned class-wide. Detections without a score or a class count: they come last, or are a class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rinkspark.functions.chunks import with_earlier_chunks
from rinkspark.functions.joins import null_safe_join
from rinkspark.operators.matching import GROUP, iou_pairs, last_score, named
from rinkspark.operators.rivals import greedy
from rinkspark.session import ensure_checkpoint_dir

SCORE_BUCKETS = 128
COCO_IOUS = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95)
RECALL_STEPS = 100


def _bucketed(points: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``bucket``: score ranges of about equally many points, whatever the scores are; a NULL score has none."""
    share = [k / SCORE_BUCKETS for k in range(1, SCORE_BUCKETS)]
    cuts = points.groupBy(*by).agg(F.percentile_approx("score", share, 10 * SCORE_BUCKETS).alias("cuts"))
    joined = null_safe_join(points, cuts, by)
    below = F.size(F.filter("cuts", lambda c: c <= F.col("score"))).cast("bigint")
    return joined.withColumn("bucket", F.when(F.col("score").isNotNull(), below)).drop("cuts")


def _curve(points: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """``points``: (by, score, n, tp) with distinct scores; ``wanted``: (by, n_truth).

    The points are read four times below and come out of the whole matching: they are few,
    and are written once.
    """
    ensure_checkpoint_dir(points.sparkSession)
    points = points.checkpoint()
    bucketed = _bucketed(points, by)
    totals = {"n_above": (F.sum("n"), F.sum), "tp_above": (F.sum("tp"), F.sum)}
    run = with_earlier_chunks(bucketed, by, "bucket", totals, descending=True)
    inside = Window.partitionBy(*by, "bucket").orderBy(F.col("score").desc())
    down = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = F.lit(0).cast("bigint")
    run = run.withColumns(
        {
            "cum_n": F.coalesce("n_above", zero) + F.sum("n").over(down),
            "cum_tp": F.coalesce("tp_above", zero) + F.sum("tp").over(down),
        }
    ).withColumn("precision", F.col("cum_tp") / F.col("cum_n"))
    # envelope: the best precision at this score or any lower one
    run = with_earlier_chunks(run, by, "bucket", {"best_below": (F.max("precision"), F.max)}, nulls_first=True)
    onward = inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    run = run.withColumn("envelope", F.greatest(F.max("precision").over(onward), F.col("best_below")))
    # at most one row per group; Spark broadcasts it only if its measured size allows
    run = null_safe_join(run, wanted, by, "left")
    return run.select(
        *by,
        "score",
        "tp",
        "cum_n",
        "cum_tp",
        "n_truth",
        "precision",
        F.try_divide(F.col("cum_tp"), F.col("n_truth")).alias("recall"),
        "envelope",
    )


def _truth_counts(truth: DataFrame, by: list[str]) -> DataFrame:
    return truth.groupBy(*by).agg(F.count("*").alias("n_truth"))


def pr_curve(matches: DataFrame, truth: DataFrame, by: tuple[str, ...] = ("class_id",)) -> DataFrame:
    """One point per group and distinct score, with running precision, recall and envelope."""
    keys = list(by)
    points = matches.groupBy(*keys, "score").agg(F.count("*").alias("n"), F.count_if("tp").alias("tp"))
    return _curve(points, _truth_counts(truth, keys), keys)


def _area(curve: DataFrame, by: list[str], method: str) -> DataFrame:
    tp, cum, n = F.col("tp"), F.col("cum_tp"), F.col("n_truth")
    if method == "all_point":
        share = F.try_divide(tp, n)
    elif method == "coco101":
        # recall levels k/100 first reached at this point: those in (previous recall, recall],
        # counted in whole numbers; level 0 belongs to the first point that finds anything
        def level(c: Column) -> Column:
            return F.floor(F.try_divide(c * RECALL_STEPS, n))

        first = F.when((cum == tp) & (tp > 0), F.lit(1)).otherwise(F.lit(0))
        share = (level(cum) - level(cum - tp) + first) / F.lit(RECALL_STEPS + 1.0)
    else:
        raise ValueError("method must be 'all_point' or 'coco101'")
    return curve.groupBy(*by).agg(F.sum(share * F.col("envelope")).alias("ap"), F.max("n_truth").alias("n_truth"))


def _with_unseen(area: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """A group with truth and no detection has AP 0; one without truth has none."""
    joined = null_safe_join(area.drop("n_truth"), wanted, by, "full")
    ap = F.when(F.col("n_truth") > 0, F.coalesce("ap", F.lit(0.0)))
    return joined.select(*by, ap.alias("ap"), F.coalesce("n_truth", F.lit(0)).cast("bigint").alias("n_truth"))


def area_under(
    curve: DataFrame, truth: DataFrame, method: str = "all_point", by: tuple[str, ...] = ("class_id",)
) -> DataFrame:
    """Average precision from a :func:`pr_curve`: every recall step (``all_point``) or 101 fixed ones (``coco101``)."""
    keys = list(by)
    return _with_unseen(_area(curve, keys, method), _truth_counts(truth, keys), keys)


def average_precision(
    matches: DataFrame, truth: DataFrame, method: str = "all_point", by: tuple[str, ...] = ("class_id",)
) -> DataFrame:
    return area_under(pr_curve(matches, truth, by), truth, method, by)


def coco_ap(
    det: DataFrame, truth: DataFrame, ious: tuple[float, ...] = COCO_IOUS, cell_scale: float = 1.0
) -> DataFrame:
    """101-point AP per class and IoU threshold, greedy matching at each threshold.

    Pairs are made once, at the lowest threshold, and one scan matches them at all thresholds. All
    detections enter as counts per score; those with a NULL id are misses.
    """
    levels = F.array(*[F.lit(float(t)) for t in ious])
    pairs = iou_pairs(named(det, "det_id"), named(truth, "gt_id"), min(ious), cell_scale)
    by = ["class_id", "min_iou"]
    found = greedy(pairs, det, last_score(), GROUP, ious)
    tps = found.groupBy(*by, "score").agg(F.count("*").alias("tp"))
    counts = (
        det.groupBy("class_id", "score")
        .agg(F.count("*").alias("n"))
        .select("class_id", "score", "n", F.explode(levels).alias("min_iou"))
    )
    points = null_safe_join(counts, tps, [*by, "score"], "left").na.fill(0, ["tp"])
    wanted = _truth_counts(truth, ["class_id"]).select("class_id", "n_truth", F.explode(levels).alias("min_iou"))
    return _with_unseen(_area(_curve(points, wanted, by), by, "coco101"), wanted, by)


def coco_map(per_threshold: DataFrame) -> DataFrame:
    """mAP over all classes and thresholds, and the usual two single thresholds, as one row."""
    return per_threshold.agg(
        F.avg("ap").alias("map"),
        F.avg(F.when(F.col("min_iou") == 0.5, F.col("ap"))).alias("map_50"),
        F.avg(F.when(F.col("min_iou") == 0.75, F.col("ap"))).alias("map_75"),
    )


def metric_rows(metrics: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Wide metrics to (key, value) rows and their printed form ``key: value``."""
    ids = ids or []
    values = [c for c in metrics.columns if c not in ids]
    wide = metrics.select(*ids, *[F.col(c).cast("double").alias(c) for c in values])
    rows = wide.unpivot(ids, values, "key", "value")
    return rows.withColumn("message", F.concat(F.col("key"), F.lit(": "), F.coalesce(F.col("value").cast("string"), F.lit("None"))))
