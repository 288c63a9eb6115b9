"""The greedy matching rule on pairs: who rivals whom, and one scan in the order of the rule.

The rule is sequential inside a set of rivals: detections and truth boxes that pairs connect. A frame's
class is such a set, or many; it is one sorted run of pairs. A crowded frame's class is split into its
connected sets first, in rounds that grow with the logarithm of the longest chain. The scan is a stream:
it holds which truth boxes of the current set are taken, nothing else.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinkspark.functions.joins import null_safe_join
from rinkspark.session import ensure_checkpoint_dir

#: A group with more detections than this is split into its connected sets.
CROWD = 10_000


def components(links: DataFrame) -> DataFrame:
    """``node, component``: the least node that links ``a, b`` (longs) lead to, for every node.

    Each round points every node's larger neighbours at its least one, then every node and its smaller
    neighbours at their least: paths halve, and a node with many links is one partial minimum per task.
    """
    ensure_checkpoint_dir(links.sparkSession)
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    seen, rounds = None, 0
    while (now := edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) != seen:
        seen, rounds = now, rounds + 1
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
        outer = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct().checkpoint()
        least = outer.groupBy("a").agg(F.min("b").alias("least"))
        inner = outer.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        edges = inner.unionAll(least.select("a", F.col("least").alias("b"))).distinct().checkpoint()
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = found.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    found.rounds = rounds
    return found


def with_set(pairs: DataFrame, det: DataFrame, group: Sequence[str], crowd: int = CROWD) -> DataFrame:
    """Adds ``rivals``: which connected set of its group a pair belongs to; uncrowded groups are one set."""
    crowded = det.groupBy(*group).agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select(*group)
    one = F.lit(0).cast("long")
    if crowded.isEmpty():
        return pairs.withColumn("rivals", one)
    ensure_checkpoint_dir(pairs.sparkSession)
    pairs = pairs.checkpoint()
    # Sets of equal hash would be scanned as one, with the same result.
    pairs = pairs.withColumns({"_det": F.xxhash64(*group, F.lit("d"), "det_id"), "_gt": F.xxhash64(*group, F.lit("t"), "gt_id")})
    many = null_safe_join(pairs, crowded, group, "left_semi")
    sets = components(many.select(F.col("_det").alias("a"), F.col("_gt").alias("b")))
    labelled = pairs.join(sets, pairs["_det"] == sets["node"], "left")
    return labelled.withColumn("rivals", F.coalesce("component", one)).drop("_det", "_gt", "node", "component")


def _scan(columns: list[str], head: int, ious: list[float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs in order to those that the rule takes, with the threshold at which; the first ``head`` columns name a set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        taken: list[set] = []
        free: list[bool] = []
        for batch in batches:
            picked, at = [], []
            names = zip(*(batch.column(k).to_pylist() for k in range(head)))
            rest = (batch.column(columns.index(c)).to_pylist() for c in ("det_id", "gt_id", "iou"))
            for row, (name, det, gt, iou) in enumerate(zip(names, *rest)):
                if name != now:
                    now, last, taken = name, None, [set() for _ in ious]
                if last is None or det != last:
                    last, free = det, [True] * len(ious)
                for k in range(bisect_right(ious, iou)):
                    if free[k] and gt not in taken[k]:
                        taken[k].add(gt)
                        free[k] = False
                        picked.append(row)
                        at.append(ious[k])
            kept = pa.Table.from_batches([batch]).take(pa.array(picked, pa.int64()))
            kept = kept.append_column("min_iou", pa.array(at, pa.float64()))
            yield from kept.to_batches()

    return scan


def greedy(
    pairs: DataFrame, det: DataFrame, order: Column, group: Sequence[str], ious: Sequence[float], crowd: int = CROWD
) -> DataFrame:
    """The pairs that the greedy rule takes at each threshold, with the threshold in ``min_iou``.

    In ``order``, then by ``det_id``, each detection takes the free truth of highest IoU, then lowest ``gt_id``.
    ``pairs`` hold ``det_id, gt_id, iou`` and the columns of ``group``; ``det`` tells which groups are crowded.
    All thresholds are served by one scan.
    """
    levels = sorted(float(t) for t in ious)
    sets = with_set(pairs, det, group, crowd)
    columns = [*group, "rivals", *[c for c in pairs.columns if c not in group]]
    head = [*group, "rivals"]
    dealt = sets.select(*columns).repartition(*head)
    ordered = dealt.sortWithinPartitions(*head, order, "det_id", F.col("iou").desc(), "gt_id")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields) + ", min_iou double"
    return ordered.mapInArrow(_scan(columns, len(head), levels), schema).drop("rivals")
