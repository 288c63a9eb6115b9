"""Properties of the physical plans, on the registered queries."""

import re

import pytest

from __spark_entry__ import SMOKE_DIR
from rinkspark.operators import detections, matching
from rinkspark.plans import fixtures as fx
from rinkspark.plans.queries import QUERIES


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_pairing_without_keys_and_no_row_udfs(spark, name):
    plan = plan_of(QUERIES[name](spark, SMOKE_DIR))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan
    # One task may add up what partial aggregates have left, one row each, and nothing else.
    lines = plan.splitlines()
    for above, below in zip(lines, lines[1:]):
        assert "SinglePartition" not in above or "functions=[partial_" in below, above


def test_scan_reads_only_what_it_needs(spark):
    plan = plan_of(QUERIES["latest_checkpoint"](spark, SMOKE_DIR))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan
    plan = plan_of(QUERIES["top_boxes"](spark, SMOKE_DIR))
    assert "l_shipdate" not in plan and "l_tax" not in plan
    plan = plan_of(fx.motion(spark, SMOKE_DIR))
    assert "PushedFilters: [IsNotNull(event_type), Not(EqualTo(event_type,error))]" in plan


def test_nothing_is_broadcast_by_hint(spark):
    label_map = fx.label_map(spark)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        hinted = {n for n, q in QUERIES.items() if "BroadcastHashJoin" in plan_of(q(spark, SMOKE_DIR))}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert hinted == set()
    assert detections.with_labels(fx.scene(spark, SMOKE_DIR), label_map).count() == fx.scene(spark, SMOKE_DIR).count()


def test_matching_shuffles_the_hits_once(spark):
    """Claims and result share the shuffle of the hits; a reader of ``tp`` alone needs no second join."""
    det, truth = fx.detections(spark, SMOKE_DIR), fx.truth(spark, SMOKE_DIR)
    matches = matching.match_voc(det, truth)
    matches.collect()
    final = plan_of(matches).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final
    flags = plan_of(matching.detection_prf(matches, truth))
    assert len(re.findall(r"SortMergeJoin.*LeftOuter", flags)) == 1
