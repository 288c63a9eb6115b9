import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rinkspark.functions.boxes import in_own_cell, iou_reach
from rinkspark.operators import curves, matching, rivals

from helpers import DET, TRUTH, coco_rule, iou, random_scene, rows, voc_rule

OUT = ("video_id", "frame_idx", "class_id", "det_id", "score", "gt_id", "iou", "tp")


@pytest.mark.parametrize("seed,t,cell", [(1, 0.5, 1.0), (2, 0.3, 0.25), (3, 0.75, 0.05), (4, 0.1, 8.0)])
def test_voc_and_coco_equal_the_sequential_rules(spark, seed, t, cell):
    det, truth = random_scene(seed, frames=20, most=8)
    d, g = spark.createDataFrame(det, DET), spark.createDataFrame(truth, TRUTH)
    assert rows(matching.match_voc(d, g, t, cell), *OUT) == voc_rule(det, truth, t)
    assert rows(matching.match_coco(d, g, t, cell), *OUT) == coco_rule(det, truth, t)


def test_pairs_equal_brute_force_for_any_cell_size(spark):
    det, truth = random_scene(9, frames=12, most=8)
    d, g = spark.createDataFrame(det, DET), spark.createDataFrame(truth, TRUTH)
    want = sorted(
        (a[3], b[3], iou(a[4:8], b[4:8])) + a[:3] for a in det for b in truth if a[:3] == b[:3] and iou(a[4:8], b[4:8]) >= 0.05
    )
    for cell in (0.05, 1.0, 30.0):
        got = rows(matching.iou_pairs(d, g, 0.05, cell), "det_id", "gt_id", "iou", "video_id", "frame_idx", "class_id")
        assert sorted(got) == want


def test_boxes_of_any_unit_and_size_share_a_table(spark):
    """Normalised boxes, a stitched panorama of 100,000 pixels, points, and boxes from 0.01 to 3,000 pixels."""
    rng = random.Random(4)
    det, truth, n = [], [], 0
    for frame, (extent, low, high) in enumerate([(1.0, 0.02, 0.3), (100_000.0, 20, 400), (3000.0, 0.01, 3000), (1e-4, 1e-6, 1e-5), (1e12, 1e6, 1e9)]):
        for _ in range(150):
            n += 1
            side = low * (high / low) ** rng.random()
            b = (rng.uniform(-extent, extent), rng.uniform(0, extent), side, side * rng.uniform(0.3, 3))
            truth.append((0, frame, 1, n, *b))
            for _ in range(2):
                shift = [rng.gauss(0, 0.2) * b[2] for _ in range(2)]
                det.append((0, frame, 1, len(det), b[0] + shift[0], b[1] + shift[1], b[2] * rng.uniform(0.5, 2), b[3] * rng.uniform(0.5, 2), 0.5))
        truth.append((0, frame, 1, -n, 0.5, 0.5, 0.0, 0.0))
        det.append((0, frame, 1, -n, 0.5, 0.5, 0.0, 0.0, 0.1))
    d, g = spark.createDataFrame(det, DET), spark.createDataFrame(truth, TRUTH)
    for t in (0.6, 0.3, 0.05):
        want = sorted((a[3], b[3]) for a in det for b in truth if a[1] == b[1] and iou(a[4:8], b[4:8]) >= t)
        assert sorted(rows(matching.iou_pairs(d, g, t), "det_id", "gt_id")) == want and len(want) > 20
    # no cell is hot: a frame of small boxes far apart spreads over as many cells as it has boxes, nearly
    far = spark.createDataFrame([(0, 0, 1, k, 50.0 * k, 0.0, 10.0, 10.0, 0.5) for k in range(5000)], DET)
    assert in_own_cell(far).groupBy("level", "across", "down").count().agg({"count": "max"}).first()[0] <= 1


def test_one_crowded_frame_of_copies(spark):
    """A third of all detections are one box in one frame; so are many truth boxes."""
    det, truth = random_scene(5, frames=30, most=5)
    det += [(0, 0, 1, 10000 + i, 700.0, 100.0, 50.0, 50.0, 0.5) for i in range(3000)]
    truth += [(0, 0, 1, 5000 + i, 702.0, 100.0, 50.0, 50.0) for i in range(300)]
    d, g = spark.createDataFrame(det, DET), spark.createDataFrame(truth, TRUTH)
    got = rows(matching.match_voc(d, g), *OUT)
    assert got == voc_rule(det, truth, 0.5)
    hot = [r for r in got if r[3] >= 10000]
    assert sum(r[7] for r in hot) == 1 and {r[5] for r in hot} == {5000}


def test_results_do_not_depend_on_partitions(spark):
    det, truth = random_scene(6, frames=15, most=6)
    d, g = spark.createDataFrame(det, DET), spark.createDataFrame(truth, TRUTH)
    once = rows(matching.match_voc(d.repartition(1), g.repartition(1)))
    assert rows(matching.match_voc(d.repartition(13), g.repartition(7))) == once


def test_rows_without_class_stay_as_misses(spark):
    det = [(0, 0, None, 1, 0.0, 0.0, 10.0, 10.0, 0.5), (0, 0, 1, None, 0.0, 0.0, 10.0, 10.0, 0.5)]
    truth = [(0, 0, None, 1, 0.0, 0.0, 10.0, 10.0), (0, 0, 1, 2, 0.0, 0.0, 10.0, 10.0)]
    d, g = spark.createDataFrame(det, DET), spark.createDataFrame(truth, TRUTH)
    assert [r.tp for r in matching.match_voc(d, g).collect()] == [False, False]


def test_empty_truth(spark):
    det, _ = random_scene(7, frames=3, most=3)
    d, none = spark.createDataFrame(det, DET), spark.createDataFrame([], TRUTH)
    for rule in (matching.match_voc, matching.match_coco):
        out = rule(d, none)
        assert out.count() == len(det) and out.filter("tp OR gt_id IS NOT NULL").count() == 0
    prf = matching.detection_prf(matching.match_voc(d, none), none).collect()
    assert all(r.recall is None and r.precision == 0 and r.f1 == 0 for r in prf)
    ap = curves.average_precision(matching.match_voc(d, none), none).collect()
    assert all(r.ap is None for r in ap)


def test_class_with_truth_only(spark):
    d = spark.createDataFrame([], DET)
    g = spark.createDataFrame([(0, 0, 4, 1, 0.0, 0.0, 10.0, 10.0)], TRUTH)
    matches = matching.match_voc(d, g)
    assert rows(matching.detection_prf(matches, g)) == [(4, 0, 1, 0, 0, 1, None, 0.0, 0.0)]
    assert rows(curves.average_precision(matches, g, "coco101")) == [(4, 0.0, 1)]


def test_coco_equals_voc_without_competition(spark):
    det = [(0, f, 1, 1, 10.0 * f, 0.0, 40.0, 40.0, 0.1 + f / 50) for f in range(30)]
    truth = [(0, f, 1, 7, 10.0 * f + f, 0.0, 40.0, 40.0) for f in range(30)]
    d, g = spark.createDataFrame(det, DET), spark.createDataFrame(truth, TRUTH)
    assert rows(matching.match_coco(d, g), *OUT) == rows(matching.match_voc(d, g), *OUT)


def curve_rule(points, n_truth):
    """(score, tp) points of one class, sequentially."""
    merged = {}
    for s, tp in points:
        n, k = merged.get(s, (0, 0))
        merged[s] = (n + 1, k + tp)
    out, cum_n, cum_tp = [], 0, 0
    for s in sorted(merged, reverse=True):
        cum_n, cum_tp = cum_n + merged[s][0], cum_tp + merged[s][1]
        out.append([s, merged[s][1], cum_n, cum_tp, cum_tp / cum_n])
    best = 0.0
    for p in reversed(out):
        best = max(best, p[4])
        p.append(best)
    ap = sum(p[1] / n_truth * p[5] for p in out)
    ap101 = sum(max([p[4] for p in out if 100 * p[3] >= k * n_truth], default=0.0) for k in range(101)) / 101
    return out, ap, ap101


@pytest.mark.parametrize("buckets", [2, 7, 500])
def test_curve_equals_the_sequential_rule(spark, monkeypatch, buckets):
    import random

    monkeypatch.setattr(curves, "SCORE_BUCKETS", buckets)
    rng = random.Random(buckets)
    data = [(c, rng.choice([rng.random(), 0.5, 1.0, 0.0]), rng.random() < 0.4) for c in (1, 2) for _ in range(400)]
    matches = spark.createDataFrame(data, "class_id int, score double, tp boolean")
    truth = spark.createDataFrame([(c,) for c in (1, 2) for _ in range(300)], "class_id int")
    got = curves.pr_curve(matches, truth)
    for c in (1, 2):
        want, ap, ap101 = curve_rule([(s, tp) for k, s, tp in data if k == c], 300)
        mine = got.filter(f"class_id = {c}").orderBy("score", ascending=False)
        mine = [list(r) for r in mine.select("score", "tp", "cum_n", "cum_tp", "precision", "envelope").collect()]
        assert mine == want
        for method, value in (("all_point", ap), ("coco101", ap101)):
            row = curves.average_precision(matches, truth, method).filter(f"class_id = {c}").first()
            assert row.ap == pytest.approx(value, abs=1e-12) and 0 <= row.ap <= 1


def test_coco_ap_equals_matching_at_each_threshold(spark):
    det, truth = random_scene(8, frames=40, most=6)
    d, g = spark.createDataFrame(det, DET), spark.createDataFrame(truth, TRUTH)
    got = {(r.class_id, r.min_iou): r.ap for r in curves.coco_ap(d, g).collect()}
    assert len(got) == 20
    for t in (0.5, 0.7, 0.95):
        for r in curves.average_precision(matching.match_coco(d, g, t), g, "coco101").collect():
            assert got[(r.class_id, t)] == pytest.approx(r.ap, abs=1e-12)


def test_metric_rows(spark):
    wide = spark.createDataFrame([(1, 2.0, None)], "class_id int, recall double, f1 double")
    assert rows(curves.metric_rows(wide, ["class_id"])) == [
        (1, "f1", None, "f1: None"),
        (1, "recall", 2.0, "recall: 2.0"),
    ]


box = st.tuples(st.floats(-500, 500), st.floats(-500, 500), st.floats(1, 400), st.floats(1, 400))


@settings(max_examples=300, suppress_health_check=[HealthCheck.too_slow])
@given(box, st.floats(0.05, 1), st.floats(-1, 1), st.floats(-1, 1), st.floats(0.2, 4), st.floats(0.2, 4))
def test_reach_covers_every_partner(b, t, sx, sy, rw, rh):
    w, h = b[2] * rw, b[3] * rh
    a = (b[0] + sx * b[2], b[1] + sy * b[3], w, h)
    assert iou(a, b) == pytest.approx(iou(b, a)) and 0 <= iou(a, b) <= 1 + 1e-12
    if iou(a, b) >= t:
        reach = iou_reach(t) * (1 + 1e-9)
        assert abs(a[0] + w / 2 - b[0] - b[2] / 2) <= reach * b[2] + 1e-6
        assert abs(a[1] + h / 2 - b[1] - b[3] / 2) <= reach * b[3] + 1e-6


def test_bad_threshold():
    with pytest.raises(ValueError):
        iou_reach(0)


def test_null_ids_and_scores_come_last(spark):
    det = [(0, 0, 1, 1, 10.0, 10.0, 20.0, 20.0, None), (0, 0, 1, 2, 10.0, 10.0, 20.0, 20.0, 0.1), (0, 0, 1, None, 10.0, 10.0, 20.0, 20.0, 0.9)]
    d = spark.createDataFrame(det, "video_id long, frame_idx long, class_id long, det_id long, x double, y double, w double, h double, score double")
    truth = [(0, 0, 1, 5, 10.0, 10.0, 20.0, 20.0), (0, 0, 1, None, 10.0, 10.0, 20.0, 20.0)]
    t = spark.createDataFrame(truth, TRUTH)
    for match in (matching.match_voc, matching.match_coco):
        got = {r.det_id: r.tp for r in match(d, t).collect()}
        assert got == {1: False, 2: True, None: False}, match


def test_a_chain_of_rivals(spark):
    """A thousand boxes in a row, each detection between two truths: one dispute from end to end."""
    n = 1000
    truth = [(0, 0, 1, k, 10.0 * k, 0.0, 30.0, 30.0) for k in range(n)] + [(0, 1, 1, 5, 0.0, 0.0, 10.0, 10.0)]
    det = [(0, 0, 1, k, 10.0 * k + 4, 0.0, 30.0, 30.0, (k * 7 % n) / n) for k in range(n)] + [(0, 1, 1, 7, 0.0, 0.0, 10.0, 10.0, 0.5)]
    d, g = spark.createDataFrame(det, DET), spark.createDataFrame(truth, TRUTH)
    pairs = matching.iou_pairs(d, g, 0.5)
    taken = rivals.greedy(pairs, d, matching.last_score(), matching.GROUP, [0.5], crowd=100)
    got = {(r.frame_idx, r.det_id): r.gt_id for r in taken.collect()}
    assert got == {(r[1], r[3]): r[5] for r in coco_rule(det, truth, 0.5) if r[7]}
    links = pairs.select((F.col("det_id") * 2).alias("a"), (F.col("gt_id") * 2 + 1).alias("b")).filter("frame_idx = 0")
    found = rivals.components(links)
    assert found.select("component").distinct().count() == 1 and found.count() == 2 * n
    assert found.rounds <= 14


def test_crowded_groups_split_into_their_sets(spark):
    det, truth = random_scene(12, frames=6, most=40)
    d, g = spark.createDataFrame(det, DET), spark.createDataFrame(truth, TRUTH)
    pairs = matching.iou_pairs(d, g, 0.1)
    for crowd in (0, 20):
        sets = rivals.with_set(pairs, d, matching.GROUP, crowd)
        assert sets.select("rivals").distinct().count() > 10
        taken = rivals.greedy(pairs, d, matching.last_score(), matching.GROUP, [0.7, 0.1], crowd)
        for t in (0.1, 0.7):
            own = sorted((r[0], r[1], r[2], r[3], r[5]) for r in coco_rule(det, truth, t) if r[7])
            assert sorted(rows(taken.filter(f"min_iou = {t}"), *matching.GROUP, "det_id", "gt_id")) == own


def test_greedy_ap_of_two_overlapping_truths(spark):
    truth = spark.createDataFrame([(0, 0, 1, k, 10.0 + 4 * k, 10.0, 20.0, 20.0) for k in (0, 1)], TRUTH)
    det = spark.createDataFrame(
        [(0, 0, 1, 1, 10.0, 10.0, 20.0, 20.0, 0.9), (0, 0, 1, 2, 11.0, 10.0, 20.0, 20.0, 0.8)],
        "video_id long, frame_idx long, class_id long, det_id long, x double, y double, w double, h double, score double",
    )
    assert curves.coco_ap(det, truth, ious=(0.5,)).first().ap == 1.0


def test_unscored_and_unclassed_detections_stay_in_the_curve(spark):
    data = [(1, 3.5, True), (1, -2.0, False), (1, None, True), (None, 1200.0, True), (None, None, False)]
    matches = spark.createDataFrame(data, "class_id int, score double, tp boolean")
    truth = spark.createDataFrame([(1,), (1,), (None,)], "class_id int")
    got = {(r.class_id, r.score): (r.cum_n, r.cum_tp, r.n_truth) for r in curves.pr_curve(matches, truth).collect()}
    assert got == {(1, 3.5): (1, 1, 2), (1, -2.0): (2, 1, 2), (1, None): (3, 2, 2), (None, 1200.0): (1, 1, 1), (None, None): (2, 1, 1)}
    prf = {r.class_id: (r.n_det, r.n_truth) for r in matching.detection_prf(matches, truth).collect()}
    assert prf == {1: (3, 2), None: (2, 1)}
