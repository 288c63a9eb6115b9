"""The same queries in SQL, written for a single-node engine as a check of the Spark results."""

from __future__ import annotations

BOXES = """
boxes AS (
  SELECT l_orderkey % 16 AS video_id, CAST(floor(l_orderkey / 16) AS BIGINT) AS frame_idx,
    (l_partkey * 10 + l_linenumber) * 100000000 + CAST(floor(l_extendedprice * 100 + 0.5e0) AS BIGINT) AS det_id,
    CAST(l_quantity AS INTEGER) AS quantity,
    CAST(l_partkey % 100 * 10 AS DOUBLE) AS x, CAST(l_suppkey % 100 * 5 AS DOUBLE) AS y,
    l_quantity + 40 AS w, l_quantity + 60 AS h,
    CAST(CAST(floor(l_extendedprice * 100 + 0.5e0) AS BIGINT) % 1000 AS DOUBLE) / 1000 AS score,
    CAST(CAST(floor(l_tax * 100 + 0.5e0) AS BIGINT) * 6 AS DOUBLE) AS shift, l_returnflag <> 'R' AS is_real
  FROM lineitem)"""

MATCH_TABLES = (
    BOXES
    + """,
det AS (
  SELECT video_id, frame_idx, det_id * 2 + copy AS det_id, quantity % 2 + 1 AS class_id, x + copy * 6 AS x, y, w, h,
    CASE WHEN copy = 1 THEN score * 0.9e0 ELSE score END AS score
  FROM boxes CROSS JOIN (VALUES (0), (1)) AS c(copy)),
truth AS (
  SELECT video_id, frame_idx, det_id AS gt_id, quantity % 2 + 1 AS class_id, x + shift AS x, y, w, h
  FROM boxes WHERE is_real)"""
)


def _iou(a: str, b: str) -> str:
    iw = f"greatest(least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x), 0e0)"
    ih = f"greatest(least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y), 0e0)"
    return f"({iw} * {ih} / ({a}.w * {a}.h + {b}.w * {b}.h - {iw} * {ih}))"


PAIRS = (
    MATCH_TABLES
    + f""",
pairs AS MATERIALIZED (
  SELECT d.video_id, d.frame_idx, d.class_id, d.det_id, t.gt_id, d.score, {_iou('d', 't')} AS iou
  FROM det d JOIN truth t ON d.video_id = t.video_id AND d.frame_idx = t.frame_idx AND d.class_id = t.class_id
    AND d.x < t.x + t.w AND t.x < d.x + d.w AND d.y < t.y + t.h AND t.y < d.y + d.h)"""
)

VOC = (
    PAIRS
    + """,
best AS MATERIALIZED (
  SELECT * FROM pairs WHERE iou >= 0.5
  QUALIFY row_number() OVER (PARTITION BY video_id, frame_idx, class_id, det_id ORDER BY iou DESC, gt_id) = 1),
claimed AS (
  SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx, class_id, gt_id ORDER BY score DESC, det_id) = 1 AS tp
  FROM best),
matches AS (
  SELECT d.video_id, d.frame_idx, d.class_id, d.det_id, d.score, c.gt_id, c.iou, coalesce(c.tp, false) AS tp
  FROM det d LEFT JOIN claimed c USING (video_id, frame_idx, class_id, det_id))"""
)

PRF = (
    VOC
    + """,
found AS (SELECT class_id, count(*) AS n_det, count(*) FILTER (tp) AS tp FROM matches GROUP BY 1),
wanted AS (SELECT class_id, count(*) AS n_truth FROM truth GROUP BY 1),
prf AS (
  SELECT class_id, coalesce(n_det, 0) AS n_det, coalesce(n_truth, 0) AS n_truth, coalesce(tp, 0) AS tp,
    coalesce(n_det, 0) - coalesce(tp, 0) AS fp, coalesce(n_truth, 0) - coalesce(tp, 0) AS fn,
    tp / nullif(n_det, 0) AS precision, tp / nullif(n_truth, 0) AS recall,
    2 * tp / nullif(coalesce(n_det, 0) + coalesce(n_truth, 0), 0) AS f1
  FROM found FULL JOIN wanted USING (class_id))"""
)

CURVE = (
    VOC
    + """,
points AS (
  SELECT class_id, score, count(*) AS n, count(*) FILTER (tp) AS tp FROM matches GROUP BY 1, 2),
run AS (
  SELECT class_id, score, tp, CAST(sum(n) OVER w AS BIGINT) AS cum_n, CAST(sum(tp) OVER w AS BIGINT) AS cum_tp
  FROM points WINDOW w AS (PARTITION BY class_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
wanted AS (SELECT class_id, count(*) AS n_truth FROM truth GROUP BY 1),
curve AS (
  SELECT class_id, score, tp, cum_n, cum_tp, n_truth, cum_tp / cum_n AS precision, cum_tp / nullif(n_truth, 0) AS recall,
    max(cum_tp / cum_n) OVER (PARTITION BY class_id ORDER BY score DESC
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope
  FROM run LEFT JOIN wanted USING (class_id))"""
)

COCO_AP = (
    PAIRS
    + """,
thresholds AS (SELECT (50 + 5 * i) / 100e0 AS min_iou FROM range(10) AS r(i)),
hits AS (SELECT min_iou, p.* FROM pairs p JOIN thresholds ON iou >= min_iou),
ranked AS (
  SELECT min_iou, video_id, frame_idx, class_id, det_id,
    row_number() OVER (PARTITION BY min_iou, video_id, frame_idx, class_id ORDER BY score DESC, det_id) AS n
  FROM (SELECT DISTINCT min_iou, video_id, frame_idx, class_id, det_id, score FROM hits)),
greedy AS (
  SELECT DISTINCT min_iou, video_id, frame_idx, class_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS taken,
    CAST(NULL AS BIGINT) AS det_id, CAST(NULL AS BIGINT) AS gt_id FROM hits
  UNION ALL
  SELECT g.min_iou, g.video_id, g.frame_idx, g.class_id, r.n,
    CASE WHEN b.gt_id IS NULL THEN g.taken ELSE list_append(g.taken, b.gt_id) END, r.det_id, b.gt_id
  FROM greedy g
  JOIN ranked r ON r.min_iou = g.min_iou AND r.video_id = g.video_id AND r.frame_idx = g.frame_idx
    AND r.class_id = g.class_id AND r.n = g.n + 1
  LEFT JOIN LATERAL (
    SELECT h.gt_id FROM hits h
    WHERE h.min_iou = r.min_iou AND h.video_id = r.video_id AND h.frame_idx = r.frame_idx
      AND h.class_id = r.class_id AND h.det_id = r.det_id AND NOT list_contains(g.taken, h.gt_id)
    ORDER BY h.iou DESC, h.gt_id LIMIT 1) b ON true),
points AS (
  SELECT min_iou, d.class_id, d.score, count(*) AS n, count(c.gt_id) AS tp
  FROM det d CROSS JOIN thresholds
  LEFT JOIN greedy c USING (min_iou, video_id, frame_idx, class_id, det_id) GROUP BY 1, 2, 3),
run AS (
  SELECT min_iou, class_id, score, sum(n) OVER w AS cum_n, CAST(sum(tp) OVER w AS BIGINT) AS cum_tp
  FROM points WINDOW w AS (PARTITION BY min_iou, class_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
wanted AS (SELECT class_id, count(*) AS n_truth FROM truth GROUP BY 1),
levels AS (SELECT i AS level FROM range(101) AS r(i)),
reached AS (
  SELECT min_iou, class_id, level,
    max(cum_tp / cum_n) FILTER (100 * cum_tp >= level * n_truth) AS precision
  FROM run JOIN wanted USING (class_id) CROSS JOIN levels GROUP BY 1, 2, 3),
ap AS (SELECT class_id, min_iou, sum(coalesce(precision, 0)) / 101 AS ap FROM reached GROUP BY 1, 2)"""
)

RAW = """
slots AS (SELECT i AS j FROM range(20) AS r(i)),
padded AS (
  SELECT o_orderkey % 16 AS video_id, CAST(floor(o_orderkey / 16) AS BIGINT) AS frame_idx, o_custkey % 13 AS n, j,
    (o_custkey + j * 7) % 4 + 1 AS class_id,
    CAST(CAST(((o_orderkey * 31 + o_custkey * 17 + j * 271) % 1000) / 1000e0 AS FLOAT) AS DOUBLE) AS score,
    ((o_orderkey * 7 + j * 53) % 600) / 720e0 AS top, ((o_custkey * 11 + j * 97) % 1100) / 1280e0 AS lft,
    (40 + (j * 13 + o_custkey) % 80) / 720e0 AS high, (40 + (o_orderkey + j * 29) % 120) / 1280e0 AS wide
  FROM orders CROSS JOIN slots),
exploded AS (
  SELECT video_id, frame_idx, j AS det_pos, class_id, score,
    CAST(CAST(top AS FLOAT) AS DOUBLE) AS ymin, CAST(CAST(lft AS FLOAT) AS DOUBLE) AS xmin,
    CAST(CAST(top + high AS FLOAT) AS DOUBLE) AS ymax, CAST(CAST(lft + wide AS FLOAT) AS DOUBLE) AS xmax
  FROM padded WHERE j < n),
labels_of AS (SELECT * FROM (VALUES (1, 'player'), (2, 'puck'), (3, 'goal')) AS l(id, name)),
labelled AS (
  SELECT e.*, coalesce(l.name, 'N/A') AS name FROM exploded e LEFT JOIN labels_of l ON e.class_id = l.id)"""

GOALS = (
    RAW
    + """,
goals AS (
  SELECT video_id, frame_idx, count(*) AS n_evidence, max(score) AS best_score
  FROM labelled WHERE name = 'goal' AND score >= 0.5 GROUP BY 1, 2)"""
)

SCENE = (
    BOXES
    + """,
scene AS (
  SELECT b.*, CASE quantity % 4 + 1 WHEN 1 THEN 'player' WHEN 2 THEN 'puck' WHEN 3 THEN 'goal' ELSE 'N/A' END AS name
  FROM boxes b)"""
)

CENTRED = """i.x + i.w / 2 BETWEEN o.x AND o.x + o.w AND i.y + i.h / 2 BETWEEN o.y AND o.y + o.h"""

FRAMES = """
frames AS (
  SELECT o_orderkey % 16 AS video_id, CAST(floor(o_orderkey / 16) AS BIGINT) AS frame_idx FROM orders)"""

MOTION = """
motion AS (
  SELECT user_id % 8 AS video_id, CAST(floor(event_id / 32) AS BIGINT) AS frame_idx, event_id AS det_id,
    CAST(floor(user_id / 8) AS BIGINT) % 6 * 120 + floor(event_id / 32) * 1.5e0 + event_id % 7 AS x,
    CAST(event_id % 5 + 200 AS DOUBLE) AS y, 60e0 AS w, 120e0 AS h
  FROM events WHERE event_type <> 'error'),
mframes AS (
  SELECT DISTINCT user_id % 8 AS video_id, CAST(floor(event_id / 32) AS BIGINT) AS frame_idx FROM events),
first_box AS (
  SELECT * FROM motion QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY frame_idx, det_id) = 1),
start_boxes AS (
  SELECT video_id, track_id, frame_idx, x + track_id * 45 AS x, y, w, h
  FROM first_box CROSS JOIN (VALUES (CAST(0 AS BIGINT)), (CAST(1 AS BIGINT))) AS t(track_id)),
numbered AS (
  SELECT s.video_id, s.track_id, f.frame_idx,
    row_number() OVER (PARTITION BY s.video_id, s.track_id ORDER BY f.frame_idx) AS n
  FROM mframes f JOIN start_boxes s ON f.video_id = s.video_id AND f.frame_idx > s.frame_idx)"""


def _track(cost: str, reach: str) -> str:
    """Frame by frame with a recursive query: state s, candidates of the next frame m."""
    return f"""WITH RECURSIVE {MOTION},
follow AS (
  SELECT video_id, track_id, frame_idx, CAST(0 AS BIGINT) AS n, true AS success, x, y, w, h FROM start_boxes
  UNION ALL
  SELECT s.video_id, s.track_id, f.frame_idx, f.n, b.x IS NOT NULL,
    coalesce(b.x, s.x), coalesce(b.y, s.y), coalesce(b.w, s.w), coalesce(b.h, s.h)
  FROM follow s
  JOIN numbered f ON f.video_id = s.video_id AND f.track_id = s.track_id AND f.n = s.n + 1
  LEFT JOIN LATERAL (
    SELECT m.x, m.y, m.w, m.h FROM motion m
    WHERE m.video_id = s.video_id AND m.frame_idx = f.frame_idx AND {reach}
    ORDER BY {cost}, m.det_id LIMIT 1) b ON true)
SELECT video_id, track_id, frame_idx, success, x, y, w, h FROM follow WHERE n > 0"""


DISTANCE = "sqrt((s.x + s.w / 2 - (m.x + m.w / 2)) ** 2 + (s.y + s.h / 2 - (m.y + m.h / 2)) ** 2)"

PLAYERS = """
players AS (
  SELECT user_id % 8 AS video_id, user_id AS track_id, event_id AS frame_idx, event_type <> 'error' AS success,
    value * 10 + event_id % 100 AS x, CAST(event_id % 5 + 200 AS DOUBLE) AS y, 60.5e0 AS w, 120e0 AS h
  FROM events)"""

MOVES = (
    PLAYERS
    + """,
seen AS (
  SELECT video_id, track_id, frame_idx, x + w / 2 AS cx, y + h / 2 AS cy, video_id * 2.497e0 + 1.5e0 AS fps
  FROM players WHERE success),
moves AS (
  SELECT *, cx - lag(cx) OVER w AS dx, cy - lag(cy) OVER w AS dy,
    (frame_idx - lag(frame_idx) OVER w) / fps AS seconds
  FROM seen WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame_idx)),
paths AS (SELECT *, sqrt(dx * dx + dy * dy) AS distance, sqrt(dx * dx + dy * dy) / seconds AS speed FROM moves)"""
)

EARLY = """
log AS (
  SELECT user_id AS run_id, event_id AS step, value AS val_loss,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events),
judged AS (
  SELECT *, val_loss < coalesce(min(val_loss) OVER (PARTITION BY run_id ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'infinity'::DOUBLE) AS improves FROM log),
waits AS (
  SELECT *, max(CASE WHEN improves THEN pos END) OVER w AS mark_pos, max(CASE WHEN improves THEN step END) OVER w AS mark_step
  FROM judged WINDOW w AS (PARTITION BY run_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
stops AS (
  SELECT run_id, min(step) FILTER (pos - mark_pos >= 3) AS stop_step FROM waits GROUP BY 1)
SELECT w.run_id, max(w.mark_step) AS best_step, any_value(s.stop_step) AS stop_step
FROM waits w JOIN stops s ON w.run_id = s.run_id AND (s.stop_step IS NULL OR w.step <= s.stop_step)
GROUP BY 1"""

CHECKPOINTS = """
checkpoints AS (SELECT user_id AS run_id, event_id AS step, 'ckpt-' || event_id AS path FROM events)"""

def _aug() -> str:
    def draw(k: int) -> str:
        return f"CAST('0x' || substr(md5(video_id || '|' || frame_idx || '|7'), {1 + 8 * k}, 8) AS BIGINT) / 4294967296e0"

    return (
        f"WITH {FRAMES} SELECT video_id, frame_idx, {draw(0)} * 50e0 + -25e0 AS angle,"
        + f" {draw(1)} * 1e0 + 0.5e0 AS scale, {draw(2)} < 0.5e0 AS flip FROM frames"
    )


PICTURES = """
pictures AS (
  SELECT o_orderkey % 16 AS video_id, CAST(floor(o_orderkey / 16) AS BIGINT) AS frame_idx,
    md5(CAST(o_orderkey AS VARCHAR)) AS hex, [1, 3, 4, -1][CAST(o_orderkey % 4 + 1 AS INTEGER)] AS channels FROM orders),
colours AS (
  SELECT *, CASE WHEN channels > 0 THEN list_transform(range(4), lambda i: CASE WHEN channels = 1
    THEN repeat(substr(hex, CAST(1 + 2 * i AS BIGINT), 2), 3) ELSE substr(hex, CAST(1 + 2 * channels * i AS BIGINT), 6) END) END AS px
  FROM pictures)"""


def _fit(epochs: int, batches: int, rate: float, classes: int, report: bool = False) -> str:
    """Softmax regression by unrolled mini-batch steps; the last feature is the constant."""

    def shares(name: str, weights: str, rows: str) -> str:
        return f"""
{name}_z AS MATERIALIZED (SELECT vec_id, label, c, sum(v * w) AS z FROM x JOIN {weights} USING (k) WHERE {rows} GROUP BY 1, 2, 3),
{name} AS MATERIALIZED (
  SELECT *, exp(z - max(z) OVER own) AS e, z - max(z) OVER own AS d FROM {name}_z WINDOW own AS (PARTITION BY vec_id))"""

    parts, at = [], "w0"
    for n in range(epochs * batches):
        parts.append(shares(f"p{n}", at, f"NOT held_out AND batch = {n % batches}"))
        parts.append(f"""
g{n} AS MATERIALIZED (
  SELECT c, k, sum((share - CASE WHEN c = label THEN 1 ELSE 0 END) * v) AS g, count(*) AS n
  FROM (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS share FROM p{n}) JOIN x USING (vec_id, label) GROUP BY 1, 2),
w{n + 1} AS MATERIALIZED (SELECT c, k, w - {rate} * g / n AS w FROM {at} JOIN g{n} USING (c, k))""")
        at = f"w{n + 1}"
        if n % batches == batches - 1:
            parts.append(shares(f"q{n}", at, "held_out"))
            parts.append(f"""
loss{n // batches + 1} AS (
  SELECT avg(l) AS val_loss FROM (SELECT ln(sum(e)) - sum(d) FILTER (c = label) AS l FROM q{n} GROUP BY vec_id))""")
    log = " UNION ALL ".join(f"SELECT CAST({e} AS BIGINT) AS step, round(val_loss, 9) AS val_loss FROM loss{e}" for e in range(1, epochs + 1))
    if report:  # the last weights on all vectors
        parts.append(shares("r", at, "true"))
        log = f"""SELECT CAST({epochs} AS BIGINT) AS step, count(*) AS n, round(avg(l), 9) AS loss, round(avg(hit), 9) AS accuracy FROM (
  SELECT ln(sum(e)) - sum(d) FILTER (c = label) AS l, CASE WHEN sum(d) FILTER (c = label) = 0 THEN 1e0 ELSE 0e0 END AS hit FROM r GROUP BY vec_id)"""
    return f"""WITH
x AS MATERIALIZED (
  SELECT vec_id, label, vec_id % 5 = 0 AS held_out, vec_id % 2 AS batch, unnest(range(len(embedding) + 1)) AS k,
    unnest(list_append(list_transform(embedding, lambda e: CAST(e AS DOUBLE)), 1e0)) AS v FROM embeddings),
w0 AS MATERIALIZED (SELECT c, k, 0e0 AS w FROM range({classes}) AS r(c) CROSS JOIN (SELECT DISTINCT k FROM x)),{",".join(parts)}
{log}"""


ORACLE: dict[str, str] = {
    "goal_frames": f"WITH {GOALS} SELECT * FROM goals",
    "goal_containment": f"""WITH {SCENE}
SELECT i.video_id, i.frame_idx, count(*) AS n_evidence, max(i.score) AS best_score FROM scene i
WHERE i.name = 'player' AND EXISTS (
  SELECT 1 FROM scene o WHERE o.name = 'goal' AND o.video_id = i.video_id AND o.frame_idx = i.frame_idx AND {CENTRED})
GROUP BY 1, 2""",
    "contained_pairs": f"""WITH {SCENE}
SELECT i.video_id, i.frame_idx, i.det_id AS inner_id, o.det_id AS outer_id, i.score AS inner_score
FROM scene i JOIN scene o ON o.video_id = i.video_id AND o.frame_idx = i.frame_idx AND {CENTRED}
WHERE i.name = 'puck' AND o.name = 'goal'""",
    "goal_messages": f"WITH {GOALS} SELECT video_id, frame_idx, 'Goal detected at frame ' || frame_idx AS message FROM goals",
    "goal_alerts": f"WITH {GOALS} SELECT video_id, frame_idx, 'Goal detected at frame ' || frame_idx AS message FROM goals",
    "trim_explode": f"WITH {RAW} SELECT * FROM exploded",
    "labelled_detections": f"WITH {RAW} SELECT video_id, frame_idx, det_pos, class_id, name FROM labelled",
    "score_filter": f"""WITH {RAW} SELECT video_id, frame_idx, det_pos, score FROM exploded WHERE score > 0.3e0""",
    "pixel_boxes": f"""WITH {RAW} SELECT video_id, frame_idx, det_pos, xmin * 1280 AS x, ymin * 720 AS y,
  (xmax - xmin) * 1280 AS w, (ymax - ymin) * 720 AS h FROM exploded""",
    "overlay_rows": f"""WITH {RAW},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY score DESC, det_pos) AS box_rank
  FROM labelled WHERE score > 0.3e0)
SELECT video_id, frame_idx, det_pos, CAST(box_rank AS INTEGER) AS box_rank,
  name || ': ' || CAST(floor(score * 100 + 0.5e0) AS BIGINT) || '%' AS text,
  xmin * 1280 AS x, ymin * 720 AS y, (xmax - xmin) * 1280 AS w, (ymax - ymin) * 720 AS h
FROM ranked WHERE box_rank <= 5""",
    "top_boxes": f"""WITH {BOXES},
crowded AS (
  SELECT CAST(0 AS BIGINT) AS video_id, CAST(floor((frame_idx * 16 + video_id) / 500) AS BIGINT) AS frame_idx, det_id, score
  FROM boxes)
SELECT *, CAST(row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY score DESC, det_id) AS INTEGER) AS box_rank
FROM crowded QUALIFY box_rank <= 200""",
    "sample_frames": f"""WITH {FRAMES},
rates AS (SELECT DISTINCT video_id, CAST(trunc(video_id * 2.497e0 + 1.5e0) AS BIGINT) AS frame_interval FROM frames)
SELECT video_id, frame_idx, frame_interval FROM frames JOIN rates USING (video_id) WHERE frame_idx % frame_interval = 0""",
    "frame_names": f"""WITH {FRAMES}
SELECT video_id, 'out/' || video_id || '/frame' || frame_idx || '.jpg' AS path, frame_idx,
  'frame' || frame_idx AS label, 'aug_frame' || frame_idx || '.jpg' AS aug_name FROM frames""",
    "training_union": f"""WITH {FRAMES}
SELECT video_id, frame_idx, 'frame' || frame_idx || '.jpg' AS name FROM frames
UNION ALL SELECT video_id, frame_idx, 'aug_frame' || frame_idx || '.jpg' FROM frames""",
    "landing_status": """WITH
manifest AS (
  SELECT doc_id, doc_id || '.mp4' AS filename, CASE WHEN lang = 'en' THEN n_chars ELSE 0 END AS total FROM documents),
files AS (
  SELECT doc_id, CASE WHEN quality = 1 THEN n_chars ELSE n_chars // 2 END AS length FROM labels JOIN documents USING (doc_id))
SELECT filename, coalesce(length, 0) AS bytes_done, total, 100e0 * coalesce(length, 0) / nullif(total, 0) AS pct,
  CASE WHEN length IS NULL THEN 'missing' WHEN total = 0 THEN 'unknown' WHEN length >= total THEN 'complete'
    ELSE 'partial' END AS status
FROM manifest LEFT JOIN files USING (doc_id)""",
    "label_map": """WITH items AS (
  SELECT p_partkey AS map_id, 0 AS pos, p_size AS id, p_name AS name FROM part
  UNION ALL SELECT p_partkey, 1, p_size + 1, p_brand FROM part
  UNION ALL SELECT p_partkey, 2, p_size, 'repeat' FROM part
  UNION ALL SELECT p_partkey, 3, p_size * 3, p_type FROM part)
SELECT map_id, id, name FROM items WHERE id BETWEEN 1 AND 90
QUALIFY row_number() OVER (PARTITION BY map_id, id ORDER BY pos) = 1""",
    "example_roundtrip": f"""WITH {MATCH_TABLES}
SELECT video_id, frame_idx, gt_id AS id, class_id, x, y, w, h FROM truth""",
    "iou_pairs": f"WITH {PAIRS} SELECT * FROM pairs WHERE iou >= 0.1e0",
    "voc_match": f"WITH {VOC} SELECT * FROM matches",
    "coco_match": f"""WITH RECURSIVE {PAIRS},
hits AS (SELECT * FROM pairs WHERE iou >= 0.5),
ranked AS (
  SELECT video_id, frame_idx, class_id, det_id,
    row_number() OVER (PARTITION BY video_id, frame_idx, class_id ORDER BY score DESC, det_id) AS n
  FROM (SELECT DISTINCT video_id, frame_idx, class_id, det_id, score FROM hits)),
greedy AS (
  SELECT DISTINCT video_id, frame_idx, class_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS taken,
    CAST(NULL AS BIGINT) AS det_id, CAST(NULL AS BIGINT) AS gt_id, CAST(NULL AS DOUBLE) AS iou FROM hits
  UNION ALL
  SELECT g.video_id, g.frame_idx, g.class_id, r.n,
    CASE WHEN b.gt_id IS NULL THEN g.taken ELSE list_append(g.taken, b.gt_id) END, r.det_id, b.gt_id, b.iou
  FROM greedy g
  JOIN ranked r ON r.video_id = g.video_id AND r.frame_idx = g.frame_idx AND r.class_id = g.class_id AND r.n = g.n + 1
  LEFT JOIN LATERAL (
    SELECT h.gt_id, h.iou FROM hits h
    WHERE h.video_id = r.video_id AND h.frame_idx = r.frame_idx AND h.class_id = r.class_id AND h.det_id = r.det_id
      AND NOT list_contains(g.taken, h.gt_id)
    ORDER BY h.iou DESC, h.gt_id LIMIT 1) b ON true)
SELECT d.video_id, d.frame_idx, d.class_id, d.det_id, d.score, g.gt_id, g.iou, g.gt_id IS NOT NULL AS tp
FROM det d LEFT JOIN greedy g USING (video_id, frame_idx, class_id, det_id)""",
    "prf_by_class": f"WITH {PRF} SELECT * FROM prf",
    "pr_curve": f"WITH {CURVE} SELECT * FROM curve",
    "average_precision": f"""WITH {CURVE},
levels AS (SELECT i AS level FROM range(101) AS r(i)),
reached AS (
  SELECT class_id, level, n_truth, max(precision) FILTER (100 * cum_tp >= level * n_truth) AS precision
  FROM curve CROSS JOIN levels GROUP BY 1, 2, 3)
SELECT class_id, 'all_point' AS method, round(sum(tp / n_truth * envelope), 9) AS ap, any_value(n_truth) AS n_truth
FROM curve GROUP BY 1
UNION ALL
SELECT class_id, 'coco101', round(sum(coalesce(precision, 0)) / 101, 9), any_value(n_truth) FROM reached GROUP BY 1""",
    "coco_ap": f"WITH RECURSIVE {COCO_AP} SELECT class_id, min_iou, round(ap, 9) AS ap FROM ap",
    "coco_map": f"""WITH RECURSIVE {COCO_AP}
SELECT round(avg(ap), 9) AS map, round(avg(ap) FILTER (min_iou = 0.5), 9) AS map_50,
  round(avg(ap) FILTER (min_iou = 0.75), 9) AS map_75 FROM ap""",
    "metric_rows": f"""WITH {PRF}
SELECT class_id, key, value FROM (
  SELECT class_id, CAST(n_det AS DOUBLE) AS n_det, CAST(n_truth AS DOUBLE) AS n_truth,
    CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn, precision, recall, f1 FROM prf) AS wide
UNPIVOT INCLUDE NULLS (value FOR key IN (n_det, n_truth, tp, fp, fn, precision, recall, f1))""",
    "track_iou": _track(f"{_iou('s', 'm')} DESC", f"{_iou('s', 'm')} >= 0.3e0"),
    "track_centroid": _track(DISTANCE, f"{DISTANCE} <= 50"),
    "track_annotation": f"""WITH {PLAYERS}
SELECT video_id, track_id, frame_idx,
  CASE WHEN success THEN CAST(trunc(x) AS INTEGER) END AS p1_x, CASE WHEN success THEN CAST(trunc(y) AS INTEGER) END AS p1_y,
  CASE WHEN success THEN CAST(trunc(x + w) AS INTEGER) END AS p2_x,
  CASE WHEN success THEN CAST(trunc(y + h) AS INTEGER) END AS p2_y,
  CASE WHEN NOT success THEN 'Tracking failure detected' END AS message
FROM players""",
    "trajectory": f"""WITH {MOVES}
SELECT video_id, track_id, frame_idx, dx, dy, distance, speed FROM paths""",
    "track_summary": f"""WITH {MOVES},
counts AS (
  SELECT video_id, track_id, count(*) FILTER (success) AS frames_seen, count(*) FILTER (NOT success) AS failures
  FROM players GROUP BY 1, 2),
totals AS (
  SELECT video_id, track_id, coalesce(sum(distance), 0) AS path_length, max(speed) AS max_speed,
    max(frame_idx) - min(frame_idx) AS span, any_value(fps) AS fps FROM paths GROUP BY 1, 2)
SELECT video_id, track_id, frames_seen, failures, round(coalesce(path_length, 0), 6) AS path_length,
  round(path_length * fps / nullif(span, 0), 8) AS mean_speed, max_speed
FROM counts LEFT JOIN totals USING (video_id, track_id)""",
    "early_stop": f"WITH {EARLY}",
    "checkpoints_kept": f"""WITH {CHECKPOINTS}
SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS INTEGER) AS age_rank
FROM checkpoints QUALIFY age_rank <= 5""",
    "latest_checkpoint": f"WITH {CHECKPOINTS} SELECT run_id, max(step) AS step, arg_max(path, step) AS path FROM checkpoints GROUP BY 1",
    "frames_in_order": f"WITH {FRAMES} SELECT * FROM frames ORDER BY video_id, frame_idx",
    "aug_params": _aug(),
    "channel_swap": f"""WITH {PICTURES}
SELECT video_id, frame_idx, CASE WHEN channels < 0 THEN '' ELSE array_to_string(list_transform(px,
  lambda p: substr(p, 5, 2) || substr(p, 3, 2) || substr(p, 1, 2)), '') END AS data,
  CASE WHEN channels < 0 THEN -1 ELSE 3 END AS channels FROM colours""",
    "tensor_sums": f"""WITH {PICTURES}
SELECT video_id, frame_idx, CAST(list_sum(list_transform(px, lambda p: CAST('0x' || substr(p, 1, 2) AS INTEGER)
  + CAST('0x' || substr(p, 3, 2) AS INTEGER) + CAST('0x' || substr(p, 5, 2) AS INTEGER))) AS DOUBLE) AS total FROM colours""",
    "decode_counts": f"""WITH {PICTURES}
SELECT count(*) FILTER (channels > 0) AS loaded, count(*) FILTER (channels < 0) AS skipped FROM pictures""",
    "augmented_sizes": f"""WITH {PICTURES}, drawn AS ({_aug()}),
sized AS (
  SELECT p.video_id, p.frame_idx, channels, greatest(1, CAST(floor(2 * scale + 0.5e0) AS INTEGER)) AS side
  FROM pictures p JOIN drawn USING (video_id, frame_idx))
SELECT video_id, frame_idx, CASE WHEN channels < 0 THEN -1 ELSE side END AS height,
  CASE WHEN channels < 0 THEN -1 ELSE side END AS width,
  CAST(CASE WHEN channels < 0 THEN 0 ELSE 3 * side * side END AS BIGINT) AS n_bytes FROM sized""",
    "detect": f"""WITH {PICTURES},
flat AS (
  SELECT video_id, frame_idx, list_transform(range(12), lambda k: CAST('0x' || substr(px[k // 3 + 1], CAST(5 - 2 * (k % 3) AS BIGINT), 2) AS INTEGER)) AS v
  FROM colours WHERE channels > 0),
found AS (SELECT *, unnest(range(CASE WHEN list_sum(v) > 1500 THEN 2 ELSE 1 END)) AS j FROM flat)
SELECT video_id, frame_idx, j AS det_pos, CAST(v[9 + j] % 4 + 1 AS BIGINT) AS class_id, v[11 + j] / 256e0 AS score,
  v[1 + 4 * j] / 256e0 AS ymin, v[2 + 4 * j] / 256e0 AS xmin, v[3 + 4 * j] / 256e0 AS ymax, v[4 + 4 * j] / 256e0 AS xmax FROM found""",
    "augmented_pixels": f"""WITH {PICTURES}, drawn AS ({_aug()}),
turned AS (
  SELECT c.*, flip, greatest(1, CAST(floor(2 * scale + 0.5e0) AS BIGINT)) AS n,
    CAST(floor(cos(radians(angle)) * 65536 + 0.5e0) AS BIGINT) AS c, CAST(floor(sin(radians(angle)) * 65536 + 0.5e0) AS BIGINT) AS s
  FROM colours c JOIN drawn USING (video_id, frame_idx)),
cells AS (
  SELECT *, unnest(range(n * n)) AS k FROM turned WHERE channels > 0),
centred AS (
  SELECT *, 2 * ((2 * (k // n) + 1) // n) - 1 AS y, 2 * ((2 * (CASE WHEN flip THEN n - 1 - k % n ELSE k % n END) + 1) // n) - 1 AS x FROM cells),
mapped AS (
  SELECT *, CAST(floor((c * x - s * y + 131072) / 131072e0) AS BIGINT) AS sx, CAST(floor((s * x + c * y + 131072) / 131072e0) AS BIGINT) AS sy FROM centred)
SELECT video_id, frame_idx, CAST(any_value(n) AS INTEGER) AS height,
  string_agg(CASE WHEN sx BETWEEN 0 AND 1 AND sy BETWEEN 0 AND 1 THEN px[2 * sy + sx + 1] ELSE '000000' END, '' ORDER BY k) AS data
FROM mapped GROUP BY 1, 2
UNION ALL SELECT video_id, frame_idx, -1, '' FROM pictures WHERE channels < 0""",
    "drawn_pixels": f"""WITH {PICTURES},
corners AS (
  SELECT *, CASE WHEN channels > 0 THEN substr(hex, 1, CAST(8 * channels AS BIGINT)) ELSE '' END AS raw, frame_idx % 3 AS x1, video_id % 2 AS y1,
    CAST(floor(frame_idx % 3 + 5.5e0) AS BIGINT) AS x2, video_id % 2 + frame_idx % 3 AS y2 FROM colours)
SELECT video_id, frame_idx, CASE WHEN x1 = 0 OR channels < 0 THEN raw ELSE array_to_string(list_transform(range(4), lambda k:
  CASE WHEN (k // 2 IN (y1, y2) AND k % 2 BETWEEN x1 AND x2) OR (k % 2 IN (x1, x2) AND k // 2 BETWEEN y1 AND y2) THEN 'ff0000' ELSE px[k + 1] END), '') END AS data
FROM corners""",
    "frames_landed": f"""WITH {PICTURES}
SELECT video_id, frame_idx, CASE WHEN channels > 0 THEN 2 ELSE -1 END AS height,
  CAST(CASE WHEN channels > 0 THEN 4 * channels ELSE 0 END AS BIGINT) AS n_bytes FROM pictures""",
    "score_linear": """SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 4) AS prediction
FROM embeddings""",
}
ORACLE["fit_log"] = _fit(epochs=3, batches=2, rate=0.5, classes=10)
ORACLE["evaluate_checkpoint"] = _fit(epochs=3, batches=2, rate=0.5, classes=10, report=True)
ORACLE["examples_written"] = ORACLE["example_roundtrip"]
ORACLE["live_goals"] = f"""SELECT DISTINCT video_id, frame_idx, 'Goal detected at frame ' || frame_idx AS message
FROM ({ORACLE['detect']}) WHERE class_id = 3 AND score >= 0.5"""
# The stream reports what the batch tracker does.
ORACLE["track_stream"] = ORACLE["track_iou"]
# Following players from raw detections sees the same boxes as following them from pixel rows.
ORACLE["players_summary"] = f"""WITH tracks AS ({ORACLE['track_iou']})
SELECT video_id, track_id, count(*) FILTER (success) AS frames_seen, count(*) FILTER (NOT success) AS failures
FROM tracks GROUP BY 1, 2"""
