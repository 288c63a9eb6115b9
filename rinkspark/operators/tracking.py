"""Following one target per track through the detections of a video, and its movement.

A tracker's state is its last good box. In each later frame it moves to the best detection
that is near enough, else it reports a failure and keeps its state, so a lost target may
be found again. This is sequential, but a video need not be one task:

1. *links*: videos are cut into chunks of whole frames with about equally many boxes; inside a
   chunk every detection is taken as a state and linked to the detection it would move to
   next. Following links to the end gives its chunk-final detection, its *tail*.
2. *bridges*: each tail is joined with the detections of later chunks to find where the
   target reappears. The grid keeps that join local in space, and a horizon that doubles
   from round to round keeps it local in time: only targets still lost look further.
3. *routes*: per track, from the initial box, tail and bridge alternate. Only bridges are
   read here, a small part of the detections, by repeated doubling joins.
4. *walks*: each chunk a route enters is walked from its entry; the visited detections are
   the track's successes. Frames without one are failures, with the last good box carried on.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinkspark.functions.boxes import (
    box_of,
    centre_distance,
    in_near_cells,
    in_own_cell,
    in_partner_cells,
    in_square_cell,
    iou,
    iou_reach,
    same_cell,
)
from rinkspark.functions.chunks import CHUNK, chunk_of, with_earlier_chunks
from rinkspark.functions.joins import null_safe_join
from rinkspark.operators.detections import FRAME
from rinkspark.session import ensure_checkpoint_dir, for_python

TRACK_IOU = 0.3
MAX_DISTANCE = 50.0
# A chunk ends with the frame in which its boxes reach this number.
CHUNK_BOXES = 32_768
# States compared with boxes at a time.
BLOCK_STATES, BLOCK_BOXES = 256, 4096
FAILURE_TEXT = "Tracking failure detected"

BOX = ("x", "y", "w", "h")


def check_algorithm(algorithm: str) -> None:
    if algorithm not in ("iou", "centroid"):
        raise ValueError("Invalid tracking algorithm")


def step_costs(algorithm: str, threshold: float, max_distance: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of states (n, 4) and boxes (m, 4) to an (n, m) cost, lower better, inf when out of reach."""
    check_algorithm(algorithm)

    def by_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = a[:, None, :], b[None, :, :]
        iw = np.minimum(a[..., 0] + a[..., 2], b[..., 0] + b[..., 2]) - np.maximum(a[..., 0], b[..., 0])
        ih = np.minimum(a[..., 1] + a[..., 3], b[..., 1] + b[..., 3]) - np.maximum(a[..., 1], b[..., 1])
        inter = np.maximum(iw, 0.0) * np.maximum(ih, 0.0)
        union = a[..., 2] * a[..., 3] + b[..., 2] * b[..., 3] - inter
        value = np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)
        return np.where(value >= threshold, -value, np.inf)

    def by_centroid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ac, bc = a[:, :2] + a[:, 2:] / 2, b[:, :2] + b[:, 2:] / 2
        d = ac[:, None, :] - bc[None, :, :]
        dist = np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1])
        return np.where(dist <= max_distance, dist, np.inf)

    return by_iou if algorithm == "iou" else by_centroid


def _cost_column(a: tuple, b: tuple, algorithm: str, threshold: float, max_distance: float) -> Column:
    """The same cost as :func:`step_costs`; NULL when out of reach."""
    if algorithm == "iou":
        value = iou(a, b)
        return F.when(value >= threshold, -value)
    dist = centre_distance(a, b)
    return F.when(dist <= max_distance, dist)


#: Side of the centroid tracker's cells, in distances.
NEAR_CELLS = 4


def _in_reach(df: DataFrame, algorithm: str, threshold: float, max_distance: float) -> DataFrame:
    """Copies of the boxes to every cell where their next detection may be centred."""
    if algorithm == "iou":
        return in_partner_cells(df, threshold)
    return in_near_cells(df, max_distance, NEAR_CELLS * max_distance)


def _own_cell(df: DataFrame, prefix: str, algorithm: str, max_distance: float) -> DataFrame:
    return in_own_cell(df, prefix) if algorithm == "iou" else in_square_cell(df, NEAR_CELLS * max_distance, prefix)


def _widest_step(algorithm: str, threshold: float, max_distance: float) -> Callable[[np.ndarray], float]:
    """How far along x the next box can be centred, given the boxes to choose from."""
    if algorithm == "iou":
        return lambda boxes: float(boxes[:, 2].max() * iou_reach(threshold) * (1 + 1e-9) + 1e-6)
    return lambda boxes: max_distance * (1 + 1e-9)


def _choose(costs: Callable, widest: Callable, states: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """For each state the first of its cheapest boxes, -1 without any. States meet only boxes near along x."""
    chosen = np.full(len(states), -1)
    at, to = states[:, 0] + states[:, 2] / 2, boxes[:, 0] + boxes[:, 2] / 2
    by_state, by_box = np.argsort(at, kind="stable"), np.argsort(to, kind="stable")
    at, to, reach = at[by_state], to[by_box], widest(boxes)
    for s in range(0, len(states), BLOCK_STATES):
        own = by_state[s : s + BLOCK_STATES]
        low = np.searchsorted(to, at[s] - reach, "left")
        high = np.searchsorted(to, at[s + len(own) - 1] + reach, "right")
        near = np.sort(by_box[low:high])
        best = np.full(len(own), np.inf)
        for b in range(0, len(near), BLOCK_BOXES):
            part = near[b : b + BLOCK_BOXES]
            cost = costs(states[own], boxes[part])
            pick = cost.argmin(axis=1)  # first of equals: boxes are in node_id order
            value = cost[np.arange(len(own)), pick]
            better = value < best
            best[better] = value[better]
            chosen[own[better]] = part[pick[better]]
    return chosen


def _link_chunk(costs: Callable, widest: Callable) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Next and last state of every state of one (video, chunk); -1 marks no next."""

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["frame_idx", "is_init", "node_id"], kind="stable").reset_index(drop=True)
        boxes = rows[list(BOX)].to_numpy(float)
        is_init = rows["is_init"].to_numpy(bool)
        frames = rows["frame_idx"].to_numpy()
        starts = np.flatnonzero(np.r_[True, frames[1:] != frames[:-1]])
        ends = np.r_[starts[1:], len(rows)]
        following = np.full(len(rows), -1)
        open_states = np.empty(0, dtype=int)
        for s, e in zip(starts, ends):
            here = np.arange(s, e)
            targets = here[~is_init[s:e]]
            if len(open_states) and len(targets):
                pick = _choose(costs, widest, boxes[open_states], boxes[targets])
                hit = pick >= 0
                following[open_states[hit]] = targets[pick[hit]]
                open_states = open_states[~hit]
            open_states = np.r_[open_states, here]
        last = np.arange(len(rows))
        for i in range(len(rows) - 1, -1, -1):
            if following[i] >= 0:
                last[i] = last[following[i]]
        rows["next_pos"] = following
        rows["last_pos"] = last
        rows["pos"] = np.arange(len(rows))
        return rows[["video_id", "chunk", "pos", "frame_idx", "is_init", "node_id", "track_id", *BOX, "next_pos", "last_pos"]]

    return link


def _routes(starts: DataFrame, bridges: DataFrame) -> DataFrame:
    """Entries of every track from its start along tail -> entry -> tail, in log2(route length) rounds of joins.

    ``reached`` holds the tails within 2^k bridges of a start, ``jump`` leads 2^k bridges on.
    """
    at = ["video_id", "chunk", "pos"]
    reached = starts.select("video_id", "track_id", "chunk", F.col("last_pos").alias("pos")).checkpoint()
    jump = bridges.select(*at, F.col("entry_chunk").alias("to_chunk"), F.col("entry_last").alias("to_pos"))
    while True:
        new = reached.join(jump, at).select("video_id", "track_id", F.col("to_chunk").alias("chunk"), F.col("to_pos").alias("pos"))
        new = new.checkpoint()
        if new.isEmpty():
            break
        reached = reached.unionByName(new)
        onward = jump.select(
            "video_id",
            F.col("chunk").alias("to_chunk"),
            F.col("pos").alias("to_pos"),
            F.col("to_chunk").alias("far_chunk"),
            F.col("to_pos").alias("far_pos"),
        )
        jump = (
            jump.join(onward, ["video_id", "to_chunk", "to_pos"])
            .select(*at, F.col("far_chunk").alias("to_chunk"), F.col("far_pos").alias("to_pos"))
            .checkpoint()
        )
    entered = bridges.join(reached, at).select(
        "video_id", "track_id", F.col("entry_chunk").alias("chunk"), F.col("entry_pos").alias("pos")
    )
    return starts.select("video_id", "track_id", "chunk", "pos").unionByName(entered)


def _walk(links: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """Detections each track visits in one chunk, from its entry to the last link."""
    columns = ["video_id", "track_id", "frame_idx", *BOX]
    if links.empty or entries.empty:
        return pd.DataFrame(columns=columns)
    links = links.set_index("pos")
    following = links["next_pos"].to_dict()
    visited, tracks = [], []
    for track, pos in zip(entries["track_id"], entries["pos"]):
        while pos >= 0:
            visited.append(pos)
            tracks.append(track)
            pos = following[pos]
    rows = links.loc[visited].reset_index(drop=True)
    rows["track_id"] = tracks
    return rows.loc[~rows["is_init"], columns]


def _frame_chunks(states: DataFrame, chunk_boxes: int) -> DataFrame:
    """``chunk`` of every frame: how often the boxes of the video's earlier frames fill ``chunk_boxes``."""
    sizes = states.groupBy(*FRAME).agg(F.count("*").alias("n")).withColumn("span", chunk_of(F.col("frame_idx")))
    sizes = with_earlier_chunks(sizes, ["video_id"], "span", {"n_before": (F.sum("n"), F.sum)})
    inside = Window.partitionBy("video_id", "span").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce("n_before", F.lit(0)) + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return sizes.select(*FRAME, F.floor(before / chunk_boxes).cast("bigint").alias("chunk"))


def _last_seen_struct() -> Column:
    return F.struct("frame_idx", *BOX)


def track(
    det: DataFrame,
    init_boxes: DataFrame,
    frames: DataFrame | None = None,
    algorithm: str = "iou",
    threshold: float = TRACK_IOU,
    max_distance: float = MAX_DISTANCE,
    chunk_boxes: int = CHUNK_BOXES,
) -> DataFrame:
    """One row per track and frame after its initial frame: ``success`` and the last good box.

    ``init_boxes``: ``video_id, frame_idx, x, y, w, h`` and optionally ``track_id`` (else 0,
    one track per video). ``frames`` lists the frames to report; without it those with a
    detection. ``iou`` needs IoU >= ``threshold``, ``centroid`` a centre within
    ``max_distance`` pixels; ties go to the lowest ``det_id``.
    """
    check_algorithm(algorithm)
    costs = step_costs(algorithm, threshold, max_distance)
    ensure_checkpoint_dir(det.sparkSession)
    if "track_id" not in init_boxes.columns:
        init_boxes = init_boxes.withColumn("track_id", F.lit(0).cast("bigint"))

    doubles = [F.col(c).cast("double").alias(c) for c in BOX]
    # Copies of a box in a frame never win against its lowest id: collapse them before grouping.
    boxes = det.select(*FRAME, "det_id", *doubles).groupBy(*FRAME, *BOX).agg(F.min("det_id").alias("node_id"))
    by_type = {f.name: f.dataType for f in [*boxes.schema.fields, init_boxes.schema["track_id"]]}
    inits = init_boxes.select(*FRAME, *doubles, F.lit(None).cast(by_type["node_id"]).alias("node_id"), "track_id")
    states = boxes.withColumns({"track_id": F.lit(None).cast(by_type["track_id"]), "is_init": F.lit(False)})
    states = states.unionByName(inits.withColumn("is_init", F.lit(True)))
    states = null_safe_join(states, _frame_chunks(states, chunk_boxes), FRAME)

    link_schema = T.StructType(
        [
            T.StructField("video_id", by_type["video_id"]),
            T.StructField("chunk", T.LongType()),
            T.StructField("pos", T.LongType()),
            T.StructField("frame_idx", by_type["frame_idx"]),
            T.StructField("is_init", T.BooleanType()),
            T.StructField("node_id", by_type["node_id"]),
            T.StructField("track_id", by_type["track_id"]),
            *[T.StructField(c, T.DoubleType()) for c in BOX],
            T.StructField("next_pos", T.LongType()),
            T.StructField("last_pos", T.LongType()),
        ]
    )
    # Read several times below, and costly to recompute after a lost executor: written once.
    link = _link_chunk(costs, _widest_step(algorithm, threshold, max_distance))
    grouped = for_python(states, "video_id", "chunk").groupBy("video_id", "chunk")
    links = grouped.applyInPandas(link, link_schema).checkpoint()

    tails = links.filter("next_pos < 0").select("video_id", "chunk", "pos", *BOX)
    entries = links.filter(~F.col("is_init")).select(
        F.col("video_id").alias("e_video"),
        F.col("chunk").alias("e_chunk"),
        F.col("pos").alias("e_pos"),
        F.col("last_pos").alias("e_last"),
        F.col("frame_idx").alias("e_frame"),
        F.col("node_id").alias("e_node"),
        *[F.col(c).alias(f"e_{c}") for c in BOX],
    )
    entries = _own_cell(entries, "e_", algorithm, max_distance)
    cost = _cost_column(box_of(), box_of("e_"), algorithm, threshold, max_distance)

    def reappear(lost: DataFrame, far: int, step: int) -> DataFrame:
        """Where targets lost in a chunk come back, ``far`` + 1 to ``far`` + ``step`` chunks later."""
        here = F.col("chunk") + far
        bins = F.sequence(F.floor((here + 1) / step), F.floor((here + step) / step))  # two at most
        probes = _in_reach(lost.withColumn("bin", F.explode(bins)), algorithm, threshold, max_distance)
        near = (F.col("video_id") == F.col("e_video")) & same_cell("", "e_") & cost.isNotNull()
        soon = (F.col("e_bin") == F.col("bin")) & (F.col("e_chunk") > here) & (F.col("e_chunk") <= here + step)
        choice = F.min(F.struct("e_frame", cost.alias("cost"), "e_node", "e_chunk", "e_pos", "e_last"))
        return (
            probes.join(entries.withColumn("e_bin", F.floor(F.col("e_chunk") / step)), near & soon)
            .groupBy("video_id", "chunk", "pos")
            .agg(choice.alias("e"))
            .select(
                "video_id",
                "chunk",
                "pos",
                F.col("e.e_chunk").alias("entry_chunk"),
                F.col("e.e_pos").alias("entry_pos"),
                F.col("e.e_last").alias("entry_last"),
            )
        )

    last_chunk = links.agg(F.max("chunk")).first()[0] or 0
    bridges, lost, far, step = None, tails, 0, 1
    while bridges is None or far < last_chunk:
        found = reappear(lost, far, step).checkpoint()
        bridges = found if bridges is None else bridges.unionByName(found)
        far, step = far + step, 2 * step
        if far < last_chunk:
            still = lost.join(found.select("video_id", "chunk", "pos"), ["video_id", "chunk", "pos"], "left_anti")
            lost = still.filter(F.col("chunk") + far < last_chunk).checkpoint()

    # aliased anew: both sides of the cogroup descend from the same table
    starts = links.filter("is_init").select(*[F.col(c).alias(c) for c in ("video_id", "track_id", "chunk", "pos", "last_pos")])
    routes = _routes(starts, bridges)
    video_type, track_type = by_type["video_id"].simpleString(), by_type["track_id"].simpleString()
    walk_schema = f"video_id {video_type}, track_id {track_type}, frame_idx bigint, " + ", ".join(f"{c} double" for c in BOX)
    seen = (
        for_python(links.drop("track_id"), "video_id", "chunk")
        .groupBy("video_id", "chunk")
        .cogroup(for_python(routes, "video_id", "chunk").groupBy("video_id", "chunk"))
        .applyInPandas(_walk, walk_schema)
    )

    # Report every frame after the start; failures carry the last good box.
    listed = (det if frames is None else frames).select(*FRAME).distinct()
    first = init_boxes.select(
        "video_id", "track_id", F.col("frame_idx").alias("first_frame"), *[F.col(c).cast("double").alias(f"i_{c}") for c in BOX]
    )
    grid = listed.join(first, "video_id").filter(F.col("frame_idx") > F.col("first_frame"))
    rows = grid.join(seen, ["video_id", "track_id", "frame_idx"], "left")
    rows = rows.withColumns(
        {
            "success": F.col("x").isNotNull(),
            "chunk": chunk_of(F.col("frame_idx"), CHUNK),
            "good": F.when(F.col("x").isNotNull(), _last_seen_struct()),
        }
    )
    keys = ["video_id", "track_id"]
    rows = with_earlier_chunks(rows, keys, "chunk", {"good_before": (F.max("good"), F.max)})
    so_far = Window.partitionBy(*keys, "chunk").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("state", F.coalesce(F.max("good").over(so_far), F.col("good_before")))
    return rows.select(
        *keys, "frame_idx", "success", *[F.coalesce(F.col(f"state.{c}"), F.col(f"i_{c}")).alias(c) for c in BOX]
    )


def corners(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """Top-left and bottom-right corner, each coordinate truncated once."""
    def point(px: Column, py: Column) -> Column:
        return F.struct(px.cast("int").alias("x"), py.cast("int").alias("y"))

    return point(x, y), point(x + w, y + h)


def annotate_tracks(tracks: DataFrame) -> DataFrame:
    """What to draw for each track row: a rectangle ``p1``-``p2`` or the failure text."""
    p1, p2 = corners(*box_of())
    ok = F.col("success")
    return tracks.withColumns(
        {"p1": F.when(ok, p1), "p2": F.when(ok, p2), "message": F.when(~ok, F.lit(FAILURE_TEXT))}
    )


def trajectory(tracks: DataFrame, videos: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Movement between consecutive successful rows of a track: offset, distance, pixels per second.

    The first sighting has NULLs, and so have the speeds of a video without a frame rate. Failures
    move nothing and are left out.
    """
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    seen = tracks.filter("success").select("video_id", "track_id", "frame_idx", cx.alias("cx"), cy.alias("cy"))
    seen = seen.withColumns({"chunk": chunk_of(F.col("frame_idx"), chunk), "at": F.struct("frame_idx", "cx", "cy")})
    keys = ["video_id", "track_id"]
    seen = with_earlier_chunks(seen, keys, "chunk", {"at_before": (F.max("at"), F.max)})
    inside = Window.partitionBy(*keys, "chunk").orderBy("frame_idx")
    seen = seen.withColumn("prev", F.coalesce(F.lag("at").over(inside), F.col("at_before")))
    dx, dy = F.col("cx") - F.col("prev.cx"), F.col("cy") - F.col("prev.cy")
    seen = seen.join(videos.select("video_id", "fps"), "video_id", "left")
    seconds = (F.col("frame_idx") - F.col("prev.frame_idx")) / F.col("fps")
    distance = F.sqrt(dx * dx + dy * dy)
    return seen.select(
        *keys,
        "frame_idx",
        "cx",
        "cy",
        dx.alias("dx"),
        dy.alias("dy"),
        distance.alias("distance"),
        F.try_divide(distance, seconds).alias("speed"),
    )


def track_summary(tracks: DataFrame, videos: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per track: frames seen, failures, path length, mean and top speed.

    Mean speed is path length over the time between first and last sighting.
    """
    keys = ["video_id", "track_id"]
    counts = tracks.groupBy(*keys).agg(
        F.count_if("success").alias("frames_seen"), F.count_if(~F.col("success")).alias("failures")
    )
    moves = (
        trajectory(tracks, videos, chunk)
        .groupBy(*keys)
        .agg(
            F.coalesce(F.sum("distance"), F.lit(0.0)).alias("path_length"),
            F.max("speed").alias("max_speed"),
            (F.max("frame_idx") - F.min("frame_idx")).alias("span"),
        )
    )
    out = counts.join(moves, keys, "left").join(videos.select("video_id", "fps"), "video_id", "left")
    return out.select(
        *keys,
        "frames_seen",
        "failures",
        F.coalesce("path_length", F.lit(0.0)).alias("path_length"),
        F.try_divide(F.col("path_length") * F.col("fps"), F.col("span")).alias("mean_speed"),
        "max_speed",
    )
