"""The tracker as a stateful stream: frames may arrive out of order, and memory does not follow the micro-batch.

State of a track: its last good box, and the frames that wait. A frame waits in the state store, in a block of
``BLOCK`` time slots, until the watermark has passed the end of its slot: then no earlier frame can follow. One
event-time timer per track takes all frames out in order that are due, block by block, and sets the next timer. Every
frame is written and read a few times at most, however many arrive in one batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rinkspark.operators.tracking import BOX, MAX_DISTANCE, TRACK_IOU, check_algorithm, step_costs

#: How late a frame may come, and the time that one timer serves, in event time.
DELAY, SLOT_MS = "10 seconds", 1000
#: Time slots whose frames share an entry of the state store.
BLOCK = 64
#: Frames reported at a time; the timer of a track without waiting frames.
ROWS, NEVER = 4096, 1 << 62
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Timers and map state need the RocksDB store; one that the session names already is left alone."""
    if "RocksDB" not in spark.conf.get(STORE, ""):
        spark.conf.set(STORE, ROCKS)


def frame_rows(det: DataFrame, frames: DataFrame, *more: str) -> DataFrame:
    """One row per frame with its boxes as an array, the tracker stream's input; ``more`` columns of ``frames`` stay."""
    # copies of a box never win against its lowest id: they collapse before the boxes are gathered
    doubles = [F.col(c).cast("double").alias(c) for c in BOX]
    distinct = det.select("video_id", "frame_idx", "det_id", *doubles)
    distinct = distinct.groupBy("video_id", "frame_idx", *BOX).agg(F.min("det_id").alias("det_id"))
    boxes = distinct.groupBy("video_id", "frame_idx").agg(F.collect_list(F.struct("det_id", *BOX)).alias("boxes"))
    return frames.select("video_id", "frame_idx", *more).join(boxes, ["video_id", "frame_idx"], "left")


class FollowTarget(StatefulProcessor):
    """One target of one video. ``waiting`` holds blocks of frames by time, ``target`` the last good box, what was passed, and the timer."""

    def __init__(self, algorithm: str, threshold: float, max_distance: float, slot_ms: int):
        self.costs = step_costs(algorithm, threshold, max_distance)
        self.slot_ms = slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "block long", "at array<long>, frame_idx array<long>, boxes array<array<double>>")
        self.target = handle.getValueState(
            "target", "passed long, last_frame long, x double, y double, w double, h double, late_dropped long, timer long"
        )

    def slot(self, at: int) -> int:
        """Which slot a time belongs to; it ends at this number times the slot's length."""
        return -(-at // self.slot_ms)

    def block(self, number: int) -> dict[tuple[int, int], list[float]]:
        """Waiting frames of a block by time and number."""
        if not self.waiting.containsKey((number,)):
            return {}
        at, frame, boxes = self.waiting.getValue((number,))
        return {(int(a), int(f)): list(b) for a, f, b in zip(at, frame, boxes)}

    def keep(self, number: int, held: dict[tuple[int, int], list[float]]) -> None:
        at, frame = [a for a, _ in held], [f for _, f in held]
        self.waiting.updateValue((number,), (at, frame, list(held.values())))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        target = self.target.get() if self.target.exists() else None
        late, earliest = 0, NEVER
        for pdf in rows:  # one Arrow batch at a time, never the whole of a micro-batch
            if target is None:
                start = pdf.iloc[0]
                target = (-(1 << 62), int(start["first_frame"]), *[float(start[f"i_{c}"]) for c in BOX], 0, NEVER)
            arrived: dict[int, dict[tuple[int, int], list[float]]] = {}
            for at, frame, boxes in zip(pdf["at"].tolist(), pdf["frame_idx"].tolist(), pdf["boxes"]):
                if at <= target[0] or frame <= target[1]:
                    late += 1
                    continue
                arrived.setdefault(self.slot(at) // BLOCK, {})[at, frame] = boxes.tolist()
                earliest = min(earliest, self.slot(at) * self.slot_ms)
            for number, frames in arrived.items():
                self.keep(number, {**self.block(number), **frames})
        timer = target[7]
        if earliest < timer:
            if timer < NEVER:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(earliest)
            timer = earliest
        self.target.update((*target[:6], target[6] + late, timer))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, last, *box, late, _ = self.target.get()
        # slots that end at or before the watermark are complete
        passed = max(passed, expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() // self.slot_ms * self.slot_ms)
        out, timer = [], NEVER
        for number in sorted(int(k[0]) for k in self.waiting.keys()):
            held = self.block(number)
            due = sorted(k for k in held if k[0] <= passed)
            for at, frame in due:
                boxes = np.array(held.pop((at, frame)), dtype=float).reshape(-1, 4)
                if frame <= last:
                    late += 1
                    continue
                last, success = frame, False
                if len(boxes):
                    cost = self.costs(np.array([box]), boxes)[0]
                    pick = int(cost.argmin())
                    if np.isfinite(cost[pick]):
                        box, success = [float(v) for v in boxes[pick]], True
                out.append((*key, last, success, *box, late))
            if held:
                timer = self.slot(min(held)[0]) * self.slot_ms
                if due:
                    self.keep(number, held)
                break
            self.waiting.removeKey((number,))
            if len(out) >= ROWS:
                yield self.reported(out)
                out = []
        if timer < NEVER:
            self.handle.registerTimer(timer)
        self.target.update((passed, last, *box, late, timer))
        if out:
            yield self.reported(out)

    @staticmethod
    def reported(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["video_id", "track_id", "frame_idx", "success", *BOX, "late_dropped"])

    def close(self) -> None:
        pass


def track_stream(
    frames: DataFrame,
    init_boxes: DataFrame,
    algorithm: str = "iou",
    threshold: float = TRACK_IOU,
    max_distance: float = MAX_DISTANCE,
    time_col: str = "ts",
    delay: str = DELAY,
    slot_ms: int = SLOT_MS,
) -> DataFrame:
    """Follow each initial box through a stream of frames that come in any order within ``delay``.

    ``frames``: ``video_id, frame_idx, boxes ARRAY<STRUCT<det_id, x, y, w, h>>`` (NULL or empty
    when nothing was detected) and the event time ``time_col``, which rises with the frame. ``init_boxes``
    is a static table as for the batch tracker. A frame is reported once the watermark, the latest
    time seen less ``delay``, has passed it; a later frame of any video moves the watermark, also of
    one without an initial box. Frames behind what was passed are dropped: by
    Spark where they are behind the watermark of an earlier batch, else they count in ``late_dropped``.

    The session needs the RocksDB state store (:func:`use_rocksdb`).
    """
    check_algorithm(algorithm)
    if "track_id" not in init_boxes.columns:
        init_boxes = init_boxes.withColumn("track_id", F.lit(0).cast("bigint"))
    first = init_boxes.select(
        "video_id", "track_id", F.col("frame_idx").alias("first_frame"), *[F.col(c).cast("double").alias(f"i_{c}") for c in BOX]
    )
    # boxes in the order of their ids, as plain numbers
    by_id = F.sort_array(F.coalesce("boxes", F.array().cast(frames.schema["boxes"].dataType)))
    numbers = F.flatten(F.transform(by_id, lambda d: F.array(*[d[c].cast("double") for c in BOX])))
    timed = frames.select("video_id", "frame_idx", numbers.alias("boxes"), F.col(time_col).alias("ts")).withWatermark("ts", delay)
    rows = timed.join(first, "video_id").filter(F.col("frame_idx") > F.col("first_frame"))
    rows = rows.select("*", F.unix_millis("ts").alias("at"))
    video_type, track_type = (rows.schema[c].dataType.simpleString() for c in ("video_id", "track_id"))
    output = (
        f"video_id {video_type}, track_id {track_type}, frame_idx bigint, success boolean, "
        "x double, y double, w double, h double, late_dropped bigint"
    )
    return rows.groupBy("video_id", "track_id").transformWithStateInPandas(
        FollowTarget(algorithm, threshold, max_distance, slot_ms), output, "append", "EventTime"
    )
