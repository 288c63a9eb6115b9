"""Small tables, small pictures, and plain-Python versions of the sequential rules."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np

DET = "video_id long, frame_idx long, class_id int, det_id long, x double, y double, w double, h double, score double"
TRUTH = "video_id long, frame_idx long, class_id int, gt_id long, x double, y double, w double, h double"
POINTS = "video_id long, frame_idx long, det_id long, x double, y double, w double, h double"
INIT = "video_id long, track_id long, frame_idx long, x double, y double, w double, h double"


def rows(df, *columns):
    df = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in df.collect()), key=repr)


def png(pixels_rgb: np.ndarray) -> bytes:
    height, width, _ = pixels_rgb.shape
    raw = b"".join(b"\0" + pixels_rgb[y].astype(np.uint8).tobytes() for y in range(height))

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def picture(seed: int, height: int, width: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 256, (height, width, 3), dtype=np.uint8)


def image_rows(spark, pictures):
    """(video_id, frame_idx, image) rows from BGR arrays."""
    data = [
        (0, i, ("", p.shape[0], p.shape[1], 3, 16, bytearray(p.tobytes()))) for i, p in enumerate(pictures)
    ]
    schema = (
        "video_id long, frame_idx long, "
        "image struct<origin string, height int, width int, nChannels int, mode int, data binary>"
    )
    return spark.createDataFrame(data, schema)


def pixels_of(row) -> np.ndarray:
    return np.frombuffer(bytes(row.image.data), np.uint8).reshape(row.image.height, row.image.width, 3)


def iou(a, b) -> float:
    iw = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    ih = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    inter = max(iw, 0) * max(ih, 0)
    union = a[2] * a[3] + b[2] * b[3] - inter
    return inter / union if union > 0 else 0.0


def distance(a, b) -> float:
    return ((a[0] + a[2] / 2 - b[0] - b[2] / 2) ** 2 + (a[1] + a[3] / 2 - b[1] - b[3] / 2) ** 2) ** 0.5


def random_scene(seed: int, frames: int, most: int, spread: int = 600, classes: int = 2):
    """Detections and truth rows; boxes crowd so that they compete, and some are exact copies."""
    rng = random.Random(seed)
    det, truth = [], []
    for f in range(frames):
        real = [
            (rng.randint(-20, spread), rng.randint(-20, spread), rng.randint(20, 120), rng.randint(20, 120))
            for _ in range(rng.randint(0, most))
        ]
        for i, b in enumerate(real):
            truth.append((f % 3, f, rng.randint(1, classes), i, *map(float, b)))
            if rng.random() < 0.2:
                truth.append((f % 3, f, truth[-1][2], 1000 + i, *map(float, b)))
        for i in range(rng.randint(0, 2 * most)):
            b = rng.choice(real) if real and rng.random() < 0.8 else (5.0, 5.0, 50.0, 50.0)
            shift = rng.choice([0, 0, 5, 15, 40])
            box = (b[0] + shift, b[1] + rng.choice([0, 3]), b[2] * rng.choice([1, 1, 1.4]), b[3])
            det.append((f % 3, f, rng.randint(1, classes), i, *map(float, box), rng.choice([0.1, 0.4, 0.4, 0.7, 0.9, rng.random()])))
    return det, truth


def _by_group(items):
    groups = {}
    for r in items:
        groups.setdefault(r[:3], []).append(r)
    return groups


def voc_rule(det, truth, t):
    out = []
    wanted = _by_group(truth)
    for key, ds in _by_group(det).items():
        best = {}
        for d in ds:
            c = [(-iou(d[4:8], g[4:8]), g[3]) for g in wanted.get(key, [])]
            c = min((x for x in c if -x[0] >= t), default=None)
            if c:
                best[d[3]] = (c[1], -c[0])
        taken = set()
        for d in sorted(ds, key=lambda d: (-d[8], d[3])):
            gt, value = best.get(d[3], (None, None))
            tp = gt is not None and gt not in taken
            taken.add(gt)
            out.append((*key, d[3], d[8], gt, value, tp))
    return sorted(out, key=repr)


def coco_rule(det, truth, t):
    out = []
    wanted = _by_group(truth)
    for key, ds in _by_group(det).items():
        taken = set()
        for d in sorted(ds, key=lambda d: (-d[8], d[3])):
            c = [(-iou(d[4:8], g[4:8]), g[3]) for g in wanted.get(key, []) if g[3] not in taken]
            c = min((x for x in c if -x[0] >= t), default=None)
            if c:
                taken.add(c[1])
            out.append((*key, d[3], d[8], c and c[1], c and -c[0], c is not None))
    return sorted(out, key=repr)


def random_motion(seed: int, videos: int, frames: int, objects: int, miss: float = 0.3):
    """Objects that drift, vanish for short and long times and reappear, plus stray boxes and copies."""
    rng = random.Random(seed)
    det, listed = [], []
    for v in range(videos):
        next_id = 0
        spots = [[rng.randint(0, 900), rng.randint(0, 500)] for _ in range(objects)]
        gone = [0] * objects
        for f in range(frames):
            listed.append((v, f))
            for o, s in enumerate(spots):
                s[0] += rng.choice([-3, 0, 2, 4])
                s[1] += rng.choice([-2, 0, 2])
                if gone[o]:
                    gone[o] -= 1
                elif rng.random() < 0.03:
                    gone[o] = rng.randint(5, 60)
                elif rng.random() > miss:
                    for _ in range(rng.choice([1, 1, 1, 2])):
                        det.append((v, f, next_id, float(s[0]), float(s[1]), 60.0, 90.0))
                        next_id += 1
            if rng.random() < 0.3:
                det.append((v, f, next_id, float(rng.randint(0, 900)), float(rng.randint(0, 500)), 55.0, 95.0))
                next_id += 1
    return det, listed


def track_rule(det, init, listed, algorithm="iou", threshold=0.3, max_distance=50.0):
    by_frame = {}
    for d in det:
        by_frame.setdefault(d[:2], []).append(d)
    out = []
    for v, track, start, *box in init:
        for f in sorted(f for w, f in set(listed) if w == v and f > start):
            candidates = []
            for d in by_frame.get((v, f), []):
                if algorithm == "iou":
                    value = iou(box, d[3:])
                    if value >= threshold:
                        candidates.append((-value, d[2], d[3:]))
                else:
                    value = distance(box, d[3:])
                    if value <= max_distance:
                        candidates.append((value, d[2], d[3:]))
            if candidates:
                box = list(min(candidates)[2])
            out.append((v, track, f, bool(candidates), *box))
    return sorted(out, key=repr)
