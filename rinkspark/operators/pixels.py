"""Jobs on decoded pixels: channel order, tensors, augmentation, drawing, decode audit.

Images are the struct of Spark's ``image`` source: BGR bytes, row-major. Pixel work runs in
scalar Arrow functions that receive only the image fields they use; all other columns stay
in the JVM. Frames are wide (a 1080p frame is about 6 MB): ``session.DEFAULTS`` bounds an Arrow
batch by bytes. Grey images are expanded to three channels and alpha is dropped, as image readers
for three-channel work do; rows that could not be decoded pass unchanged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinkspark.functions.draws import uniform_draws
from rinkspark.operators.detections import FRAME

# Augmentation ranges and the colour and thickness of a track's rectangle.
ROTATE_DEGREES = (-25.0, 25.0)
SCALE_RANGE = (0.5, 1.5)
FLIP_SHARE = 0.5
TRACK_COLOUR_BGR = (255, 0, 0)
THICKNESS = 2
#: Binary digits of sine and cosine in a rotation.
TURN_BITS = 16


def pixels_of(data: bytes | pa.Buffer | None, height: int, width: int) -> np.ndarray | None:
    """Three channels of an image with one, three or four; None if it was not decoded."""
    if data is None or not height > 0 or not width > 0:
        return None
    flat = np.frombuffer(data, dtype=np.uint8)
    channels, rest = divmod(flat.size, int(height) * int(width))
    if rest or channels not in (1, 3, 4):
        raise ValueError(f"{flat.size} bytes cannot be a {height}x{width} image of 1, 3 or 4 channels")
    img = flat.reshape(int(height), int(width), channels)
    return np.repeat(img, 3, axis=2) if channels == 1 else img[..., :3]


def _image_fields() -> list[Column]:
    return [F.col("image.data"), F.col("image.height"), F.col("image.width")]


def _with_pixels(frames: DataFrame, data: Column, **fields: Column) -> DataFrame:
    """Three-channel ``data`` (NULL: not decoded) in the image of each frame, and any other ``fields``."""
    decoded = frames.withColumn("_data", data)
    image, ok = F.col("image"), F.col("_data").isNotNull()
    # fixed values: the number of channels, and the code for eight-bit images with three of them
    for field, value in {"data": F.col("_data"), "nChannels": F.lit(3), "mode": F.lit(16), **fields}.items():
        if field in frames.schema["image"].dataType.names:
            image = image.withField(field, F.when(ok, value).otherwise(F.col(f"image.{field}")))
    return decoded.withColumn("image", F.when(F.col("image").isNotNull(), image)).drop("_data")


@F.pandas_udf(T.BinaryType())
def _swapped(data: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    images = [pixels_of(d, h, w) for d, h, w in zip(data, height, width)]
    return pd.Series([None if img is None else img[..., ::-1].tobytes() for img in images])


def swap_channels(frames: DataFrame) -> DataFrame:
    """BGR to RGB or back."""
    return _with_pixels(frames, _swapped(*_image_fields()))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _flat_floats(data: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    images = [pixels_of(d, h, w) for d, h, w in zip(data, height, width)]
    return pd.Series([None if img is None else img.astype(np.float32).ravel() for img in images])


def image_tensor(frames: DataFrame, column: str = "tensor") -> DataFrame:
    """Add the pixels as a flat float array (height, width, channel order) for batched scoring; NULL if not decoded."""
    return frames.withColumn(column, _flat_floats(*_image_fields()))


def aug_params(frames: DataFrame, seed: int) -> DataFrame:
    """Add ``angle``, ``scale`` and ``flip`` of each frame, a function of frame key and seed only."""
    a, s, f = uniform_draws(3, seed, F.col("video_id"), F.col("frame_idx"))
    return frames.withColumns(
        {
            "angle": a * (ROTATE_DEGREES[1] - ROTATE_DEGREES[0]) + ROTATE_DEGREES[0],
            "scale": s * (SCALE_RANGE[1] - SCALE_RANGE[0]) + SCALE_RANGE[0],
            "flip": f < FLIP_SHARE,
        }
    )


_NEW_IMAGE = T.StructType(
    [
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("data", T.BinaryType()),
    ]
)


def rotate_nearest(img: np.ndarray, degrees: float) -> np.ndarray:
    """Rotation about the centre, same size, nearest neighbour, black where nothing maps.

    Sine and cosine are rounded to whole numbers of 1 / 2**TURN_BITS; from there on all is integer arithmetic,
    so that another engine can repeat the map to the pixel.
    """
    height, width = img.shape[:2]
    one = 1 << TURN_BITS
    cos, sin = (int(np.floor(f(np.deg2rad(degrees)) * one + 0.5)) for f in (np.cos, np.sin))
    ys, xs = np.mgrid[0:height, 0:width]
    ys, xs = 2 * ys - (height - 1), 2 * xs - (width - 1)  # twice the offset from the centre
    sx = (cos * xs - sin * ys + width * one) >> (TURN_BITS + 1)
    sy = (sin * xs + cos * ys + height * one) >> (TURN_BITS + 1)
    inside = (sx >= 0) & (sx < width) & (sy >= 0) & (sy < height)
    out = np.zeros_like(img)
    out[inside] = img[sy[inside], sx[inside]]
    return out


def resize_nearest(img: np.ndarray, scale: float) -> np.ndarray:
    """The pixel under the centre of each new one, in integer arithmetic."""
    height, width = img.shape[:2]
    new_h, new_w = (max(1, int(np.floor(n * scale + 0.5))) for n in (height, width))
    rows = (2 * np.arange(new_h) + 1) * height // (2 * new_h)
    cols = (2 * np.arange(new_w) + 1) * width // (2 * new_w)
    return img[rows][:, cols]


@F.pandas_udf(_NEW_IMAGE)
def _augmented(
    data: pd.Series, height: pd.Series, width: pd.Series, angle: pd.Series, scale: pd.Series, flip: pd.Series
) -> pd.DataFrame:
    out = []
    for d, h, w, a, s, f in zip(data, height, width, angle, scale, flip):
        img = pixels_of(d, h, w)
        if img is None:
            out.append((None, None, None))
            continue
        img = resize_nearest(rotate_nearest(img, a), s)
        if f:
            img = img[:, ::-1]
        out.append((img.shape[0], img.shape[1], img.tobytes()))
    made = pd.DataFrame(out, columns=["height", "width", "data"])
    return made.astype({"height": "Int32", "width": "Int32"})


def apply_augmentation(frames: DataFrame) -> DataFrame:
    """Rotate, resize, flip each image by its own ``angle``, ``scale`` and ``flip`` columns."""
    new = _augmented(*_image_fields(), F.col("angle"), F.col("scale"), F.col("flip"))
    with_new = frames.withColumn("_new", new)
    return _with_pixels(with_new, F.col("_new.data"), height=F.col("_new.height"), width=F.col("_new.width")).drop("_new")


def augment(frames: DataFrame, seed: int) -> DataFrame:
    """One augmented image per input frame; the original is not copied."""
    return apply_augmentation(aug_params(frames, seed)).drop("angle", "scale", "flip")


def _draw_border(img: np.ndarray, x1: int, y1: int, x2: int, y2: int, colour: tuple, thickness: int) -> None:
    height, width = img.shape[:2]
    before, after = thickness // 2, thickness - thickness // 2

    def span(lo: int, hi: int, limit: int) -> slice:
        return slice(min(max(lo, 0), limit), min(max(hi, 0), limit))

    rows, cols = span(y1 - before, y2 + after, height), span(x1 - before, x2 + after, width)
    for y in (y1, y2):
        img[span(y - before, y + after, height), cols] = colour
    for x in (x1, x2):
        img[rows, span(x - before, x + after, width)] = colour


def draw_boxes(
    frames: DataFrame,
    boxes: DataFrame,
    colour: tuple[int, int, int] = TRACK_COLOUR_BGR,
    thickness: int = THICKNESS,
    gathered: dict[str, Column] | None = None,
) -> DataFrame:
    """Draw box borders onto a copy of each frame; frames without boxes pass unchanged.

    ``boxes`` has ``video_id, frame_idx, x, y, w, h``; a row without ``x`` draws nothing. ``gathered`` are aggregates
    of the rows of a frame that come along as columns, so that pixels are joined once. Equal rectangles are drawn once, and
    the corners reach a frame as one array: give it overlay rows, which are capped per frame.
    Frames from a table that :func:`rinkspark.sources.frames.write_frame_table` wrote stay where they
    are: only the corners are shuffled, to the frames' buckets, and are hashed there.
    """
    corner = F.struct(
        F.col("x").cast("int").alias("x1"),
        F.col("y").cast("int").alias("y1"),
        (F.col("x") + F.col("w")).cast("int").alias("x2"),
        (F.col("y") + F.col("h")).cast("int").alias("y2"),
    )
    corners = F.collect_set(F.when(F.col("x").isNotNull(), corner)).alias("corners")
    per_frame = boxes.groupBy(*FRAME).agg(corners, *[c.alias(name) for name, c in (gathered or {}).items()])

    @F.pandas_udf(T.BinaryType())
    def drawn(data: pd.Series, height: pd.Series, width: pd.Series, todo: pd.Series) -> pd.Series:
        out = []
        for d, h, w, rects in zip(data, height, width, todo):
            img = pixels_of(d, h, w)
            if img is None:
                out.append(None)
                continue
            if rects is not None and len(rects):
                img = img.copy()
                for r in rects:
                    _draw_border(img, r["x1"], r["y1"], r["x2"], r["y2"], colour, thickness)
            out.append(img.tobytes())
        return pd.Series(out)

    # hashed, not merged: merging would sort the pixels
    joined = frames.join(per_frame.hint("shuffle_hash"), list(FRAME), "left")
    new = F.when(F.size("corners") > 0, drawn(*_image_fields(), F.col("corners")))
    return _with_pixels(joined, new).drop("corners")


def decode_audit(images: DataFrame) -> DataFrame:
    """Images read and images that could not be decoded (the source gives them height -1)."""
    bad = F.col("image.height") < 0
    return images.agg(F.count_if(~bad).alias("loaded"), F.count_if(bad).alias("skipped"))
