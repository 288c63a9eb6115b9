"""Batched scoring with any model, and fitting and keeping a Spark ML model."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinkspark.operators.pixels import pixels_of

# Batch size and number of training passes.
BATCH_SIZE = 32
EPOCHS = 100


def score(
    df: DataFrame,
    make_predict_fn: Callable,
    input_col: str,
    input_shape: list[int],
    return_type: T.DataType,
    output_col: str = "prediction",
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Add the prediction of a model for an array column, one numpy batch at a time.

    ``make_predict_fn()`` loads the model and returns a function of a batch; it runs once
    per Python worker, not per row.
    """
    predict = predict_batch_udf(
        make_predict_fn, return_type=return_type, batch_size=batch_size, input_tensor_shapes=[input_shape]
    )
    return df.withColumn(output_col, predict(F.col(input_col)))


#: Decoded pixels that a model is given at a time, whatever the frames' size.
BATCH_BYTES = 256 << 20
RAW_NAMES = ("num_detections", "detection_boxes", "detection_classes", "detection_scores")
RAW = "num_detections float, detection_boxes array<array<float>>, detection_classes array<float>, detection_scores array<float>"
_LOADED: dict[str, Callable] = {}


def _model(key: str, make_predict_fn: Callable) -> Callable:
    """The model of one plan, loaded when a Python worker first needs it."""
    if key not in _LOADED:
        _LOADED[key] = make_predict_fn()
    return _LOADED[key]


def _batches(images: list, batch_size: int) -> Iterator[list[int]]:
    """Places of images of one size, at most ``batch_size`` and BATCH_BYTES of them at a time; None is left out."""
    by_size: dict[tuple, list[int]] = {}
    for k, img in enumerate(images):
        if img is not None:
            by_size.setdefault(img.shape, []).append(k)
    for shape, places in by_size.items():
        step = max(1, min(batch_size, BATCH_BYTES // max(1, int(np.prod(shape)))))
        yield from (places[k : k + step] for k in range(0, len(places), step))


def detect(frames: DataFrame, make_predict_fn: Callable, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Run a detector over BGR frames: raw, padded detections per frame, and its ``height`` and ``width``.

    The model sees an RGB batch (n, height, width, 3) of bytes and returns a dict of ``num_detections`` (n,),
    ``detection_boxes`` (n, pad, 4) or flattened, ``detection_classes`` (n, pad) and ``detection_scores`` (n, pad).
    It is loaded once per Python worker. Frames of several sizes may be mixed; a batch holds one size. Pixels are
    decoded and scored in one pass and leave no column. Frames that were not decoded have no detections.
    """
    key = uuid.uuid4().hex
    keep = [f for f in frames.schema.fields if f.name != "image"]
    narrow = frames.select(*[f.name for f in keep], "image.data", F.col("image.height").alias("_h"), F.col("image.width").alias("_w"))
    floats = pa.list_(pa.float32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _model(key, make_predict_fn)
        for batch in batches:
            data, heights, widths = batch.columns[len(keep) :]
            images = [pixels_of(d.as_buffer() if d.is_valid else None, h or -1, w or -1) for d, h, w in zip(data, heights.to_pylist(), widths.to_pylist())]
            found: list[tuple] = [(0.0, [], [], [])] * len(images)
            for places in _batches(images, batch_size):
                out = predict(np.stack([images[k][..., ::-1] for k in places]))
                boxes = np.asarray(out["detection_boxes"], dtype=np.float32).reshape(len(places), -1, 4)
                classes, scores = (np.asarray(out[c], dtype=np.float32).reshape(len(places), -1) for c in ("detection_classes", "detection_scores"))
                for row, k in enumerate(places):
                    found[k] = (float(out["num_detections"][row]), boxes[row].tolist(), classes[row].tolist(), scores[row].tolist())
            columns = [pa.array([f[c] for f in found], kind) for c, kind in enumerate((pa.float32(), pa.list_(floats), floats, floats))]
            names = [*[f.name for f in keep], *RAW_NAMES, "height", "width"]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns, heights, widths], names)

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    return narrow.mapInArrow(run, f"{kept}{RAW}, height int, width int")


def as_features(df: DataFrame, array_col: str, features_col: str = "features") -> DataFrame:
    return df.withColumn(features_col, array_to_vector(F.col(array_col)))


def fit_classifier(
    features: DataFrame, label: str = "label", features_col: str = "features", max_iter: int = EPOCHS
) -> PipelineModel:
    """Logistic regression on frame feature vectors (see :func:`as_features`)."""
    stage = LogisticRegression(featuresCol=features_col, labelCol=label, maxIter=max_iter)
    return Pipeline(stages=[stage]).fit(features)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
