"""A training loop on Spark: mini-batch gradients, a run log, early stop, kept checkpoints, restart.

The model is a softmax classifier on feature vectors. A step reads one batch of rows; each task sums the
gradient of its rows, and these sums, as long as the model and no longer, are added up by a shuffle.
Everything that an epoch leaves is written under one path: its weights, and its row of the run log. A
run that stopped goes on from its latest checkpoint, and ends as it would have ended.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkspark.operators.runs import MAX_TO_KEEP, PATIENCE, early_stop, keep_latest, latest

# Number of training passes and learning rate.
EPOCHS, RATE = 100, 0.001
LOG, CHECKPOINTS = "run_id string, step long, val_loss double", "run_id string, step long, path string"


def _logits(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = x @ weights[:, :-1].T + weights[:, -1]
    return z - z.max(axis=1, keepdims=True)


def gradient_sums(rows: DataFrame, weights: np.ndarray, backward: bool = True) -> tuple[np.ndarray, float, int]:
    """Sums over ``rows`` (``x`` array, ``y`` class): gradient in the shape of ``weights`` (classes, features + 1), loss, rows."""
    classes, width = weights.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, n = np.zeros_like(weights), 0.0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, width - 1)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            z = _logits(x, weights)
            p = np.exp(z)
            mass = p.sum(axis=1)
            loss += float((np.log(mass) - z[np.arange(len(y)), y]).sum())
            n += len(y)
            if backward:
                p /= mass[:, None]
                p[np.arange(len(y)), y] -= 1
                total[:, :-1] += p.T @ x
                total[:, -1] += p.sum(axis=0)
        values = np.concatenate([[loss, n], total.ravel()]) if n else np.zeros(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values, pa.float64())], ["slot", "value"])

    sums = rows.select("x", "y").mapInArrow(add, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value"))
    out = np.zeros(2 + weights.size)
    for slot, value in sums.collect():  # as many as the model has weights
        out[slot] = value
    return out[2:].reshape(weights.shape), float(out[0]), int(out[1])


class Run:
    """What a training run has left under ``path``: ``log`` and ``checkpoints``, one file each per epoch."""

    def __init__(self, spark: SparkSession, path: str, run_id: str):
        self.spark, self.path, self.run_id = spark, path.rstrip("/"), run_id

    def _table(self, name: str, schema: str) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.path}/{name}")

    def log(self) -> DataFrame:
        return self._table("log", LOG)

    def checkpoints(self) -> DataFrame:
        return self._table("checkpoints", f"{CHECKPOINTS}, weights string").drop("weights")

    def save(self, step: int, weights: np.ndarray, val_loss: float | None, keep: int) -> None:
        """The log first: an epoch counts once its weights are there, and is run again if they are not."""
        row = self.spark.createDataFrame([(self.run_id, step, val_loss)], LOG).coalesce(1)
        row.write.mode("overwrite").parquet(f"{self.path}/log/{step}")
        at = f"{self.path}/checkpoints/{step}"
        row = self.spark.createDataFrame([(self.run_id, step, at, json.dumps(weights.tolist()))], f"{CHECKPOINTS}, weights string")
        row.coalesce(1).write.mode("overwrite").parquet(at)
        if step <= keep:
            return
        found = self.checkpoints()
        for old in found.join(keep_latest(found, keep), "step", "left_anti").collect():  # one, or none
            gone = self.spark._jvm.org.apache.hadoop.fs.Path(old.path)
            gone.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(gone, True)

    def restore(self) -> tuple[int, np.ndarray] | None:
        """Step and weights of the latest checkpoint, if there is one."""
        newest = latest(self.checkpoints()).first()
        if newest is None:
            return None
        weights = self.spark.read.parquet(newest.path).first().weights
        return newest.step, np.array(json.loads(weights))


def train(
    rows: DataFrame,
    path: str,
    classes: int,
    features_col: str = "embedding",
    label_col: str = "label",
    id_col: str = "vec_id",
    epochs: int = EPOCHS,
    batches: int = 4,
    rate: float = RATE,
    patience: int = PATIENCE,
    keep: int = MAX_TO_KEEP,
    held_out: Column | None = None,
    batch_of: Column | None = None,
    run_id: str = "run",
) -> DataFrame:
    """Train a softmax classifier and return its run log: ``run_id, step, val_loss``, one row per epoch.

    Rows are dealt to ``batches`` by a hash of their id, one in ten is held out for ``val_loss``; ``batch_of`` and
    ``held_out`` decide otherwise. Weights start at zero, so the run depends on its rows alone. Training ends
    after ``epochs``, or when ``patience`` epochs in a row brought no lower loss. The ``keep`` newest
    checkpoints stay. Called again with the path of a run that was cut short, it goes on after the last epoch
    that is complete; a finished run returns its log. Rows without features or label take no part.
    """
    spark = rows.sparkSession
    run = Run(spark, path, run_id)
    key = F.xxhash64(id_col)
    marked = rows.filter(F.col(features_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(features_col).cast("array<double>").alias("x"),
        F.col(label_col).cast("long").alias("y"),
        F.coalesce(F.pmod(key, F.lit(10)) == 9 if held_out is None else held_out, F.lit(False)).alias("held_out"),
        (F.pmod(F.floor(key / 10), F.lit(batches)) if batch_of is None else batch_of).alias("batch"),
    )
    first = marked.select(F.size("x").alias("n")).first()
    if first is None:
        return run.log()
    step, weights = run.restore() or (0, np.zeros((classes, first.n + 1)))
    while step < epochs:
        if step >= patience:  # fewer epochs cannot have waited as long
            stopped = early_stop(run.log().filter(F.col("step") <= step), patience).first()
            if stopped is not None and stopped.stop_step is not None:
                break
        step += 1
        for b in range(batches):
            gradient, _, n = gradient_sums(marked.filter(~F.col("held_out") & (F.col("batch") == b)), weights)
            if n:
                weights = weights - rate * gradient / n
        _, loss, n = gradient_sums(marked.filter("held_out"), weights, backward=False)
        run.save(step, weights, loss / n if n else None, keep)
    return run.log().filter(F.col("step") <= step)


def predictor(weights: np.ndarray):
    """The classifier as a callable for :func:`rinkspark.operators.models.score`."""

    def make():
        return lambda batch: _logits(batch.astype(np.float64), weights).argmax(axis=1).astype(np.float64)

    return make


def evaluate_latest(rows: DataFrame, path: str, features_col: str = "embedding", label_col: str = "label", run_id: str = "run") -> DataFrame:
    """The latest checkpoint of a run on labelled rows: ``step, n, loss, accuracy``."""
    restored = Run(rows.sparkSession, path, run_id).restore()
    if restored is None:
        raise ValueError(f"no checkpoint under {path}")
    step, weights = restored
    known = rows.filter(F.col(features_col).isNotNull() & F.col(label_col).isNotNull())
    x = F.transform(features_col, lambda v: v.cast("double"))
    scores = [
        F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in w[:-1]]), lambda a, b: a * b), F.lit(float(w[-1])), lambda acc, v: acc + v)
        for w in weights
    ]
    scored = known.select(F.col(label_col).cast("int").alias("y"), F.array(*scores).alias("z"))
    scored = scored.withColumn("top", F.array_max("z"))
    mass = F.aggregate(F.transform("z", lambda v: F.exp(v - F.col("top"))), F.lit(0.0), lambda acc, v: acc + v)
    own = F.element_at("z", F.col("y") + 1)
    return scored.agg(
        F.lit(step).cast("long").alias("step"), F.count("*").alias("n"), F.avg(F.log(mass) + F.col("top") - own).alias("loss"),
        F.avg((own == F.col("top")).cast("double")).alias("accuracy"),
    )
