"""Training-run logs: early stopping and checkpoint retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rinkspark.functions.chunks import CHUNK, chunk_of, with_earlier_chunks

PATIENCE = 3
MAX_TO_KEEP = 5


def early_stop(run_log: DataFrame, patience: int = PATIENCE, chunk: int = CHUNK) -> DataFrame:
    """Where each run would stop: the first step with ``patience`` rows in a row that set no new minimum.

    Only a strictly lower ``val_loss`` is an improvement; NULL and NaN never are. ``stop_step``
    is NULL for a run that never stops; ``best_step`` is the last improvement up to the stop.
    Rows are counted, so steps may have gaps; a step occurs once per run. Rows without a step come last.
    """
    loss = F.col("val_loss")
    usable = F.when(~F.isnan(loss), loss)
    log = run_log.select("run_id", "step", usable.alias("loss"), chunk_of(F.col("step"), chunk).alias("chunk"))
    log = with_earlier_chunks(
        log, ["run_id"], "chunk", {"min_before": (F.min("loss"), F.min), "rows_before": (F.count("*"), F.sum)}
    )
    inside = Window.partitionBy("run_id", "chunk").orderBy(F.col("step").asc_nulls_last())
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    best_so_far = F.coalesce(F.least(F.col("min_before"), F.min("loss").over(earlier)), F.lit(float("inf")))
    log = log.withColumns(
        {
            "pos": F.coalesce("rows_before", F.lit(0)) + F.row_number().over(inside),
            "improves": F.coalesce(F.col("loss") < best_so_far, F.lit(False)),
        }
    )
    mark = F.when(F.col("improves"), F.struct("pos", "step"))
    log = log.withColumn("mark", mark)
    log = with_earlier_chunks(log, ["run_id"], "chunk", {"mark_before": (F.max("mark"), F.max)})
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    log = log.withColumn("last_mark", F.coalesce(F.max("mark").over(so_far), F.col("mark_before")))
    waited = F.col("pos") - F.coalesce(F.col("last_mark.pos"), F.lit(0))
    log = log.withColumn("stops", waited >= patience)
    # the wait restarts only at an improvement: the first stopping row carries the mark in force
    first_stop = F.min(F.when(F.col("stops"), F.struct(F.col("step"), F.col("last_mark.step").alias("best"))))
    out = log.groupBy("run_id").agg(first_stop.alias("stop"), F.max("last_mark").alias("final"))
    never = F.col("stop").isNull()
    return out.select(
        "run_id",
        F.when(never, F.col("final.step")).otherwise(F.col("stop.best")).alias("best_step"),
        F.col("stop.step").alias("stop_step"),
    )


def keep_latest(checkpoints: DataFrame, max_to_keep: int = MAX_TO_KEEP) -> DataFrame:
    """The newest ``max_to_keep`` checkpoints of each run."""
    w = Window.partitionBy("run_id").orderBy(F.col("step").desc())
    return checkpoints.withColumn("age_rank", F.row_number().over(w)).filter(F.col("age_rank") <= max_to_keep)


def latest(checkpoints: DataFrame) -> DataFrame:
    """The newest checkpoint of each run."""
    return checkpoints.groupBy("run_id").agg(
        F.max("step").alias("step"), F.max_by("path", "step").alias("path")
    )
