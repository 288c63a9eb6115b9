"""A table in one order across all its partitions, with dense row numbers: no key is ever held by one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinkspark.llm.common import staged

#: ``monotonically_increasing_id`` keeps the partition above these bits and the place in it below.
PLACE_BITS = 33


def in_order(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df``, written in the order of ``order``, with its row number from 0 in the column ``name``.

    Rows are dealt by ranges of ``order``: a key with most of the rows spreads over many ranges, so
    ``order`` should end in a column that differs from row to row. Range bounds are sampled; only the
    columns of ``order`` reach the driver, so keep them short. Only counts by partition come back.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    written = staged(ranged.withColumn("_place", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_place", PLACE_BITS)
    counts = sorted(written.groupBy(part.alias("_part")).count().collect())
    offsets, total = [], 0
    for which, count in counts:
        offsets.append((which, total - (which << PLACE_BITS)))
        total += count
    shift = df.sparkSession.createDataFrame(offsets, "_part long, _shift long")
    numbered = written.withColumn("_part", part).join(shift, "_part")
    found = numbered.select(*df.columns, (F.col("_place") + F.col("_shift")).alias(name))
    found.rows = total
    return found
