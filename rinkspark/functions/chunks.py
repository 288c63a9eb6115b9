"""Running values over long ordered groups without one task per group.

A window over ``partitionBy(key).orderBy(pos)`` puts a whole key into one task. Here the
key is cut into chunks along ``pos``: each chunk is summarised (partial aggregation), the
short table of summaries is scanned once per key, and every row receives the value of all
*earlier chunks*. The caller finishes with a window over ``(key, chunk)``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rinkspark.functions.joins import null_safe_join

CHUNK = 4096


def chunk_of(pos: Column, size: int = CHUNK) -> Column:
    return F.floor(pos / F.lit(size)).cast("bigint")


def with_earlier_chunks(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    values: dict[str, tuple[Column, Callable[[Column], Column]]],
    descending: bool = False,
    nulls_first: bool = False,
) -> DataFrame:
    """Add one column per entry of ``values``: its aggregate over the earlier chunks.

    ``values`` maps a new column to (aggregate of one chunk, function that merges those
    aggregates). The column is NULL in the first chunk of a key. ``descending`` counts the
    chunks with larger numbers as the earlier ones. A NULL key is a key of its own, a NULL
    chunk the last one of its key, or the first with ``nulls_first``.
    """
    summary = df.groupBy(*keys, chunk).agg(*[one.alias(name) for name, (one, _) in values.items()])
    place = F.col(chunk)
    if descending:
        order = place.desc_nulls_first() if nulls_first else place.desc_nulls_last()
    else:
        order = place.asc_nulls_first() if nulls_first else place.asc_nulls_last()
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *keys, chunk, *[merge(F.col(name)).over(earlier).alias(name) for name, (_, merge) in values.items()]
    )
    return null_safe_join(df, carried, [*keys, chunk])
