"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkspark.llm.common import drop_staged, release, staged

#: Links of a task at least: a short table is read in one task, whose rounds shuffle nothing, however many files it lies in.
TASK_LINKS = 1 << 16


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) for every node of ``links`` (``a, b``: longs, either order).

    Rounds are logarithmic in the longest chain. Each is joins and aggregations on node ids; a node
    with very many links has one partial minimum per task and its join is one that can be split.
    Links with a NULL end are ignored; repeated links, both directions and loops are fine.
    """
    ordered = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = staged(ordered, "components-links"), None
    while True:
        size = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if size == before:
            break
        before, tasks = size, max(1, size[0] // TASK_LINKS)
        both = edges.union(edges.select(F.col("b"), F.col("a")).toDF("a", "b")).coalesce(tasks)
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        written = staged(large, "components-links")
        large = written.coalesce(tasks)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        after = staged(small.union(least).coalesce(tasks).distinct(), "components-links")
        drop_staged(edges)
        drop_staged(written)
        edges = after
        del both, least, large, small, after
        release(links.sparkSession)  # of the round's shuffles
    # Every remaining link now points from a node to the least node of its component.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b"), F.col("b")).distinct().toDF("node", "component")
    )
