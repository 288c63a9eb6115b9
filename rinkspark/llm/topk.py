"""Exact top-k by inner product: a KD-tree per shard, searched best first.

Shards hold a bounded number of vectors. A tree halves its rows at the median of the widest
dimension and keeps the tight box of each node. The best a box can offer a query is the sum over
dimensions of the larger product with its two faces; nodes are taken in that order until none can
reach the kth score so far. Every query first searches the shard it lives in; the kth score found
there goes along to all other shards. Queries meet shards in blocks, both of bounded size.
"""

from __future__ import annotations

import heapq
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rinkspark.llm.common import staged
from rinkspark.llm.vectors import usable_vectors

SHARD, BLOCK, LEAF = 16_384, 2048, 128
#: Components are kept within this size, as exact as doubles are. Scores are ranked exactly whatever their size.
LARGEST = 2**53
#: What a long holds.
LONGEST = 2**63 - 1


class Tree:
    def __init__(self, rows: np.ndarray, ids: np.ndarray) -> None:
        self.rows, self.ids = rows, ids
        self.low, self.high, self.child, self.members = [], [], [], []
        self.add(np.arange(len(rows)))

    def add(self, own: np.ndarray) -> int:
        at, part = len(self.child), self.rows[own]
        low, high = part.min(axis=0), part.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.child.append(None)
        self.members.append(own)
        if len(own) > LEAF:
            by = np.argpartition(part[:, int((high - low).argmax())], len(own) // 2)
            self.child[at] = self.add(own[by[: len(own) // 2]]), self.add(own[by[len(own) // 2 :]])
            self.members[at] = None
        return at

    def bound(self, node: int, query: np.ndarray) -> float:
        return np.maximum(query * self.low[node], query * self.high[node]).sum()

    def search(self, query: np.ndarray, own: int, k: int, floor: float) -> list[tuple[int, int]]:
        """The ``k`` best (-score, id) that reach ``floor``; equal scores: smaller ids first."""
        best: list[tuple[int, int]] = []
        heap = [(-self.bound(0, query), 0)]
        while heap and -heap[0][0] >= floor:
            _, node = heapq.heappop(heap)
            if self.child[node]:
                for c in self.child[node]:
                    b = self.bound(c, query)
                    if b >= floor:
                        heapq.heappush(heap, (-b, c))
                continue
            rows = self.members[node]
            scores = self.rows[rows] @ query
            near = np.flatnonzero((scores >= floor) & (self.ids[rows] != own))
            if len(near):
                best = sorted(best + [(-int(scores[i]), int(self.ids[rows[i]])) for i in near])[:k]
                if len(best) == k:
                    floor = max(floor, -best[-1][0])
        return best


def exact(rows: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles or longs where their products surely stay exact, else as integers of any size."""
    largest = int(np.abs(rows).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(rows.shape[1], 1)
    kind = float if largest < 2**52 else np.int64 if largest < 2**62 else object
    return rows.astype(kind), queries.astype(kind)


def search_group(k: int):
    def search(shard: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(shard) and len(asked):
            rows, queries = exact(*(np.stack(c.to_list()).astype(np.int64) for c in (shard["vec"], asked["vec"])))
            tree = Tree(rows, shard["id"].to_numpy(np.int64))
            for own, query, floor in zip(asked["id"].tolist(), queries, asked["floor"].tolist()):
                found += [(own, i, Decimal(-s)) for s, i in tree.search(query, own, k, -np.inf if floor is None else int(floor))]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64"})

    return search


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest inner products of ``floor(scale * x)`` components.

    Queries: rows whose id is divisible by ``every``; candidates: all rows with another id and as
    many components. Ties go to the smaller id. Vectors that are NULL, empty or hold a NULL or
    non-finite component, and rows with a NULL id, take no part; components beyond +-2**53 count as
    that, and so do scores beyond a long. A repeated row is a candidate each time, and one query. No usable vector: no rows.
    Runs jobs when called (sizes decide the number of shards and blocks).
    """
    most = float(LARGEST)
    whole = F.transform("vec", lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(x * F.lit(float(scale))).cast("double"))).cast("long"))
    rows = usable_vectors(vectors.filter(F.col(id_col).isNotNull()), id_col, vec_col).select(F.col("id").cast("long"), whole.alias("vec"))
    n, asked = rows.agg(F.count("*"), F.sum(F.when(F.col("id") % every == 0, 1).otherwise(0))).first()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-(asked or 0) // BLOCK))
    place = F.xxhash64("id")
    rows = staged(
        rows.select("id", "vec", F.size("vec").alias("dim"), F.pmod(place, F.lit(shards)).cast("int").alias("shard"), F.pmod(F.shiftright(place, 20), F.lit(blocks)).cast("int").alias("block")),
        "topk-rows",
    )
    asked_rows = rows.filter(F.col("id") % every == 0).dropDuplicates(["id", "vec"])
    queries = asked_rows.select(*[F.col(c).alias(c) for c in asked_rows.columns])  # columns of their own for the cogroup
    schema, keys = "query_id bigint, vec_id bigint, score decimal(38,0)", ["dim", "shard", "block"]

    def met(data: DataFrame, wanted: DataFrame) -> DataFrame:
        return data.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInPandas(search_group(k), schema)

    spread = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    first = met(spread, queries.withColumn("floor", F.lit(None).cast("decimal(38,0)")))
    kth = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    kth = staged(kth.select(F.col("query_id").alias("id"), F.when(F.col("n") == k, F.col("least")).alias("floor")), "topk-kth")
    everywhere = queries.join(kth, "id", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = met(spread, everywhere)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    score = F.greatest(F.lit(str(-LONGEST - 1)).cast("decimal(38,0)"), F.least(F.lit(str(LONGEST)).cast("decimal(38,0)"), F.col("score"))).cast("long")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))
