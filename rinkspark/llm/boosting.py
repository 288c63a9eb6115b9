"""Gradient-boosted trees for a binary label, on binned features, small enough to travel to every task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkspark.llm.common import staged

BINS = 32
#: Trees between two writings of the margins; sums of gradients are whole multiples of 1 / ``UNIT``, equal on any layout.
WRITTEN, UNIT = 8, 1 << 20
#: Rows of a task at least: each sends a sum per cell that it meets, so that what is sent follows the rows, not the files they lie in.
TASK_ROWS = 1 << 16


class Boosted:
    """Logistic loss; every tree is complete, of ``depth`` levels, one (feature, cut) per node."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.3, least: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.least = trees, depth, rate, least
        self.cuts: np.ndarray = np.zeros((0, 0))
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(self.cuts)], axis=1).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
        b, (rows, width) = self.binned(x), x.shape
        share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
        self.start = float(np.log(share / (1 - share)))
        margin = np.full(rows, self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            pull, weight = y - p, p * (1 - p)
            at = np.zeros(rows, np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, BINS)
            for level in range(self.depth):
                first, n = 2**level - 1, 2**level
                local = at - first
                best = np.zeros(n)
                for k in range(width):
                    cell = local * BINS + b[:, k]
                    g = np.bincount(cell, pull, n * BINS).reshape(n, BINS).cumsum(axis=1)
                    h = np.bincount(cell, weight, n * BINS).reshape(n, BINS).cumsum(axis=1)
                    right_g, right_h = g[:, -1:] - g, h[:, -1:] - h
                    gain = g**2 / (h + 1) + right_g**2 / (right_h + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                    gain[(h < self.least) | (right_h < self.least)] = 0
                    top = gain.argmax(axis=1)
                    value = gain[np.arange(n), top]
                    better = value > best + 1e-9
                    best[better] = value[better]
                    feature[first : first + n][better], cut[first : first + n][better] = k, top[better]
                at = 2 * at + 1 + (b[np.arange(rows), feature[at]] > cut[at])
            leaf = at - (2**self.depth - 1)
            g, h = np.bincount(leaf, pull, 2**self.depth), np.bincount(leaf, weight, 2**self.depth)
            value = self.rate * g / (h + 1)
            self.nodes.append((feature, cut, value))
            margin += value[leaf]
        return self

    def walked(self, b: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row of bins after ``levels`` levels of one tree."""
        at = np.zeros(len(b), np.int64)
        for _ in range(levels):
            at = 2 * at + 1 + (b[np.arange(len(b)), feature[at]] > cut[at])
        return at

    def fit_spread(self, counted: DataFrame, cuts: np.ndarray) -> Boosted:
        """The same trees from a table of any size: ``bins`` (a byte per feature), ``n`` rows like it, ``pos`` of them positive.

        Each level is one job that sums gradients by node, feature and bin; only those sums, of fixed number, are collected.
        """
        self.cuts, width = cuts, len(cuts)
        n, pos, rows = counted.agg(F.sum("n"), F.sum("pos"), F.count("*")).first()
        tasks = max(1, rows // TASK_ROWS)
        share = float(np.clip(pos / n, 1e-4, 1 - 1e-4))
        self.start = float(np.log(share / (1 - share)))
        table, since = counted.select("bins", "n", "pos", F.lit(self.start).alias("margin")).coalesce(tasks), 0

        def margins(batch: pa.RecordBatch, trees: list) -> tuple[np.ndarray, np.ndarray]:
            b = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, width).astype(np.int64)
            margin = batch.column(3).to_numpy().copy()
            for feature, cut, value in trees:
                margin += value[self.walked(b, feature, cut, self.depth) - (2**self.depth - 1)]
            return b, margin

        def rewritten(trees: list) -> DataFrame:
            def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(margins(batch, trees)[1])], batch.schema.names)

            return staged(table.mapInArrow(found, table.schema), "boosting-margins").coalesce(tasks)

        def sums(trees: list, feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
            nodes = 2**level

            def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros((2, width, nodes * BINS))
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    b, margin = margins(batch, trees)
                    p, n = 1 / (1 + np.exp(-margin)), batch.column(1).to_numpy()
                    parts = [np.rint(v * UNIT) for v in (batch.column(2).to_numpy() - n * p, n * p * (1 - p))]
                    local = self.walked(b, feature, cut, level) - (nodes - 1)
                    for k in range(width):
                        for which, part in enumerate(parts):
                            total[which, k] += np.bincount(local * BINS + b[:, k], part, nodes * BINS)
                cells = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel()[cells].astype(np.int64))], ["cell", "s"])

            out = np.zeros(2 * width * nodes * BINS)
            for cell, s in table.mapInArrow(found, "cell bigint, s bigint").groupBy("cell").agg(F.sum("s").alias("s")).collect():
                out[cell] = s / UNIT
            return out.reshape(2, width, nodes, BINS)

        for done in range(self.trees):
            if since == WRITTEN:
                table, since = rewritten(self.nodes[done - since :]), 0
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, BINS)
            for level in range(self.depth):
                first, nodes = 2**level - 1, 2**level
                left = sums(self.nodes[done - since :], feature, cut, level).cumsum(axis=3)
                whole = left[:, :, :, -1:]
                (g, h), (right_g, right_h) = left, whole - left
                gain = g**2 / (h + 1) + right_g**2 / (right_h + 1) - whole[0] ** 2 / (whole[1] + 1)
                gain[(h < self.least) | (right_h < self.least)] = 0
                gain = gain.transpose(1, 0, 2).reshape(nodes, -1)
                top = gain.argmax(axis=1)
                better = gain[np.arange(nodes), top] > 1e-9
                feature[first : first + nodes] = np.where(better, top // BINS, 0)
                cut[first : first + nodes] = np.where(better, top % BINS, BINS)
            # The leaves' sums lie in the last level's.
            at = np.arange(nodes)
            low = left[:, feature[first:], at, np.minimum(cut[first:], BINS - 1)]
            leaf = np.stack([low, whole[:, 0, :, 0] - low], axis=2).reshape(2, -1)
            self.nodes.append((feature, cut, self.rate * leaf[0] / (leaf[1] + 1)))
            since += 1
        return self

    def judged(self, b: np.ndarray) -> np.ndarray:
        """Probability of each row of bins."""
        margin = np.full(len(b), self.start)
        for feature, cut, value in self.nodes:
            margin += value[self.walked(b, feature, cut, self.depth) - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-margin))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.judged(self.binned(x))
