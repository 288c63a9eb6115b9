"""Near-duplicate vectors by collision-counting projections.

Unit vectors are projected on many random lines. Lines are used in tables: the cells of all but one
line of a table make its key, the last line is sorted, and vectors with the same key within a window
of each other collide. A pair's collisions are counted over all tables; pairs that reach a count
calibrated for the wanted recall at the limit are verified by cosine. How many lines make a key, and
how many tables there are, follows from the number of vectors: chance collisions per vector stay
about constant, and the recall at the limit is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkspark.llm.common import shuffle_partitions, staged
from rinkspark.llm.components import components
from rinkspark.llm.vectors import matrices, usable_vectors

SEED, WIDTH, RECALL = 11, 2.75, 0.96
#: Larger groups of one key meet block by block.
BLOCK = 1024
#: Rows gathered before pairs are formed.
GATHER = 20_000


def same_cell(gap: float) -> float:
    """Chance that two points whose projections differ by a normal of deviation ``gap`` share a random cell."""
    t = WIDTH / gap
    return 1 - 2 * (0.5 - 0.5 * erf(t / sqrt(2))) - 2 / (sqrt(2 * pi) * t) * (1 - exp(-t * t / 2))


def in_window(gap: float) -> float:
    return erf(WIDTH / 2 / gap / sqrt(2))


def calibrated(n: int, least: float) -> tuple[int, int, int]:
    """Lines per table, tables, and the count of collisions to reach."""
    near, far = sqrt(2 - 2 * least), sqrt(2.0)
    lines = max(2, ceil(log(max(n, 2)) / -log(same_cell(far))))
    hit = same_cell(near) ** (lines - 1) * in_window(near)
    tables = max(4, ceil(log(1 - RECALL) / log(1 - hit)))
    count, missed = 1, (1 - hit) ** tables
    while missed + comb(tables, count) * hit**count * (1 - hit) ** (tables - count) <= 1 - RECALL:
        missed += comb(tables, count) * hit**count * (1 - hit) ** (tables - count)
        count += 1
    return lines, tables, count


def keyed(reps: DataFrame, lines: int, tables: int) -> DataFrame:
    """Adds the unit vector, and the keys and positions of all tables, as arrays and packed."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            out: list[list] = [[None] * n for _ in range(3)]
            for rows, matrix in matrices(batch.column(2)):
                unit = matrix / np.abs(matrix).max(axis=1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                draw = np.random.default_rng([SEED, matrix.shape[1]])
                line = draw.standard_normal((matrix.shape[1], tables * lines))
                shift = draw.random(tables * lines) * WIDTH
                place = (unit @ line).reshape(len(rows), tables, lines)
                cell = np.floor((place + shift.reshape(tables, lines)) / WIDTH).astype(np.int64)[:, :, :-1].view(np.uint64)
                factor = draw.integers(1, 2**63, lines - 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
                key = (cell * factor).sum(axis=2) + np.uint64(matrix.shape[1])
                key = (key >> np.uint64(32) ^ key).astype(np.uint32).view(np.int32)
                last = place[:, :, -1].astype(np.float32)
                for i, r in enumerate(rows):
                    out[0][r], out[1][r], out[2][r] = unit[i].tobytes(), key[i].tobytes() + last[i].tobytes(), last[i].tolist()
            cells = [np.frombuffer(m, np.int32)[:tables].tolist() for m in out[1]]
            columns = [pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(cells, pa.list_(pa.int32())), pa.array(out[2], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "copies", "unit", "marks", "cells", "places"])

    kind = reps.schema["id"].dataType.simpleString()
    return reps.select("id", "copies", "vec").mapInArrow(
        project, f"id {kind}, copies bigint, unit binary, marks binary, cells array<int>, places array<float>"
    )


def labelled(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each row reaches over the links ``a - b``."""
    label = ids.copy()
    while len(a):
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        if (after == label).all():
            break
        label = after
    return label


def linked(met: DataFrame, least: float, count: int) -> DataFrame:
    """Per row of a group: copies linked to it here, and the smallest id it reaches here."""
    names = ["t", "cell", "low", "high", "place", "mine", "id", "copies", "unit", "marks"]

    def settle(batch: pa.Table) -> pa.RecordBatch:
        t, cell, low, high, place, mine, ids, copies = (batch.column(k).to_numpy() for k in range(8))
        n = len(t)
        group = np.concatenate([[0], np.cumsum((np.diff(t) != 0) | (np.diff(cell) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0))]) if n else np.zeros(0, int)
        units = [np.frombuffer(u) for u in batch.column(8).to_pylist()]
        marks = np.frombuffer(b"".join(batch.column(9).to_pylist()), np.int32).reshape(n, 2, -1) if n else np.zeros((0, 2, 1), np.int32)
        keys, places = marks[:, 0], marks[:, 1].view(np.float32)
        size = np.array([len(u) for u in units])
        unit = np.zeros((n, size.max(initial=0)))
        for k, u in enumerate(units):
            unit[k, : len(u)] = u
        ends_a, ends_b = [], []
        step, first = 1, np.arange(max(n - 1, 0))
        while len(first):  # the window after each row, one step further at a time
            first = first[first + step < n]
            other = first + step
            alive = (group[first] == group[other]) & (place[other] - place[first] <= np.float32(WIDTH / 2))
            first, other = first[alive], other[alive]
            apart = ((low[first] == high[first]) | (mine[first] != mine[other])) & (size[first] == size[other])
            a, b = first[apart], other[apart]
            for at in range(0, len(a), 50_000):
                x, y = a[at : at + 50_000], b[at : at + 50_000]
                near = np.einsum("ij,ij->i", unit[x], unit[y]) >= least
                x, y = x[near], y[near]
                shared = (keys[x] == keys[y]) & (np.abs(places[y] - places[x]) <= np.float32(WIDTH / 2))
                # A pair that collides in several tables is taken in the first of them.
                taken = (shared.sum(axis=1) >= count) & (shared.argmax(axis=1) == t[x])
                ends_a.append(x[taken])
                ends_b.append(y[taken])
            step += 1
        a, b = (np.concatenate(e) if e else np.zeros(0, np.int64) for e in (ends_a, ends_b))
        total = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
        label = labelled(n, a, b, ids)
        out = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(total[out].astype(np.int64)), pa.array(label[out])], ["id", "n", "least"])

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < GATHER:
                continue
            whole = pa.Table.from_batches(held)
            keys = [whole.column(k).to_numpy() for k in range(4)]
            last = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on
            if cut:
                yield settle(whole.slice(0, cut))
            held = whole.slice(cut).combine_chunks().to_batches()
            rows = whole.num_rows - cut
        if rows:
            yield settle(pa.Table.from_batches(held))

    return met.select(*names).mapInArrow(paired, "id bigint, n bigint, least bigint")


def near_vectors(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector: ``id_col, n_links, component_id, kept``.

    Two vectors are linked if they collide often enough and their cosine is at least ``least``; at
    that limit ``RECALL`` of the pairs collide so, nearly all of closer ones. NULL, empty and zero
    vectors and those with a NULL or non-finite component link with nothing; so do vectors of
    different lengths. Equal vectors are linked with each other and enter the search once. Ids are
    longs; rows with a NULL id get no links. An empty table gives no rows. Runs jobs when called.
    """
    good = usable_vectors(vectors.filter(F.col(id_col).isNotNull()), id_col, vec_col).filter(F.exists("vec", lambda x: x != 0))
    good = good.select(F.col("id").cast("long"), "vec")
    members = staged(good.groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).select("rep", "copies", "vec"), "vectors-distinct")
    reps = members.select(F.col("rep").alias("id"), "copies", "vec")
    lines, tables, count = calibrated(reps.count(), least)
    rows = staged(keyed(reps, lines, tables), "vectors-keyed")
    cells = rows.select("id", F.posexplode(F.arrays_zip("cells", "places")).alias("t", "c")).select("id", "t", F.col("c.cells").alias("cell"), F.col("c.places").alias("place"))
    crowd = cells.groupBy("t", "cell").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    many = cells.join(crowd, ["t", "cell"]).withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.select("id", "t", "cell", "place", "mine", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
    met = many.join(rows.select("id", "copies", "unit", "marks"), "id")
    met = met.repartition(shuffle_partitions(met.sparkSession), "t", "cell", "low", "high").sortWithinPartitions("t", "cell", "low", "high", "place")
    found = staged(linked(met, least, count), "vectors-links")
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    parts = components(found.filter("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")))
    member = reps.drop("vec").join(links, "id", "left").join(parts.withColumnRenamed("node", "id"), "id", "left")
    member = member.select(F.col("id").alias("rep"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("component"))
    placed = good.join(members.select("rep", "vec"), "vec").join(member, "rep").select("id", "n", "component")
    # A repeated id has the links of its own vector; rows are matched by number among equal ids only.
    every = vectors.select(F.col(id_col).alias("id"))
    placed = placed.groupBy("id").agg(F.max("n").alias("n"), F.min("component").alias("component"))
    joined = every.join(placed, "id", "left")
    component = F.coalesce("component", F.col("id").cast("long"))
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )
