"""Packing token sequences by cutting stock: patterns over a length histogram, filled with ranked documents.

A document longer than a sequence gives whole sequences and one rest. Rests are sorted into classes
of ``grain`` tokens (rounded up), and their histogram, at most ``capacity / grain`` counts whatever
the input, goes to the driver. There a linear program chooses patterns (multisets of classes that
fit one sequence): a revised simplex over columns that a knapsack dynamic program prices. Pattern
counts are rounded down; what that leaves is packed first-fit decreasing, still on counts alone.
The n-th document of a class then finds its sequence in the list of patterns by binary search.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rinkspark.llm.bpe import bpe_of
from rinkspark.llm.common import shared_value, shuffle_partitions, staged, text_of

CAPACITY, GRAIN = 2048, 4
#: The linear program ends within this share of the bound "all tokens / capacity".
GAP = 1e-3
#: Columns taken from one pricing, and pivots per class at most (the columns found by then are used).
PRICED, PIVOTS = 60, 4


def knapsack(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """For each capacity the best value of any multiset of classes that fits, and the class taken there (-1: none)."""
    best, taken = np.zeros(room + 1), np.full(room + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(room + 1), "right")
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if n := fitting[c]:
            value = best[c - sizes[:n]] + values[:n]
            k = value.argmax()
            if value[k] > best[c]:
                best[c], taken[c] = value[k], k
    return best, taken


def unpacked(taken: np.ndarray, sizes: np.ndarray, room: int, first: int | None = None) -> np.ndarray:
    """Counts per class of the best multiset, or of the best one that holds class ``first``."""
    pattern, c = np.zeros(len(sizes)), room
    if first is not None:
        pattern[first], c = 1, room - sizes[first]
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            pattern[taken[c]] += 1
            c -= sizes[taken[c]]
    return pattern


def first_basis(sizes: np.ndarray, demand: np.ndarray, room: int) -> np.ndarray:
    """A feasible basis: full patterns, long pieces first, each used until it exhausts a class.

    The pattern that exhausts a class holds none exhausted before, so the columns are independent.
    """
    left, columns = demand.copy(), np.zeros((len(sizes), len(sizes)))
    active = np.arange(len(sizes))
    while len(active):
        own = sizes[active]
        spent = np.flatnonzero(left[active] <= 0)
        if len(spent):
            column, gone = np.zeros(len(own)), spent[0]
            column[gone] = room // own[gone]
        else:
            share = own / room
            column = unpacked(knapsack(share * (1 + 0.01 * share), own, room)[1], own, room)
            held = np.flatnonzero(column)
            times = left[active][held] / column[held]
            gone = held[times.argmin()]
            left[active] -= column * times.min()
            left[active[gone]] = 0
        columns[active, active[gone]] = column
        active = np.delete(active, gone)
    return columns


def patterns(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and their amounts, covering ``demand`` with nearly the fewest sequences of ``room``.

    A revised simplex. Pivots use up the priced columns before others are priced; the duals over the
    best value bound the optimum from below, and reaching that bound ends the search.
    """
    m = len(sizes)
    columns = first_basis(sizes, demand, room)
    inverse = np.linalg.inv(columns)
    least, pivots = float(sizes @ demand) / room, 0
    while float((inverse @ demand).sum()) > least * (1 + GAP) and pivots <= PIVOTS * m:
        duals = inverse.sum(axis=0)
        best, taken = knapsack(duals, sizes, room)
        least = max(least, float(duals @ demand) / max(best[room], 1))
        worth = best[room - sizes] + duals
        pool = [unpacked(taken, sizes, room, k) for k in np.argsort(-worth, kind="stable")[:PRICED] if worth[k] > 1 + 1e-9]
        if not pool:
            break
        pool = np.unique(pool, axis=0)
        while True:
            gain = pool @ inverse.sum(axis=0)
            k = int(gain.argmax())
            if gain[k] <= 1 + 1e-7:
                break
            amount, change = inverse @ demand, inverse @ pool[k]
            with np.errstate(divide="ignore", invalid="ignore"):
                out = int(np.where(change > 1e-9, np.maximum(amount, 0) / change, np.inf).argmin())
            columns[:, out] = pool[k]
            pivots += 1
            if pivots % 200 == 0:
                inverse = np.linalg.inv(columns)
            else:
                row = inverse[out] / change[out]
                inverse -= np.outer(change, row)
                inverse[out] = row
    return columns.astype(int), np.maximum(inverse @ demand, 0)


def plan(histogram: dict[int, int], room: int) -> tuple[np.ndarray, int]:
    """Intervals of ranks: rows (class, first rank, sequences, first sequence), and the number of sequences.

    Rank ``r`` of a class, in an interval that starts at ``a`` with ``x`` sequences from ``s`` on,
    goes to sequence ``s + (r - a) % x``.
    """
    if not histogram:
        return np.zeros((0, 4), np.int64), 0
    sizes = np.array(sorted(histogram))
    demand = np.array([histogram[s] for s in sizes], np.int64)
    columns, amount = patterns(sizes, demand.astype(float), room)
    used, intervals, sequences = np.zeros(len(sizes), np.int64), [], 0
    for column, count in zip(columns.T, np.floor(amount + 1e-6).astype(np.int64)):
        held = np.flatnonzero(column)
        if len(held):  # rounding errors, or a pattern with more copies than there are
            count = min(int(count), int(((demand - used)[held] // column[held]).min()))
        if count < 1 or not len(held):
            continue
        for k in held:
            intervals.append((sizes[k], used[k], count, sequences))
            used[k] += column[k] * count
        sequences += count
    free = np.zeros(0, np.int64)
    for k in range(len(sizes) - 1, -1, -1):  # the rest: first fit, long ones first, equal ones together
        left = int(demand[k] - used[k])
        while left:
            fits = np.flatnonzero(free >= sizes[k])
            if not len(fits):
                free = np.append(free, room)
                fits = np.array([len(free) - 1])
            into = int(fits[0])
            n = min(left, int(free[into] // sizes[k]))
            free[into] -= n * sizes[k]
            intervals.append((sizes[k], used[k], 1, sequences + into))
            for extra in range(1, n):
                intervals.append((sizes[k], used[k] + extra, 1, sequences + into))
            used[k] += n
            left -= n
    return np.array(sorted(intervals), np.int64), sequences + len(free)


def tokenized(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, capacity: int, grain: int, end_id: int, keep_ids: bool) -> DataFrame:
    """Per document: number of tokens, class of the rest, and the checksum (and ids) of each piece."""
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    end = end_id.to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(vocabulary)
        for batch in batches:
            n, crcs, kept = [], [], []
            for ids in bpe.ids_of(batch.column(1).to_pylist()):
                ids += end
                n.append(len(ids) // 4)
                parts = [ids[k : k + 4 * capacity] for k in range(0, len(ids), 4 * capacity)]
                crcs.append([zlib.crc32(p) for p in parts])
                kept.append(parts if keep_ids else None)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.list_(pa.binary()))], ["id", "n", "crcs", "pieces"])

    found = narrow.mapInArrow(encode, f"id {kind}, n bigint, crcs array<bigint>, pieces array<binary>")
    return found.select(
        F.monotonically_increasing_id().alias("row"),
        "*",
        F.ceil(F.col("n") % capacity / grain).cast("long").alias("class"),
        F.floor(F.col("n") / capacity).cast("long").alias("full"),
    )


def ranked(rows: DataFrame) -> DataFrame:
    """Adds ``part``, ``rank`` and ``full_before``: positions inside the row's part of the order (class, row).

    The order is dealt by ranges, so a class that holds a third of all rows fills many parts.
    """
    names = rows.columns
    dealt = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), "class", "row").sortWithinPartitions("class", "row")
    schema = StructType([*dealt.schema.fields]).add("part", "integer").add("rank", "long").add("full_before", "long")
    c, f = names.index("class"), names.index("full")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen, full = TaskContext.get().partitionId(), -1, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            classes, fulls = batch.column(c).to_numpy(), batch.column(f).to_numpy()
            first = np.flatnonzero(np.diff(classes, prepend=classes[0] - 1))
            began = np.repeat(first, np.diff(first, append=len(classes)))
            rank = np.arange(len(classes)) - began
            rank[classes == last] += seen
            last, seen = classes[-1], rank[-1] + 1
            before = full + np.cumsum(fulls) - fulls
            full = before[-1] + fulls[-1]
            more = [pa.array(np.full(len(rank), part, np.int32)), pa.array(rank, pa.int64()), pa.array(before, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*names, "part", "rank", "full_before"])

    return dealt.mapInArrow(number, schema)


def pack(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    grain: int = GRAIN,
    end_id: int = 1,
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``).

    Tokens are the ids of the vocabulary's library and ``end_id``. Pieces of a sequence lie gapless
    from offset 0; sequence ids count from 0. Only documents over ``capacity`` tokens are cut, at
    its multiples. A NULL or empty text is the end id alone. Rows with equal or NULL ids are packed
    as documents of their own; an empty table gives no rows. Other columns are not read. Runs jobs
    when called: the tokenized lengths and the ranks are staged tables.
    """
    spark = docs.sparkSession
    rows = staged(tokenized(docs, vocabulary, id_col, text_col, capacity, grain, end_id, keep_ids), "packing-lengths")
    order = staged(ranked(rows), "packing-ranks")
    # Ranges are contiguous: parts + classes rows at most, whatever the number of documents.
    counts = order.groupBy("part", "class").agg(F.count("*").alias("n"), F.sum("full").alias("full")).collect()
    base, full_base, seen, fulls = {}, {}, {}, 0
    for part, k, n, full in sorted(map(tuple, counts)):
        base[part, k] = seen.get(k, 0)
        seen[k] = base[part, k] + n
        full_base.setdefault(part, fulls)
        fulls += full
    seen.pop(0, None)  # class 0: no rest
    intervals, sequences = plan(seen, capacity // grain)
    shared = shared_value(spark, (base, full_base, intervals, sequences))
    names = ["part", "class", "rank", "full_before"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, full_base, intervals, sequences = shared.value
        key = intervals[:, 0] << 40 | intervals[:, 1]
        for batch in batches:
            part, k, rank, before = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in names)
            starts = np.array([base[p, c] for p, c in zip(part.tolist(), k.tolist())], np.int64)
            rest = np.full(len(part), -1, np.int64)
            has = k > 0
            if has.any():
                at = np.searchsorted(key, k[has] << 40 | (rank[has] + starts[has]), "right") - 1
                _, first, count, sequence = intervals[at].T
                rest[has] = sequence + (rank[has] + starts[has] - first) % count
            whole = sequences + before + np.array([full_base[p] for p in part.tolist()], np.int64)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("row", "id", "n", "class", "crcs", "pieces")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(rest), pa.array(whole, pa.int64())], ["row", "id", "n", "class", "crcs", "pieces", "rest", "whole"]
            )

    kept = order.select("row", "id", "n", "class", "crcs", "pieces").schema.fields
    schema = StructType([*kept]).add("rest", "long").add("whole", "long")
    placed = order.mapInArrow(place, schema)
    pieces = placed.select("*", F.posexplode("crcs").alias("k", "crc")).select(
        "row",
        "id",
        "class",
        (F.col("k").cast("long") * capacity).alias("start"),
        F.least(F.lit(capacity), F.col("n") - F.col("k").cast("long") * capacity).cast("long").alias("length"),
        F.col("crc").alias("ids_crc32"),
        F.col("n").alias("doc_tokens"),
        (F.col("pieces")[F.col("k")] if keep_ids else F.lit(None).cast("binary")).alias("ids"),
        F.when((F.col("k") + 1) * capacity <= F.col("n"), F.col("whole") + F.col("k")).otherwise(F.col("rest")).alias("sequence_id"),
    )
    # A sequence holds at most `capacity` pieces.
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "row", "start").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long")
    out = pieces.withColumn("offset", offset)
    return out.select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else [])
    )
