"""SimHash fingerprints, and near duplicates among them by the generalised pigeonhole principle.

If two fingerprints differ in at most ``t`` bits and the 64 bits are cut into parts with thresholds
``t_1 .. t_m``, ``sum(t_i + 1) = t + 1``, then some part differs in at most ``t_i`` bits. Correlated
bits share a part, so that skew is gathered in few parts. Each distinct fingerprint chooses its own
thresholds by a dynamic program over estimated candidate counts (-1: the part is not probed), probes
all values within them, and candidates are verified on the whole 64 bits. A part value that a third
of all fingerprints share is thus avoided by those that have it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkspark.llm.common import shared_value, slices, staged, text_of, words
from rinkspark.llm.components import components

BITS, SEED = 64, 42
#: Shingles hashed at a time, and fingerprints probed at a time.
HASHES, PROBED = 200_000, 2048
#: Counters per part in the estimate of candidate counts: its size does not depend on the input.
SLOT_BITS = 16


def shingles(found: list[bytes], width: int) -> list[bytes] | map:
    if not found:
        return []
    if len(found) < width:
        return [b" ".join(found)]
    return map(b" ".join, zip(*[found[k:] for k in range(width)]))


def fingerprints_of(texts: list[str], width: int) -> np.ndarray:
    """A bit is 1 if it is set in over half of the shingles' hashes; no words: 0."""
    ones, totals = np.zeros((len(texts), BITS), np.int64), np.zeros(len(texts), np.int64)
    held: list[np.ndarray] = []
    owners: list[int] = []

    def settle() -> None:
        if held:
            sizes = [len(h) for h in held]
            bits = np.unpackbits(np.concatenate(held).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            np.add.at(ones, owners, np.add.reduceat(bits, np.cumsum([0, *sizes[:-1]]), axis=0, dtype=np.int32))
            held.clear()
            owners.clear()

    pending = 0
    for k, text in enumerate(texts):
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles(words(text), width), repeat(SEED)), np.uint64)
        totals[k] = len(hashes)
        for part in slices(len(hashes), HASHES):
            held.append(hashes[part])
            owners.append(k)
            pending += part.stop - part.start
            if pending >= HASHES:
                settle()
                pending = 0
    settle()
    on = np.packbits(2 * ones > totals[:, None], axis=1, bitorder="little")
    return on.view("<u8").ravel()


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints_of(batch.column(1).to_pylist(), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(hashed, f"id {kind}, fp bigint")


def correlated_parts(distinct: DataFrame, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups; each bit joins the group it is most correlated with that has room."""

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS + 1, BITS + 1))
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8)
            for part in slices(len(fp), 1 << 16):
                bits = np.unpackbits(fp[part], axis=1, bitorder="little").astype(np.float32)
                bits = np.hstack([bits, np.ones((len(bits), 1), np.float32)])
                total += bits.T @ bits
        cells = np.arange(total.size, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel().astype(np.int64))], ["cell", "n"])

    counted = distinct.select("fp").mapInArrow(together, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    total = np.zeros((BITS + 1) ** 2)
    for cell, n in counted.collect():  # 65 * 65 rows
        total[cell] = n
    total = total.reshape(BITS + 1, BITS + 1)
    n = max(total[-1, -1], 1)
    mean = total[-1, :-1] / n
    covariance = total[:-1, :-1] / n - np.outer(mean, mean)
    deviation = np.sqrt(np.maximum(np.diag(covariance), 1e-12))
    likeness = np.abs(covariance / np.outer(deviation, deviation))
    np.fill_diagonal(likeness, 0)
    room, groups, free = -(-BITS // parts), [], set(range(BITS))
    while free:
        group = [max(sorted(free), key=lambda b: likeness[b, sorted(free)].sum())]
        free -= set(group)
        while free and len(group) < room:
            nearest = max(sorted(free), key=lambda b: likeness[b, group].sum())
            group.append(nearest)
            free.discard(nearest)
        groups.append(group)
    return groups


def gathered(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits of one part, side by side."""
    value = np.zeros(len(fp), np.uint64)
    for place, bit in enumerate(bits):
        value |= (fp >> np.uint64(bit) & np.uint64(1)) << np.uint64(place)
    return value


def slot(value: np.ndarray) -> np.ndarray:
    return (value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)


def balls(size: int, most: int) -> list[np.ndarray]:
    """For each radius, the masks with exactly that many bits."""
    return [np.array([sum(1 << b for b in c) for c in combinations(range(size), r)], np.uint64) for r in range(most + 1)]


def allocate(cost: np.ndarray, most: int) -> np.ndarray:
    """Thresholds per row and part with the least total cost; ``cost[row, part, t + 1]``, t from -1 to ``most``."""
    rows, parts, _ = cost.shape
    best = np.full((rows, most + 2), np.inf)
    best[:, 0] = 0
    chosen = []
    for p in range(parts):
        options = np.full((rows, most + 2, most + 2), np.inf)  # [row, spent after, spent here]
        for spent in range(most + 2):
            options[:, spent:, spent] = best[:, : most + 2 - spent] + cost[:, p, spent][:, None]
        chosen.append(options.argmin(axis=2))
        best = options.min(axis=2)
    left, out = np.full(rows, most + 1), np.zeros((rows, parts), np.int64)
    for p in reversed(range(parts)):
        spent = chosen[p][np.arange(rows), left]
        out[:, p] = spent - 1
        left = left - spent
    return out


def links_within(distinct: DataFrame, most: int, parts: int = 3) -> DataFrame:
    """Pairs ``a < b`` of the distinct ``fp`` that differ in at most ``most`` bits, each once."""
    spark = distinct.sparkSession
    groups = correlated_parts(distinct, parts)
    parts = len(groups)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            key = [gathered(fp.view(np.uint64), g).astype(np.int64) << 2 | p for p, g in enumerate(groups)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key)), pa.array(np.tile(fp, parts))], ["key", "fp"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, 1 << SLOT_BITS), np.int64)
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for p, g in enumerate(groups):
                total[p] += np.bincount(slot(gathered(fp, g)).astype(np.int64), minlength=1 << SLOT_BITS)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel()[cells])], ["cell", "n"])

    estimate = np.zeros((parts, 1 << SLOT_BITS), np.int64)
    found = distinct.select("fp").mapInArrow(counted, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    estimate.ravel()[found["cell"].to_numpy()] = found["n"].to_numpy()  # parts * 65536 counters at most
    shared = shared_value(spark, estimate)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        estimate, masks = shared.value, [balls(len(g), most) for g in groups]
        for batch in batches:
            whole = batch.column(0).to_numpy()
            for part in slices(len(whole), PROBED):
                fp = whole[part]
                values = [gathered(fp.view(np.uint64), g) for g in groups]
                cost = np.zeros((len(fp), parts, most + 2))
                for p, value in enumerate(values):
                    for r, mask in enumerate(masks[p]):
                        near = estimate[p][slot(value[:, None] ^ mask)].sum(axis=1) if len(mask) else 0
                        cost[:, p, r + 1] = cost[:, p, r] + near + len(mask)
                keys, owners = [], []
                limits = allocate(cost, most)
                for p, value in enumerate(values):
                    for r, mask in enumerate(masks[p]):
                        rows = np.flatnonzero(limits[:, p] >= r)
                        keys.append(((value[rows, None] ^ mask).astype(np.int64) << 2 | p).ravel())
                        owners.append(np.repeat(fp[rows], len(mask)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))], ["key", "probe"])

    index = distinct.select("fp").mapInArrow(keyed, "key bigint, fp bigint")
    probed = distinct.select("fp").mapInArrow(probes, "key bigint, probe bigint")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("probe"))) <= most
    pairs = probed.join(index, "key").filter(near & (F.col("fp") != F.col("probe")))
    return pairs.select(F.least("fp", "probe").alias("a"), F.greatest("fp", "probe").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most: int = 2
) -> DataFrame:
    """One row per document: ``id_col, fingerprint, component_id``.

    ``fingerprint`` is 16 lower-case hex digits; documents whose fingerprints differ in at most
    ``most`` bits are linked; ``component_id`` is the smallest id reachable (NULL if all are NULL).
    NULL and empty texts have fingerprint 0 and link like any other. Equal fingerprints are one
    node of the links, however many documents have them. An empty table gives no rows. Other
    columns are not read. Runs jobs when called; fingerprints and links are staged tables.
    """
    printed = staged(fingerprints(docs, id_col, text_col, width), "simhash")
    distinct = staged(printed.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    found = components(links_within(distinct, most))
    member = distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    member = staged(member, "simhash-members")
    smallest = member.groupBy("component").agg(F.min("least").alias("component_id"))
    member = member.join(smallest, "component").select("fp", "component_id")
    return printed.join(member, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
