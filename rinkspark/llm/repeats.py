"""Removing repeated passages by sorted suffixes, over documents of any number and size.

A byte goes if a string of ``length`` bytes that covers it also starts earlier. Sorting every suffix of
the corpus would take several times its size on disk, so suffixes are sorted where the text itself
says (minimizers), and all others are induced from those:

1. Every ``length``-byte string picks its smallest 8-gram, so equal strings pick the same place:
   about one byte in 46 is picked. The 54 bytes after a pick, and those before it, are its cores:
   each string that picks a place contains one of the two.
2. Picks whose core occurs once are done. The others become suffix tuples: the core as a second key,
   body (the bytes beyond it), tail (the bytes on the other side of the pick), place.
3. Tuples are sorted by core and body. Spark's external sort spills sorted runs and merges them from
   a heap, so a shard may be far larger than memory. Neighbours give common-prefix lengths.
4. From the order at the pick, the strings that start 1, 2, ... bytes further into the tail are induced:
   two of them are equal if their tails agree so far and the common prefix covers what is left. The
   first of each class stays, the others are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkspark.llm.common import drop_staged, numbered, release, shuffle_partitions, staged, text_of

GRAM = 8
#: Bytes of text looked at in one piece, and tuples gathered before they are settled.
PIECE, GATHER = 4_000_000, 20_000
ODD = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
STIR = np.uint64(0xC2B2AE3D27D4EB4F)


def stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * STIR
    return x ^ x >> np.uint64(29)


def picks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places whose 8-gram is the leftmost smallest of some ``length``-byte strings inside a document.

    Also how far before the place the last and the first of those strings start.
    """
    n, span = len(data), length - GRAM + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 3
    gram = data.astype(np.uint64)
    for shift in (1, 2, 4):
        gram = gram[:-shift] | gram[shift:] << np.uint64(8 * shift)
    least = stirred(gram) & np.uint64(0xFFFFFFFF00000000) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    inside = np.zeros(n + 1, np.int32)  # strings that lie in one document
    long_ = ends - starts >= length
    np.add.at(inside, starts[long_], 1)
    np.add.at(inside, ends[long_] - length + 1, -1)
    begins = np.flatnonzero(inside.cumsum()[: len(least)])
    at, first, times = np.unique((least[begins] & np.uint64(0xFFFFFFFF)).astype(np.int64), return_index=True, return_counts=True)
    return at, at - begins[first + times - 1], at - begins[first]


def cores(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Keys of the ``size`` bytes from each place in ``at``."""
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), ODD)]), dtype=np.uint64)
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), INVERSE)]), dtype=np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
    return stirred((total[at + size] - total[at]) * back[at])


class Shape:
    """Lengths that follow from the repeat length, and the two directions of a pick.

    Forward, the pivot is the pick; backward, the end of its gram. Strings that start up to ``tail``
    bytes before the pick are told apart forward, the others backward; either way a string takes its
    first bytes from the tail's side, counted from the pivot.
    """

    def __init__(self, length: int) -> None:
        self.length = length
        self.tail = (length - GRAM) // 2
        self.core = length - self.tail  # what every string has on the body's side, at least

    def sides(self, at: np.ndarray, near: np.ndarray, far: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each direction: rows of ``at`` with strings there, where the core begins, least and most tail bytes."""
        rows = np.flatnonzero(near <= self.tail)
        yield 0, rows, at[rows], near[rows], np.minimum(far[rows], self.tail)
        rows = np.flatnonzero(far > self.tail)
        whole = self.length - GRAM
        yield 1, rows, at[rows] + GRAM - self.core, whole - far[rows], whole - np.maximum(near[rows], self.tail + 1)


def packed(at: np.ndarray, low: np.ndarray, high: np.ndarray, side: int) -> np.ndarray:
    return (at << 33 | low << 17 | high << 1 | side).astype(np.int64)


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place in the text, least and most tail bytes, and whether the direction is backward."""
    return place >> 33, place >> 17 & 0xFFFF, place >> 1 & 0xFFFF, (place & 1).astype(bool)


def covered(at: np.ndarray, back: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the strings that take ``low`` to ``high`` bytes from the tail."""
    pivot = at + GRAM * back
    return np.where(back, pivot + low - length, pivot - high), np.where(back, pivot + high, pivot - low + length)


def core_keys(core: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two keys of each core, 128 bits, so that equal keys mean equal cores."""
    out = []
    for base in (ODD, STIR):
        weight = np.cumprod(np.full(core.shape[1], base), dtype=np.uint64)
        total = np.zeros(len(core), np.uint64)
        for k in range(core.shape[1]):
            total += (core[:, k].astype(np.uint64) + np.uint64(1)) * weight[k]
        out.append(stirred(total))
    return out[0], out[1]


def pieces(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= PIECE:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def cored(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """``key, row, place, side`` of every pick; input ``row, text``."""
    shape = Shape(length)
    for batch in batches:
        texts, rows = batch.column(1).to_pylist(), batch.column(0).to_numpy()
        for low, high in pieces(texts):
            sizes = np.array([len(t) for t in texts[low:high]], np.int64)
            ends = np.cumsum(sizes)
            starts, data = ends - sizes, np.frombuffer(b"".join(texts[low:high]), np.uint8)
            at, near, far = picks(data, starts, ends, length)
            if not len(at):
                continue
            doc = np.searchsorted(ends, at, "right")
            for side, own, begin, least, most in shape.sides(at, near, far):
                key = cores(data, begin, shape.core) ^ np.uint64(side)
                place = packed((at - starts[doc])[own], least, most, side)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(rows[low:high][doc[own]]), pa.array(place)], ["key", "row", "place"])


def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``row, place`` where the key occurs more than once, from a stream sorted by ``key``; one row is carried over."""
    last: pa.RecordBatch | None = None
    seen = False  # whether the carried row's key came before it, too
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([last, batch] if last else [batch]).combine_chunks()
        key = table.column(0).to_numpy()
        same = key[1:] == key[:-1]
        keep = np.zeros(len(key), bool)
        keep[1:] |= same
        keep[:-1] |= same
        if last is not None:
            keep[0] |= seen
        seen = bool(keep[-1])
        out = table.slice(0, len(key) - 1).filter(pa.array(keep[:-1]))
        yield from out.select(["row", "place"]).to_batches()
        last = table.slice(len(key) - 1).combine_chunks().to_batches()[0]
    if last is not None and seen:
        yield last.select(["row", "place"])


def tuples(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Suffix tuples of picks; input ``row, id, text, places``."""
    shape = Shape(length)
    width, shipped = length + shape.tail, 8 + length - shape.core + shape.tail
    for batch in batches:
        rows, ids = batch.column(0), batch.column(1)
        texts, found = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for k, (text, marks) in enumerate(zip(texts, found)):
            data = np.frombuffer(text, np.uint8)
            padded = np.concatenate([np.zeros(width, np.uint8), data, np.zeros(width, np.uint8)])
            place = np.array(marks, np.int64)
            at, low, high, back = unpacked(place)
            pivot = at + GRAM * back
            step = np.where(back, -1, 1)[:, None]
            first = pivot - back  # backward: the byte before the pivot
            body = padded[width + first[:, None] + step * np.arange(length)]
            tail = padded[width + (first[:, None] - step) - step * np.arange(shape.tail)]
            # Bytes that no string of this pick takes are blanked: fewer contexts differ.
            body[np.arange(length) >= (length - low)[:, None]] = 0
            tail[np.arange(shape.tail) >= high[:, None]] = 0
            key, more = core_keys(body[:, : shape.core])
            key = (key ^ back).view(np.int64)
            context = np.hstack([more.view(np.uint8).reshape(-1, 8), body[:, shape.core :], tail])
            n = len(at)
            offsets = pa.py_buffer((np.arange(n + 1) * shipped).astype(np.int32).tobytes())
            binary = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(context.tobytes())])
            columns = [pa.array(key), binary, pa.array([ids[k]] * n, ids.type), pa.array([rows[k]] * n, rows.type), pa.array(place)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "context", "id", "row", "place"])


def first_of(group: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether each row is the least in ``order`` (a permutation's ranks) among the rows of its group."""
    least = np.full(int(group.max()) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, group, order)
    return least[group] == order


def renamed(names: np.ndarray) -> np.ndarray:
    return np.unique(names, return_inverse=True)[1]


def induced(table: pa.Table, length: int) -> pa.RecordBatch:
    """Repeats among whole groups of tuples sorted by key, context and place: byte ranges per row."""
    shape = Shape(length)
    n = table.num_rows
    key, row, place = (table.column(c).to_numpy() for c in ("key", "row", "place"))
    _, least, most, _ = unpacked(place)
    context = np.frombuffer(b"".join(table.column("context").to_pylist()), np.uint8).reshape(n, -1)
    split = 8 + length - shape.core
    core, body, tail = context[:, :8], context[:, 8:split], context[:, split:]
    ids = table.column("id").combine_chunks()
    missing = np.array(ids.is_null())  # a NULL id comes last
    rank_of_id = renamed(ids.fill_null(0).to_numpy())
    order = np.empty(n, np.int64)
    order[np.lexsort((place >> 33, row, rank_of_id, missing))] = np.arange(n)
    differs = body[1:] != body[:-1]
    common = shape.core + np.where(differs.any(axis=1), differs.argmax(axis=1), body.shape[1])
    same = (key[1:] == key[:-1]) & (core[1:] == core[:-1]).all(axis=1)
    common = np.concatenate([[0], np.where(same, common, -1)])
    common[0] = -1
    tails = renamed(np.cumsum(common < 0))  # so far: the group
    hit = np.zeros((n, shape.tail + 1), bool)
    for d in range(shape.tail + 1):
        if d:
            tails = renamed(tails.astype(np.int64) << 8 | tail[:, d - 1])
        bodies = np.cumsum(common < length - d)
        valid = np.flatnonzero((least <= d) & (d <= most))
        if len(valid):
            names = renamed(tails[valid].astype(np.int64) * (n + 1) + bodies[valid])
            hit[valid, d] = ~first_of(names, order[valid])
    # Runs of neighbouring starts become one range of bytes.
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    at, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    high -= 1
    pick, _, _, back = unpacked(place[at])
    start, end = covered(pick, back, low, high, length)
    return pa.RecordBatch.from_arrays([pa.array(row[at]), pa.array(start), pa.array(end)], ["row", "start", "end"])


def settled(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Groups of equal cores, whole, a bounded number of rows at a time; equal tuples after the first at once.

    Sorted by context and place, equal tuples follow each other: all strings of the later ones are
    repeats. Only different tuples of one core are held together.
    """
    names = ["key", "context", "id", "row", "place"]
    held: list[pa.Table] = []
    count = 0
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]).select(names)
        reach = (table.column("place").to_numpy() & ((1 << 33) - 1)).tolist()
        marks = list(zip(table.column("key").to_pylist(), table.column("context").to_pylist(), reach))
        again = np.array([m == p for m, p in zip(marks, [last, *marks[:-1]])])
        last = marks[-1]
        if again.any():
            place, row = (table.column(c).to_numpy()[again] for c in ("place", "row"))
            pick, least, most, back = unpacked(place)
            start, end = covered(pick, back, least, most, length)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(start), pa.array(end)], ["row", "start", "end"])
        held.append(table.filter(pa.array(~again)))
        count += held[-1].num_rows
        if count >= GATHER:
            whole = pa.concat_tables(held).combine_chunks()
            key = whole.column("key").to_numpy()
            other = np.flatnonzero(key != key[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield induced(whole.slice(0, cut), length)
            held, count = [whole.slice(cut)], whole.num_rows - cut
    if count:
        yield induced(pa.concat_tables(held).combine_chunks(), length)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut(batches: Iterator[pa.RecordBatch], keep_text: bool) -> Iterator[pa.RecordBatch]:
    """Per document what is removed and what stays; input ``id, text, ranges``."""
    for batch in batches:
        rows = []
        for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            gone = merged([(r["start"], r["end"]) for r in ranges or []])
            kept, at = [], 0
            for a, b in gone:
                kept.append(text[at:a])
                at = b
            kept = b"".join([*kept, text[at:]])
            rows.append((len(text), sum(b - a for a, b in gone), len(gone), hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per document: ``id_col, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, bytes).

    Strings are judged on the input, in UTF-8, and never cross documents; "earlier" is a smaller id,
    NULL last, or an earlier start. Rows with equal ids are told apart by their place in the table.
    NULL and empty texts have no bytes. A text shorter than ``length`` stays. An empty table gives no
    rows. Other columns are not read. Runs jobs when called. What is held at once is one piece of text,
    or the different contexts of one core.
    """
    spark = docs.sparkSession
    partitions = shuffle_partitions(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    plain = numbered(docs.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("text")), "row")
    keys = plain.select("row", "text").mapInArrow(lambda b: cored(b, length), "key bigint, row bigint, place bigint")
    twice = keys.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(repeated, "row bigint, place bigint")
    twice = staged(twice, "repeats-picks")
    del keys
    release(spark)
    of_row = twice.groupBy("row").agg(F.collect_list("place").alias("places"))  # of one document
    wanted = plain.join(of_row, "row").select("row", "id", "text", "places")
    suffixes = wanted.mapInArrow(
        lambda b: tuples(b, length), f"key bigint, context binary, id {kind}, row bigint, place bigint"
    )
    dealt = suffixes.repartition(partitions, "key").sortWithinPartitions("key", "context", F.col("id").asc_nulls_last(), "row", "place")
    ranges = staged(dealt.mapInArrow(lambda b: settled(b, length), "row bigint, start bigint, end bigint"), "repeats-ranges")
    drop_staged(twice)
    del suffixes, dealt, wanted, of_row
    release(spark)
    gone = ranges.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    out = plain.join(gone, "row", "left").select("id", "text", "ranges").mapInArrow(
        lambda b: cut(b, keep_text), f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    )
    out = out.withColumnRenamed("id", id_col)
    return out if keep_text else out.drop("kept")
