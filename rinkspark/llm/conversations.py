"""Repair of conversation structure: faults, the cheapest edits to proper turns, and their audit.

The rows of a conversation are put in order by ranges, so a long one spreads over many tasks, and are
cut into segments. Each segment of a long conversation gives the cost of crossing it from state to
state; these are multiplied (min, +) along the conversation, so that every segment knows what follows
it. Then each segment alone ranks its optimal arcs by prefix doubling (``edits.paths``) and gives its
least audit and exit for every entry state; the exits, chained, tell the entries. Only digest and
audit of a conversation, one string each by definition, are made in one task, as a stream of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkspark.functions.joins import null_safe_join
from rinkspark.llm import edits
from rinkspark.llm.common import numbered, staged
from rinkspark.llm.ordering import in_order

#: Row numbers of a segment, and segments of a block, agree above these bits: 512 at most in each.
SEGMENT_BITS = 9
BLANKS = " \t\n\x0b\x0c\r"
ROLES = {edits.USER: "user", edits.ASSISTANT: "assistant"}


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text`` with one row in five dropped, emptied, cut, repeated, or given to the user, by a CRC."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv_col).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce(F.col(role_col), space), F.coalesce(F.col(text_col), space)
    return (
        rows.withColumn("_kind", kind)
        .filter("_kind <> 0")
        .select(
            F.col(conv_col).alias("conv_id"),
            F.col(turn_col).alias("turn"),
            F.when(F.col("_kind") == 4, F.lit("user")).otherwise(role).alias("role"),
            F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
            F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_copy"),
        )
        .drop("_copy")
    )


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column(batch.schema.get_field_index(name))
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(lists.offsets.to_numpy())


def _scanned(parts: DataFrame, combine: Callable, identity: list[int], backward: bool) -> DataFrame:
    """``conv, seg, outer``: the values of all later (or all earlier) segments of the conversation, combined in order.

    ``parts``: ``conv, seg, value``. Blocks of at most 512 segments are folded to one value, blocks of
    blocks likewise, until each conversation is one; on the way back each member gets its outside.
    """
    kind = parts.schema["conv"].dataType.simpleString()
    block = F.shiftright("seg", SEGMENT_BITS).alias("block")
    blocks = staged(parts.groupBy("conv", block).agg(F.array_sort(F.collect_list(F.struct("seg", "value"))).alias("members")), "scan")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for members in batch.column(2).to_pylist():
                value = members[0]["value"]
                for m in members[1:]:
                    value = combine(value, m["value"])
                values.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.list_(pa.int64()))], ["conv", "seg", "value"])

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            convs, segs, found = [], [], []
            for conv, members, outer in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for m in reversed(members) if backward else members:
                    convs.append(conv)
                    segs.append(m["seg"])
                    found.append(outer)
                    outer = combine(m["value"], outer) if backward else combine(outer, m["value"])
            columns = [pa.array(convs, batch.column(0).type), pa.array(segs, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["conv", "seg", "outer"])

    if blocks.groupBy("conv").count().filter("count > 1").isEmpty():
        framed = blocks.withColumn("outer", F.array(*[F.lit(v).cast("long") for v in identity]))
    else:
        folded = blocks.mapInArrow(fold, f"conv {kind}, seg long, value array<long>")
        around = _scanned(folded, combine, identity, backward).withColumnRenamed("seg", "block")
        framed = null_safe_join(blocks, around, ["conv", "block"])
    return framed.select("conv", "members", "outer").mapInArrow(unfold, f"conv {kind}, seg long, outer array<long>")


def _cross(a: list[int], b: list[int]) -> list[int]:
    return edits.crossed(np.array(a).reshape(4, 4), np.array(b).reshape(4, 4)).ravel().tolist()


def _follow(a: list[int], b: list[int]) -> list[int]:
    return [b[q] for q in a]


def _transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, lengths = _flat(batch, "codes")
        starts, values = np.cumsum(lengths) - lengths, [None] * len(lengths)
        for which in edits.blocks(lengths):
            crossing = edits.transfers(codes[edits.rows_of(starts[which], lengths[which])], lengths[which])
            for s, value in zip(which, crossing.reshape(-1, 16)):
                values[s] = value
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.list_(pa.int64()))], ["conv", "seg", "value"])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, lengths = _flat(batch, "codes")
        starts = np.cumsum(lengths) - lengths
        beyond = batch.column(batch.schema.get_field_index("outer")).to_pylist()
        # what follows the conversation's last segment is its end
        ends = np.array([(np.array(m).reshape(4, 4) + edits.END).min(axis=1) if m else edits.END for m in beyond]).reshape(-1, 4)
        last = batch.column(batch.schema.get_field_index("last")).to_numpy(zero_copy_only=False)
        audits, exits = [None] * len(lengths), [None] * len(lengths)
        for which in edits.blocks(lengths):
            words, goes = edits.paths(codes[edits.rows_of(starts[which], lengths[which])], lengths[which], ends[which], last[which])
            for s, word, go in zip(which, words.tolist(), goes.tolist()):
                audits[s], exits[s] = [w.decode("ascii") for w in word], go
        columns = [*batch.columns[:4], pa.array(audits, pa.list_(pa.string())), pa.array(exits, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:4], "audits", "exits"])


class Conversation:
    """What is known of one conversation while its segments and rows pass by in order."""

    def __init__(self, conv):
        self.conv, self.pieces, self.letters, self.state, self.lines, self.cost = conv, [], iter(""), edits.NONE, 0, 0
        self.faults, self.illegal, self.turns, self.least, self.turn, self.initial = [0, 0, 0, 0], 0, 0, None, None, None
        self.digest = sha256()

    def line(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.lines += 1

    def make(self) -> str:
        """Takes a turn of the role that must come next; the role."""
        self.state = int(edits.NEXT[self.state])
        return ROLES[self.state]

    def inserted(self) -> str | None:
        """Takes the insertions that come next; the letter behind them."""
        for letter in self.letters:
            if letter != "I":
                return letter
            self.cost += edits.INSERT
            self.line(self.make(), "")
        return None

    def segment(self, codes: list[int], audit: str) -> None:
        self.pieces.append(audit)
        self.letters, self.codes = iter(audit), iter(codes)

    def row(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.turn:
            self.least = turn if self.least is None else self.least
            self.turn, self.turns = turn, self.turns + 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        code = next(self.codes)
        self.faults[code >> 2] += 1
        letter = self.inserted()
        self.cost += edits.DELETE if letter == "D" else edits.TRUNCATED * (code >> 2 == edits.CUT) + edits.REROLE * (letter == "R")
        if letter == "K":
            self.state = int(edits.KEPT[code & 3, self.state])
            self.line(role, text)
        elif letter == "R":
            self.line(self.make(), text)

    def close(self) -> tuple:
        self.inserted()
        gaps = 0 if self.turn is None else self.turn - self.least + 1 - self.turns
        blank, duplicate, cut = self.faults[1:]
        return self.conv, gaps, blank, duplicate, cut, self.illegal, self.cost, "".join(self.pieces), self.digest.hexdigest()


RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, kind = None, None

    def out(done: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([d[k] for d in done], kind if k == 0 else pa.int64() if k < 7 else pa.string()) for k in range(9)]
        return pa.RecordBatch.from_arrays(columns, ["conv", *RESULT])

    for batch in batches:
        done, kind = [], batch.column(0).type
        for conv, what, turn, role, text, codes, audit in zip(*(c.to_pylist() for c in batch.columns)):
            if what == 0:
                if now is not None:
                    done.append(now.close())
                now = Conversation(conv)
            elif what == 1:
                now.segment(codes, audit)
            else:
                now.row(turn, role, text)
        yield out(done)
    if now is not None:
        yield out([now.close()])


def repair(
    rows: DataFrame,
    every: DataFrame | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    segment_bits: int = SEGMENT_BITS,
) -> DataFrame:
    """One row per conversation of ``every`` (or of ``rows``): ``conv_col``, its faults, and its cheapest repair.

    Rows stand by ``turn_col``, NULL first; rows of one turn by role, the first 64 characters and a hash
    of the text, so that equal rows are neighbours. ``blank``, ``duplicate``, ``truncated`` count rows by
    their first fault, ``illegal`` neighbours whose roles may not follow each other, ``gaps`` missing
    turns. ``audit`` are the letters of the edits (Keep, Rerole, Delete, Insert) of least ``cost`` that
    give an optional system turn and then user and assistant in pairs, the ASCII-least of the cheapest;
    ``repaired_sha256`` digests the rows they leave.

    A NULL role or text is one space, a NULL turn opens no gap, the NULL conversation is one
    conversation. One without rows has zeros, an empty audit and the digest of the empty text. An empty
    table gives no rows. Only a role's first character counts; other columns are not read. Runs jobs when called.
    """
    space = F.lit(" ")
    narrow = numbered(rows, "_row").select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), space).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), space).alias("text"),
        F.col("_row").alias("row"),
    )
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc()]
    order += [F.left("text", F.lit(64)).asc(), F.xxhash64("text").asc(), F.col("row").asc()]
    ordered = in_order(narrow, order, "at")

    # A row's code: the class of its role, and its first fault.
    initial = F.left("role", F.lit(1))
    role_class = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(edits.OTHER)
    content = F.rtrim(F.col("text"), F.lit(BLANKS))
    pair = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    facts = ordered.select(
        "conv", "at", pair.alias("pair"), role_class.alias("class"),
        (content == "").alias("blank"), (~F.right(content, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    firsts = facts.groupBy("conv", "pair").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("is_first"))
    fault = F.when(F.col("blank"), edits.BLANK).when(F.col("is_first").isNull(), edits.DUPLICATE).when(F.col("cut"), edits.CUT).otherwise(0)
    coded = facts.join(firsts, "at", "left").select("conv", "at", (F.col("class") + 4 * fault).cast("byte").alias("code"))
    segments = coded.groupBy("conv", F.shiftright("at", segment_bits).alias("seg")).agg(
        F.min("at").alias("first"), F.array_sort(F.collect_list(F.struct("at", "code"))).getField("code").alias("codes")
    )
    segments = staged(segments, "segments")
    spans = staged(segments.groupBy("conv").agg(F.min("seg").alias("low"), F.max("seg").alias("high")), "spans")
    segments = null_safe_join(segments, spans, ["conv"])
    lone = segments.filter("low = high").select("conv", "seg", "first", "codes", F.lit(True).alias("last"), F.lit(None).cast("array<long>").alias("outer"))
    several = segments.filter("low < high").select("conv", "seg", "first", "codes", (F.col("seg") == F.col("high")).alias("last"))

    kind = rows.schema[conv_col].dataType.simpleString()
    values = several.select("conv", "seg", "codes").mapInArrow(_transfers, f"conv {kind}, seg long, value array<long>")
    still = np.where(np.eye(4, dtype=bool), 0, edits.FAR).ravel().tolist()
    after = staged(_scanned(values, _cross, still, backward=True), "after")
    framed = null_safe_join(several, after, ["conv", "seg"]).select(*lone.columns)
    walked = lone.unionByName(framed).mapInArrow(
        _paths, f"conv {kind}, seg long, first long, codes array<tinyint>, audits array<string>, exits array<long>"
    )
    walked = staged(null_safe_join(walked, spans, ["conv"]), "paths")
    entries = _scanned(walked.filter("low < high").select("conv", "seg", F.col("exits").alias("value")), _follow, [0, 1, 2, 3], backward=False)
    entered = null_safe_join(walked.filter("low < high"), entries, ["conv", "seg"])
    audit = F.element_at("audits", (F.col("outer")[0] + 1).cast("int"))
    chosen = walked.filter("low = high").select("conv", "first", "codes", F.col("audits")[0].alias("audit"))
    chosen = chosen.unionByName(entered.select("conv", "first", "codes", audit.alias("audit")))

    # One stream by conversation: its name, then each segment ahead of its rows.
    names = (rows if every is None else every).select(F.col(conv_col).alias("conv")).distinct()
    empty = {"at": "long", "turn": rows.schema[turn_col].dataType.simpleString(), "role": "string", "text": "string", "codes": "array<tinyint>", "audit": "string"}

    def shaped(df: DataFrame, what: int, **have: str) -> DataFrame:
        return df.select("conv", F.lit(what).alias("what"), *[F.col(have[c]).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in empty.items()])

    stream = shaped(names, 0).unionByName(shaped(chosen, 1, at="first", codes="codes", audit="audit"))
    stream = stream.unionByName(shaped(ordered, 2, at="at", turn="turn", role="role", text="text"))
    by_conv = stream.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("at").asc_nulls_first(), "what")
    schema = f"conv {kind}, " + ", ".join(f"{c} {'string' if c in RESULT[-2:] else 'long'}" for c in RESULT)
    done = by_conv.select("conv", "what", "turn", "role", "text", "codes", "audit").mapInArrow(_stream, schema)
    return done.withColumnRenamed("conv", conv_col)
