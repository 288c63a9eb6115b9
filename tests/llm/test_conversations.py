import random
import re
from hashlib import sha256
from heapq import heappop, heappush
from zlib import crc32

import numpy as np
import pytest

from rinkspark.llm import edits
from rinkspark.llm.conversations import damaged, repair

WORDY = re.compile(r"[^\x20\x09-\x0D]")
GOAL = re.compile(r"(s?(ua)+)?")
STEP = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def spoiled(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [] if kind == 0 else [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows, faults):
    """Least (cost, audit) by Dijkstra over (row, last initial), with the lines it leaves."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, state, lines = heappop(heap)
        if (k, state) in done:
            continue
        done.add((k, state))
        if k == len(rows) and state in ("", "a"):
            assert GOAL.fullmatch("".join(line[:1] for line in lines))
            return cost, audit, "\n".join(lines)
        for role in ("user", "assistant"):
            if role[0] in STEP[state]:
                heappush(heap, (cost + 3, audit + "I", k, role[0], (*lines, f"{role}:")))
        if k < len(rows):
            heappush(heap, (cost + 4, audit + "D", k + 1, state, lines))
            _, role, text = rows[k]
            if faults[k] not in ("blank", "duplicate"):
                extra = 3 * (faults[k] == "truncated")
                if role[:1] in STEP[state]:
                    heappush(heap, (cost + extra, audit + "K", k + 1, role[:1], (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if new[0] in STEP[state]:
                        heappush(heap, (cost + extra + 3, audit + "R", k + 1, new[0], (*lines, f"{new}:{text}")))


def brute(rows, every):
    out = []
    for conv in {r[0] for r in every}:
        own = sorted([r[1:] for r in rows if r[0] == conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            letters = WORDY.findall(text)
            faults.append("blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, text = cheapest(own, faults)
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def made(draw, conv, n, step=1):
    text = lambda: draw.choice(["Hello there.", "no end", "Why?", "  \t", "", "é!\n", "again.", "x" * 40 + ".", None])
    role = lambda: draw.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "under"])
    # one row a turn: ties of different rows are held in a test of their own
    return [(conv, k * step, role(), text()) for k in range(n)]


def table(spark, rows):
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    return docs.selectExpr("*", "1 AS conv", "2 AS at", "3 AS row", "4 AS codes", "5 AS audit", "6 AS seg")


def held(spark, rows, bits):
    every = table(spark, rows)
    got = repair(damaged(every), every, segment_bits=bits)
    assert got.columns[1:] == ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(spoiled(rows), rows)


@pytest.mark.parametrize("bits", [1, 9])
def test_equals_the_definition(spark, bits):
    draw = random.Random(5)
    rows = [r for conv in range(60) for r in made(draw, conv, draw.randint(1, 9), draw.choice([1, 1, 3]))]
    rows += made(draw, None, 12) + made(draw, 70, 90) + [(71, None, "user", "Hi.")] * 7 + [(72, 4, "user", "long " * 60_000 + ".")]
    rows += [(73, k % 2 or None, "user", "Same.") for k in range(9)] + [(c, 0, "user", "One.") for c in range(100, 160)]
    held(spark, rows, bits)


def test_a_conversation_with_most_rows(spark):
    draw = random.Random(9)
    held(spark, made(draw, 1, 2500) + made(draw, 2, 4) + [(3, 1, "assistant", "Copy.")] * 400, 3)


def test_ties_follow_role_then_text(spark):
    rows = [(1, 0, "user", "b."), (1, 0, "assistant", "z."), (1, 0, "user", "a."), (1, 1, "assistant", "c.")]
    every = table(spark, rows)
    assert repair(every).collect()[0].audit == brute(rows, rows)[0][7]
    ordered = sorted(rows, key=lambda r: r[1:])
    assert tuple(repair(every).collect()[0]) == brute(ordered, ordered)[0]


def test_empty_table_and_lost_conversations(spark):
    nothing = table(spark, [])
    assert repair(nothing).count() == 0
    every = table(spark, [(5, 1, "user", "a."), (None, None, None, None)])
    got = {tuple(r) for r in repair(nothing, every).collect()}
    assert got == {(c, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest()) for c in (5, None)}


def test_ranked_paths_are_least_among_all_cheapest():
    draw = random.Random(2)
    codes = [[draw.randint(0, 15) for _ in range(draw.randint(0, 6))] for _ in range(200)]
    lengths = np.array([len(c) for c in codes])
    ends = np.tile(np.array(edits.END), (len(codes), 1))
    words, _ = edits.paths(np.array(sum(codes, []), dtype=np.int64), lengths, ends, np.ones(len(codes), dtype=bool))
    for own, word in zip(codes, words[:, 0]):
        rows = [(k, ("system", "user", "assistant", "tool")[c & 3], "") for k, c in enumerate(own)]
        faults = [("", "blank", "duplicate", "truncated")[c >> 2] for c in own]
        assert word.decode() == cheapest(rows, faults)[1]
