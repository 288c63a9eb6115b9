import hashlib
import random

import pytest

from rinkspark.llm.repeats import remove_repeats


def brute(rows, length):
    seen, out = set(), []
    ranked = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    for k in ranked:
        data = (rows[k][1] or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            part = data[s : s + length]
            if part in seen:
                gone[s : s + length] = b"\x01" * length
            seen.add(part)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((rows[k][0], len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts(draw, n, size):
    vocabulary = [f"{a}{b}é"[: draw.randint(1, 5)] for a in "abcdefghij" for b in "klmnop"]
    passage = [" ".join(draw.choices(vocabulary, k=60)) for _ in range(4)]
    made = []
    for k in range(n):
        words = draw.choices(vocabulary, k=draw.randint(0, size))
        text = " ".join(words)
        if k % 3 == 0:
            cut = draw.randint(0, len(text))
            text = text[:cut] + passage[k % 4][draw.randint(0, 40) :] + text[cut:]
        if k % 5 == 0 and made:
            text = made[draw.randrange(len(made))]
        if k % 7 == 0:
            at = draw.randint(0, len(text))
            text = text[:at] + "#" + text[at + 1 :]
        made.append(text)
    return made


@pytest.mark.parametrize("length,seed", [(100, 1), (40, 2), (33, 3)])
def test_against_brute_force(spark, monkeypatch, length, seed):
    monkeypatch.setattr("rinkspark.llm.repeats.PIECE", 3000)
    monkeypatch.setattr("rinkspark.llm.repeats.GATHER", 50)
    draw = random.Random(seed)
    rows = list(enumerate(texts(draw, 90, 120)))
    rows += [(200, "a" * 700), (201, "ab" * 300), (202, "a" * 350), (203, None), (204, ""), (205, "é" * 49), (206, "é" * 50), (207, "é" * 50 + "z"), (300, rows[10][1] * 3)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_bytes int").coalesce(2)
    assert sorted(map(tuple, remove_repeats(df, length=length).collect()), key=str) == brute(rows, length)


def test_repeated_rows_null_ids_and_kept_bytes(spark):
    text = "".join(random.Random(9).choices("abcdefgh ", k=400))
    rows = [(None, text), (5, text), (5, text), (4, "x" + text[:150])]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), keep_text=True).collect()
    assert sorted((r.doc_id or 0, r.n_removed, len(r.kept)) for r in got) == [(0, 400, 0), (4, 0, 151), (5, 150, 250), (5, 400, 0)]


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
