import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from rinkspark.llm.packing import pack, patterns, plan

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_linear_program_is_near_its_bound():
    draw = np.random.default_rng(1)
    sizes = np.arange(1, 65)
    demand = draw.integers(1, 500, 64).astype(float)
    columns, amount = patterns(sizes, demand, 128)
    assert (columns.T @ sizes <= 128).all()
    assert (columns @ amount >= demand - 1e-6).all()
    assert amount.sum() <= 1.01 * demand @ sizes / 128


def test_plan_places_each_rank_once():
    histogram = {int(k): int(n) for k, n in zip(range(1, 65), np.random.default_rng(2).integers(0, 900, 64)) if n} | {40: 20_000}
    intervals, sequences = plan(histogram, 64)
    fill = np.zeros(sequences, np.int64)
    for size, n in histogram.items():
        own = intervals[intervals[:, 0] == size]
        for rank in range(n):
            _, first, count, start = own[np.searchsorted(own[:, 1], rank, "right") - 1]
            fill[start + (rank - first) % count] += size
    assert fill.max() <= 64 and fill.sum() == sum(k * n for k, n in histogram.items())
    assert plan({}, 64)[1] == 0


def test_round_trip(spark):
    library = Tokenizer.from_file(PATH)
    texts = ["word " * (k * 31 % 700) + str(k) for k in range(150)] + ["long text. " * 3000, "", None, "same text here"] + ["same text here"] * 40
    rows = [(k, t, 5) for k, t in enumerate(texts)] + [(None, "x", 1), (3, "y z", 1), (3, "y z", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(4)
    got = pack(df, PATH, capacity=256, keep_ids=True).collect()
    want = {}
    for doc, text, _ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        want.setdefault(doc, []).append(tuple(ids))
    sequences, docs = {}, {}
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append((r.start, tuple(np.frombuffer(r.ids, "<u4")), r.doc_tokens))
    for doc, pieces in docs.items():
        if len(want[doc]) == 1:
            joined = sum((p[1] for p in sorted(pieces)), ())
            assert joined == want[doc][0] and {p[2] for p in pieces} == {len(joined)}
        else:
            assert sorted(p[1] for p in pieces) == sorted(want[doc])
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
        padding += 256 - at
    assert sorted(sequences) == list(range(len(sequences)))
    assert padding <= 0.05 * sum(r.length for r in got)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
