import math
import zlib
from collections import Counter

import numpy as np
import pytest

from rinkspark.llm import gru
from rinkspark.llm.scoring import score_documents


def documents():
    draw = np.random.default_rng(4)
    texts = []
    for k in range(140):
        topic = ["red green blue", "one two three four", "up down"][k % 3].split()
        texts.append(" ".join(topic * int(draw.integers(1, 9))) + (f" Rare{k}" if k % 4 == 0 else ""))
    return list(enumerate(texts)) + [(200, None), (201, ""), (202, "\x0b \t"), (203, "né NÉ né"), (203, "né NÉ né"), (None, "one two")]


def split(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def test_base_scores_against_brute_force(spark):
    rows = documents()
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    for dictionary in (5, 1000):
        got = score_documents(df, dictionary=dictionary, short=4, stride=1).collect()
        counts = Counter(w for i, t in rows if not split(i) for w in [*(t or "").encode().lower().split(), None])
        n, v = sum(counts.values()), len(counts)
        want = []
        for i, t in rows:
            own = [*(t or "").encode().lower().split(), None]
            base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
            want.append((i, split(i), len(own), sum(counts[w] > 0 for w in own), n, pytest.approx(base, rel=1e-9)))
        key = lambda r: (str(r[0]), r[2], r[3])
        assert [tuple(r)[:6] for r in sorted(got, key=key)] == sorted(want, key=key)
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_model_beats_counts_on_unseen_texts(spark):
    rows = [(k, "a b c d e f g h " * (3 + k % 5)) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = [r for r in score_documents(df, stride=1).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.7 * sum(r.base_score for r in got)


def test_probabilities_sum_to_one():
    p = gru.fresh(50, seed=2)
    h = np.random.default_rng(0).normal(size=(1, gru.HIDDEN)).astype(np.float32)
    words = [*range(50), 64]
    total = sum(math.exp(gru.log_p(p, h, np.array([w]))[0]) for w in words)
    assert total == pytest.approx(1, abs=1e-5)


def test_state_is_carried_through_the_whole_text():
    p = gru.fresh(40, seed=3)
    text = np.random.default_rng(1).integers(0, 40, 300)
    h, last, total = np.zeros((1, gru.HIDDEN), np.float32), np.array([0]), 0.0
    for w in text:
        h = gru.step(p, last, h)[0]
        total += gru.log_p(p, h, np.array([w]))[0]
        last = np.array([w])
    got = gru.score(p, [text[:5], text, text[:0], text], 0)
    assert got[1] == pytest.approx(total, rel=1e-5) and got[1] == got[3] and got[2] == 0


def test_gradients_against_differences():
    p = {k: v.astype(float) for k, v in gru.fresh(40, hidden=4).items()}
    draw = np.random.default_rng(0)
    inputs, targets, h = draw.integers(0, 64, (5, 3)), draw.integers(0, 40, (5, 3)), draw.normal(size=(3, 4))
    targets[0, 0], targets[4, 1] = 64, -1
    got = gru.gradients(p, inputs, targets, h)[0]
    for k in p:
        for _ in range(3):
            at = tuple(draw.integers(0, s) for s in p[k].shape)
            if p[k][at] < -1e8:
                continue
            kept, ends = p[k][at], []
            for move in (1e-5, -1e-5):
                p[k][at] = kept + move
                ends.append(gru.gradients(p, inputs, targets, h)[2])
            p[k][at] = kept
            assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(got[k][at], abs=1e-5)


def test_empty_table(spark):
    assert score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_registered_setting_reads_every_training_token(spark, monkeypatch, tmp_path):
    from rinkspark.llm import queries, scoring

    seen = []
    kept = scoring.staged

    def watched(df, name):
        back = kept(df, name)
        if name == "scoring-chunks":
            seen.append(sum(len(r.ids) // 2 for r in back.collect()))
        return back

    monkeypatch.setattr(scoring, "staged", watched)
    rows = documents()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_scoring(spark, str(tmp_path)).collect()
    assert seen == [got[0].train_tokens]


def test_driver_gets_one_set_of_parameters_from_many_trainers(spark, monkeypatch):
    from rinkspark.llm import scoring

    df = spark.createDataFrame(documents(), "doc_id long, text string").repartition(2)
    kept, seen = type(df).collect, []

    def watched(self):
        rows = kept(self)
        if "p" in self.columns:
            seen.append(sum(len(r.p) for r in rows))
        return rows

    monkeypatch.setattr(type(df), "collect", watched)
    monkeypatch.setattr(scoring, "SHARE", 1)
    monkeypatch.setattr(scoring, "TRAINERS", 8)
    score_documents(df, short=4)
    assert seen == [sum(v.nbytes for v in gru.fresh(4).values())] * scoring.ROUNDS


def test_parameters_are_averaged_by_tokens_seen():
    import pyarrow as pa

    from rinkspark.llm.scoring import averaged

    sets = [np.array(x, np.float32).tobytes() for x in ([1, 2], [5, 10])]
    got = averaged(pa.table({"block": [3, 3], "trainer": [1, 0], "p": sets, "n": [3, 1]}))
    assert got["block"].to_pylist() == [3] and np.frombuffer(got["p"][0].as_py(), np.float32).tolist() == [2, 4]


def test_ids_of_every_document_are_staged_once(spark, monkeypatch):
    from rinkspark.llm import scoring

    kept, seen = scoring.staged, []

    def watched(df, name):
        back = kept(df, name)
        if "ids" in df.columns and "n_tokens" in df.columns:
            seen.extend((r.id, r.held_out, len(r.ids) // 2) for r in back.collect())
        return back

    monkeypatch.setattr(scoring, "staged", watched)
    got = score_documents(spark.createDataFrame(documents(), "doc_id long, text string").repartition(2)).collect()
    assert sorted(map(str, seen)) == sorted(str((r.doc_id, r.held_out, r.n_tokens)) for r in got)


def test_many_lanes_against_one_by_one():
    p = gru.fresh(70, seed=5)
    draw = np.random.default_rng(2)
    inputs, targets = draw.integers(0, 97, (6, 9)), draw.integers(0, 70, (6, 9))
    targets[3:, 4], targets[5, 2], targets[1, 1] = -1, -1, 96
    h = draw.normal(size=(9, gru.HIDDEN)).astype(np.float32)
    got, last, loss = gru.gradients(p, inputs, targets, h)
    alone = [gru.gradients(p, inputs[:, [k]], targets[:, [k]], h[[k]]) for k in range(9)]
    weights = (targets >= 0).sum(axis=0) / (targets >= 0).sum()
    assert loss == pytest.approx(sum(w * a[2] for w, a in zip(weights, alone)), rel=1e-5)
    assert np.allclose(last, np.vstack([a[1] for a in alone]), atol=1e-6)
    for k in p:
        assert np.allclose(got[k], sum(w * a[0][k] for w, a in zip(weights, alone)), atol=1e-6)
