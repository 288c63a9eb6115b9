import numpy as np

from rinkspark.llm.near_vectors import calibrated, near_vectors
from rinkspark.llm.topk import top_k

ODD = [(9001, None), (9002, []), (9003, [0.0] * 8), (9004, [1.0] * 7 + [float("nan")]), (9005, [1.0] * 7 + [None]),
       (9006, [float("inf")] * 8), (9007, [1.0, 2.0])]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(4)


def made(n, dim=8, seed=1):
    draw = np.random.default_rng(seed)
    base = draw.standard_normal((n, dim))
    base[n // 2 : n // 2 + 40] = base[0] + 0.05 * draw.standard_normal((40, dim))
    base[n // 2 + 40 : n // 2 + 60] = base[1]
    for k in range(n // 2 + 60, n - 20):
        base[k] = base[k - n // 2] + 0.25 * draw.standard_normal(dim)
    return base.astype(np.float32)


def test_top_k_against_brute_force(spark):
    vectors = made(600)
    rows = list(enumerate(vectors.tolist())) + ODD
    got = sorted(tuple(r) for r in top_k(frame(spark, rows), k=5, every=50).collect())
    whole = np.floor(vectors.astype(float) * 256).astype(np.int64)
    want = []
    for q in range(0, 600, 50):
        best = sorted((-int(whole[q] @ whole[i]), i) for i in range(600) if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_over_several_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr("rinkspark.llm.topk.SHARD", 60)
    monkeypatch.setattr("rinkspark.llm.topk.BLOCK", 7)
    monkeypatch.setattr("rinkspark.llm.topk.LEAF", 8)
    test_top_k_against_brute_force(spark)


def test_top_k_of_large_components(spark):
    """Scores in the range of a long, from components far apart in size, are exact and in order."""
    draw = np.random.default_rng(8)
    vectors = (draw.integers(-(2**20), 2**20, (80, 4)) * 2.0 ** draw.integers(-8, 2, (80, 1))).astype(np.float32)
    vectors[3], vectors[5], vectors[7] = [200_000, 1, 0, 0], [300_000, 1, 0, 0], [300_000, 2, 0, 0]
    whole = [[int(np.floor(float(x) * 256)) for x in v] for v in vectors]
    want = []
    for q in range(0, 80, 20):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in range(80) if i != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:5])]
    assert max(abs(w[3]) for w in want) > 2**52
    got = top_k(frame(spark, list(enumerate(vectors.tolist()))), every=20)
    assert sorted(map(tuple, got.collect())) == sorted(want) and dict(got.dtypes)["score"] == "bigint"
    huge = [(0, [3e38, 1.0]), (1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [1.0, 0.0])]
    assert [(r.vec_id, r.score) for r in top_k(frame(spark, huge)).orderBy("rank").collect()] == [(1, 2**63 - 1), (3, 2**61), (2, -(2**63))]


def test_top_k_of_few_and_none(spark):
    assert top_k(frame(spark, [(0, [1.0]), (1, [2.0]), (1, [2.0]), (None, [9.0])])).count() == 2
    assert top_k(frame(spark, ODD[:2])).count() == 0
    assert top_k(frame(spark, [])).count() == 0


def test_links_against_brute_force(spark):
    vectors = made(500)
    rows = list(enumerate(vectors.tolist())) + ODD
    got = {r.vec_id: r for r in near_vectors(frame(spark, rows)).collect()}
    unit = vectors.astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    assert sum(got[k].n_links for k in range(500)) >= 0.95 * near.sum()
    assert all(got[k].n_links <= near[k].sum() for k in range(500))
    groups = {}
    for k in range(500):
        groups.setdefault(got[k].component_id, []).append(k)
    for component, members in groups.items():
        assert component == min(members) and all(got[m].kept == (m == component) for m in members)
        reached = {component}
        while True:
            more = set(np.flatnonzero(near[sorted(reached)].any(axis=0))) | reached
            if more == reached:
                break
            reached = more
        assert set(members) <= reached
    for k, _ in ODD:
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)


def test_dense_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("rinkspark.llm.near_vectors.BLOCK", 16)
    monkeypatch.setattr("rinkspark.llm.near_vectors.GATHER", 100)
    draw = np.random.default_rng(3)
    vectors = (draw.standard_normal(16) + 0.02 * draw.standard_normal((120, 16))).astype(np.float32)
    rows = list(enumerate(vectors.tolist())) + [(500 + k, vectors[0].tolist()) for k in range(30)]
    got = near_vectors(frame(spark, rows)).collect()
    assert {r.component_id for r in got} == {0}
    assert min(r.n_links for r in got) >= 140 and max(r.n_links for r in got) <= 149


def test_calibration_keeps_recall_as_the_table_grows():
    for n in (2, 1000, 10**6, 10**9):
        lines, tables, count = calibrated(n, 0.9)
        assert lines >= 2 and tables >= 4 and count >= 1
    assert near_count(10**9) > near_count(10**3)


def near_count(n):
    return calibrated(n, 0.9)[0]


def test_empty_table(spark):
    assert near_vectors(frame(spark, [])).count() == 0
