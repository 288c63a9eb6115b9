import pytest

from rinkspark.llm.mixing import mix


def expected_targets(sizes: dict, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    goal, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in goal]
        left = total - sum(goal.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return goal | share
        goal |= {s: most * sizes[s] for s in over}


def mixed(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    return sorted(map(tuple, mix(df.repartition(3), **kw).collect()), key=str)


def test_targets_and_copies(spark):
    rows = []
    for k in range(400):
        source = ["b", "a", "é", None, "hot", "hot", "hot"][k % 7]
        rows.append((k, "w " * (1 + k * 37 % 90), source, 0))
    rows += [(1000, None, "a", 0), (1001, "", "b", 1), (1002, "  x\x0b\x0cy", "empty?", 0), (1003, "", "none", 0)]
    got = mixed(spark, rows)
    assert got == mixed(spark, rows)
    assert len(got) == len(rows)
    words = {}
    for k, t, s, _ in rows:
        words[s] = words.get(s, 0) + len((t or "").encode().split())
    want = expected_targets(words)
    source_of = {r[0]: r[2] for r in rows}
    taken = {}
    for doc, size, source_size, target, copies, took in got:
        s = source_of[doc]
        assert source_size == words[s] and target == pytest.approx(want[s], rel=1e-12)
        assert took == copies * size and 0 <= took <= 3 * size
        taken[s] = taken.get(s, 0) + took
    for s, goal in want.items():
        assert abs(taken[s] - goal) <= 90


def test_repeated_rows_and_empty_table(spark):
    got = mixed(spark, [(1, "a b", "s", 0), (1, "a b", "s", 0), (None, "c", "t", 0)])
    assert [r[0] for r in got].count(1) == 2
    assert mixed(spark, []) == []
