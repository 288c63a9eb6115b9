import random

import numpy as np
import xxhash

from rinkspark.llm.components import components
from rinkspark.llm.simhash import allocate, links_within, near_duplicates


def brute_print(text):
    found = (text or "").encode().lower().split()
    grams = [b" ".join(found[k : k + 3]) for k in range(max(1, len(found) - 2))] if found else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = list(prints)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in ids}


def test_documents_against_brute_force(spark):
    draw = random.Random(5)
    vocabulary = [f"w{k}é" if k % 7 else f"W{k}" for k in range(60)]
    texts = [" ".join(draw.choices(vocabulary, k=draw.choice([1, 2, 3, 8, 60, 200]))) for _ in range(120)]
    for k in range(60):
        changed = texts[k % 5 + 40].split()
        changed[draw.randrange(len(changed))] = "edit"
        texts.append("\x0b ".join(changed))
    texts += ["", None, " \t\n", texts[0], texts[0]]
    rows = [(k, t, "x") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string").repartition(3)
    prints = {k: brute_print(t) for k, t, _ in rows}
    want = brute_components(prints)
    got = near_duplicates(df).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == [(k, f"{prints[k]:016x}", want[k]) for k in prints]


def test_links_in_a_dense_group_are_whole(spark):
    draw = random.Random(1)
    core = draw.getrandbits(64)
    values = {core ^ sum(1 << b for b in draw.sample([3, 9, 20, 21, 22, 40, 41, 60, 63], draw.randrange(5))) for _ in range(300)}
    values |= {draw.getrandbits(64) for _ in range(200)} | {0, 1, 3, 2**64 - 1}
    signed = [int(v) - (v >> 63 << 64) for v in values]
    df = spark.createDataFrame([(v, v) for v in signed], "fp long, least long").repartition(4)
    for most in (2, 3):
        got = {(r.a, r.b) for r in links_within(df, most).collect()}
        assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= most}


def test_allocation_is_the_cheapest():
    cost = np.random.default_rng(0).random((50, 3, 4)).cumsum(axis=2)
    cost[:, :, 0] = 0
    limits = allocate(cost, 2)
    assert (limits.sum(axis=1) == 0).all()
    for row in range(50):
        all_sums = [sum(cost[row, p, t + 1] for p, t in enumerate(c)) for c in np.ndindex(4, 4, 4) for c in [[x - 1 for x in c]] if sum(c) == 0]
        assert abs(sum(cost[row, p, t + 1] for p, t in enumerate(limits[row])) - min(all_sums)) < 1e-12


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(200, 300)] + [(7, 7), (9, 8), (8, 9), (None, 1)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 5 for k in [5, *range(200, 300)]} | {8: 8, 9: 8}


def test_empty_table_and_null_ids(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert [r.component_id for r in near_duplicates(rows).collect()] == [None, None]
