import random
from itertools import combinations

import pytest

import corpus_pipeline
from rinkspark.llm.near_texts import candidates, probed, representatives


def shingle_set(text):
    found = text.lower().split()
    return {tuple(found[k : k + 5]) for k in range(max(1, len(found) - 4))}


def test_stage_removes_edited_copies(spark):
    draw = random.Random(11)
    texts = []
    for size in [30, 60, 120, 400] * 12:
        origin = [f"w{draw.randrange(3000)}" for _ in range(size)]
        texts.append(origin)
        for edits in (1, max(1, size // 60), size // 30, size // 15):
            copy = list(origin)
            for _ in range(edits):
                copy[draw.randrange(size)] = f"e{draw.randrange(10**6)}"
            texts.append(copy)
    hot = [f"h{draw.randrange(3000)}" for _ in range(150)]
    for _ in range(200):  # one large group
        copy = list(hot)
        for _ in range(2):
            copy[draw.randrange(150)] = f"e{draw.randrange(10**6)}"
        texts.append(copy)
    texts = [" ".join(t) for t in texts]
    rows = [(k, t, "en") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    sets = [shingle_set(t) for t in texts]
    links = [(a, b) for a, b in combinations(range(len(texts)), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    up = list(range(len(texts)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    firsts = {root(k) for k in range(len(texts))}
    gone = set(range(len(texts))) - firsts
    assert firsts <= kept  # nothing goes without a verified link
    assert len(gone - kept) >= 0.95 * len(gone)


def survivors(texts):
    """First of every group, by brute force."""
    sets, up = [shingle_set(t) for t in texts], list(range(len(texts)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in combinations(range(len(texts)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {root(k) for k in range(len(texts))}


def templated(draw, pairs, template, own):
    """Texts of one template with an own passage; each passage twice, with every tenth word changed."""
    frame, texts = [f"t{draw.randrange(10**6)}" for _ in range(template)], []
    for _ in range(pairs):
        passage = [f"o{draw.randrange(10**6)}" for _ in range(own)]
        for changed in (False, True):
            copy = list(passage)
            for k in range(5, own if changed else 0, 10):
                copy[k] = f"e{draw.randrange(10**6)}"
            texts.append(" ".join(frame + copy))
    return texts


@pytest.mark.parametrize("own", [40, 90])
def test_pairs_in_a_crowd_of_one_template(spark, own):
    texts = templated(random.Random(own), 120, 310, own)
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(5)
    kept = {r.row for r in representatives(docs, "row").collect()}
    assert kept == survivors(texts)


def test_crowd_of_several_groups_and_short_texts(spark):
    draw, texts = random.Random(5), []
    for own in (20, 36, 50):
        texts += templated(draw, 30, 200, own)
    texts += ["a b c d e"] * 30 + [f"a b c d e {k}" for k in range(30)] + [f"{k} b" for k in range(40)] + ["", " ", "x" * 100_000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(len(texts), None)]
    docs = spark.createDataFrame(rows, "row long, text string").repartition(3)
    kept = {r.row for r in representatives(docs, "row").collect()}
    assert kept == survivors([t or "" for _, t in rows])


def test_candidates_hold_every_similar_pair(spark):
    """Random sets over few shingles: the join by rare shingles alone, against all pairs."""
    draw = random.Random(3)
    sets = [sorted(draw.sample(range(14), draw.randint(1, 13))) for _ in range(250)]
    tokens = spark.createDataFrame([(k, len(s), t) for k, s in enumerate(sets) for t in s], "id long, n long, token long")
    nodes = spark.createDataFrame([(k, 0) for k in range(len(sets))], "id long, fp long")
    alone = spark.createDataFrame([], "node long, component long")
    got = {(r.a, r.b) for r in candidates(tokens, nodes, alone).collect()}
    sets = [set(s) for s in sets]
    want = {(a, b) for a, b in combinations(range(len(sets)), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert want and want <= got


def test_probes_find_near_fingerprints(spark):
    """Candidates of the stage's own method: every pair of fingerprints within two bits, equal ones by their first."""
    draw, prints = random.Random(9), []
    for _ in range(60):
        fp = draw.getrandbits(64)
        prints += [fp, fp ^ 1 << draw.randrange(64), fp ^ 1 << draw.randrange(64) ^ 1 << draw.randrange(64), fp]
    nodes = [(k, fp - (1 << 64) if fp >> 63 else fp) for k, fp in enumerate(prints)]
    got = {(r.a, r.b) for r in probed(spark.createDataFrame(nodes, "id long, fp long")).collect()}
    first = {fp: k for k, fp in reversed(list(enumerate(prints)))}
    want = {(a, b) for a, b in combinations(sorted(first.values()), 2) if (prints[a] ^ prints[b]).bit_count() <= 2}
    want |= {(first[fp], k) for k, fp in enumerate(prints) if first[fp] != k}
    assert want and got == want


def test_groups_leave_no_crumbs(spark, monkeypatch, tmp_path):
    """Short tables of links shuffle nothing within a round, and tables that nothing reads any more are removed."""
    import os

    from rinkspark.llm import common, components

    monkeypatch.setattr(common, "shared_folder", lambda spark: str(tmp_path))
    plans, plain = [], components.staged

    def watched(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name)

    monkeypatch.setattr(components, "staged", watched)
    links = [(k, k + 1) for k in range(40) if k != 20] + [(50, 50)]
    got = components.components(spark.createDataFrame(links, "a long, b long").repartition(8)).collect()
    assert {(r.node, r.component) for r in got} == {(k, 0 if k <= 20 else 21) for k in range(41)}
    assert len(plans) > 2 and not any("hashpartitioning" in p for p in plans[1:])
    draw = random.Random(8)
    texts = [" ".join(str(draw.randrange(500)) for _ in range(60)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts + [t + " end" for t in texts])), "id long, text string")
    assert sorted(r.id for r in representatives(docs, "id").collect()) == list(range(30))
    left = {name.rsplit("-", 1)[0] for name in os.listdir(tmp_path)}
    assert "copies-groups" in left and not left & {"copies-pairs", "copies-sets"}
