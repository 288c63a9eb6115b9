import random
import re

import numpy as np
import pytest

from rinkspark.llm import personal
from rinkspark.llm.boosting import Boosted

RULES = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    found = []
    for kind, rule in enumerate(RULES):
        for m in re.finditer(rule, text):
            digits = personal.digits_of(m.group())
            good = [True, kind != 1 or all(int(p) <= 255 for p in m.group().split(".")), 14 <= len(digits) <= 19 and personal.luhn(digits), 10 <= len(digits) <= 15]
            if good[kind]:
                found.append((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], s[0]))


def test_rules_against_the_plain_patterns():
    draw = random.Random(2)
    for alphabet in ("01259 -+().", "ab.@-+ 1", "4111 1-", "1.2.255.256 "):
        for _ in range(1500):
            text = "".join(draw.choices(alphabet, k=draw.randint(0, 40)))
            assert personal.base_spans(text) == brute(text), text
    for text in ("4111 1111 1111 1111", "é a.b@c.d@e.f 1.2.3.4.5.6.7.8 +1 (234) 555-0100", "001.002.003.0255", "1" * 50_000, "a" * 50_000, "a@" * 5000, "+" * 5000):
        assert personal.base_spans(text) == brute(text) if len(text) < 100 else personal.base_spans(text) is not None


def test_trees_learn_an_interaction():
    draw = np.random.default_rng(0)
    x = draw.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    model = Boosted(trees=30).fit(x[:3000], y[:3000])
    assert ((model.probability(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    words = "the quick brown fox jumps over lazy dogs and some cats".split()
    made = []
    for k in range(900):
        text = draw.choices(words, k=30)
        number = f"({draw.randint(200, 999)}) {draw.randint(200, 999)}-{draw.randint(1000, 9999)}"
        if k % 3 == 0:
            text.insert(9, f"call +1 {number}")
        if k % 4 == 0:
            text.insert(3, f"u{k}@mail{k % 9}.example.com")
        if k % 5 == 0:
            text.insert(20, f"order {draw.randint(1000, 9999)}-{draw.randint(10, 99)}-{draw.randint(10, 99)}")
        if k % 50 == 1:
            text.insert(9, f"call {number}")
        made.append((k, " ".join(text), 3))
    return made + [(None, None, 1), (2000, "", 1), (2001, "x " * 300_000 + "a@b.cd", 1), (7, made[7][1], 3)]


def test_queries_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, n_ip int").repartition(3)
    got = personal.find_personal(df, keep_text=True).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] or "" for r in rows}
    added = 0
    for r in got:
        base = brute(texts[r.doc_id])
        assert r.base_spans == personal.written(base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == s[0] for s in base) for k in range(4)]
        spans = [tuple(s.split(":")) for s in r.spans.split(",")] if r.spans else []
        assert set(r.base_spans.split(",")) - {""} <= set(r.spans.split(","))
        for kind, a, b in set(spans) - {tuple(s.split(":")) for s in r.base_spans.split(",")}:
            added += 1
            assert kind == "phone" and texts[r.doc_id][int(a) : int(b)].startswith("(")
        assert "@mail" not in r.redacted
    assert added >= 9


def test_without_anything_to_learn(spark):
    df = spark.createDataFrame([(1, "plain words only"), (2, "a@b.cd")], "doc_id long, text string")
    assert sorted(r.spans for r in personal.find_personal(df).collect()) == ["", "email:0:6"]
    assert personal.find_personal(df.limit(0)).count() == 0


def test_trees_from_a_table_equal_those_from_rows(spark):
    """Sums over tasks give the trees that the rows give in one place."""
    draw = np.random.default_rng(0)
    x = draw.random((3000, 4))
    y = (x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)
    own = Boosted(trees=10).fit(x, y.astype(float))
    table = [(bytes(b), 1, int(p)) for b, p in zip(own.binned(x).astype(np.uint8), y)]
    spread = Boosted(trees=10).fit_spread(spark.createDataFrame(table, "bins binary, n long, pos long").repartition(5), own.cuts)
    assert np.abs(spread.probability(x) - own.probability(x)).max() < 0.02


def test_fit_reads_every_span(spark):
    """The only confirmed phone numbers stand behind forty other spans of their texts."""
    draw = random.Random(3)
    texts = [" ".join(f"{draw.randint(10, 99)}-{draw.randint(1000, 9999)}-{draw.randint(10, 99)}" for _ in range(45)) + f" call +1 (234) 555-{k:04}" for k in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    spans = personal.staged_spans(df)
    assert spans.selectExpr("min(size(spans)) AS n").first().n > 4 * 40
    model, thresholds = personal.fit(spans)
    assert model is not None and thresholds[3] < np.inf


def test_sums_sent_do_not_grow_with_the_files(spark, monkeypatch):
    """However many files hold the table, it is read in as many tasks as its rows ask for."""
    draw = np.random.default_rng(3)
    rows = [(bytes(draw.integers(0, 32, 3).astype(np.uint8)), 1, int(draw.integers(0, 2))) for _ in range(300)]
    kind = type(spark.range(0))
    tasks, plain = [], kind.mapInArrow

    def watched(df, *args, **more):
        tasks.append(df.rdd.getNumPartitions())
        return plain(df, *args, **more)

    cuts = np.tile(np.arange(31.0), (3, 1))
    models = []
    monkeypatch.setattr(kind, "mapInArrow", watched)
    for parts in (1, 24):
        table = spark.createDataFrame(rows, "bins binary, n bigint, pos bigint").repartition(parts)
        models.append(Boosted(trees=9, depth=2).fit_spread(table, cuts))
    assert len(tasks) == 38 and set(tasks) == {1}
    for one, two in zip(*(m.nodes for m in models)):
        assert all((a == b).all() for a, b in zip(one, two))
