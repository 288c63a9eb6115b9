import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from rinkspark.llm import outliers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    covered = {k + d for k, w in enumerate(windows) if often[w] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def texts(draw):
    vocabulary = [f"{a}{b}{c}" for a in ("ba", "co", "é") for b in ("lo", "mi", "na") for c in ("x", "yy", "")]
    odd = ["", " ", "one", "a a", "a a a", "a a a a", "a b c a b c", "a b c d a b c", "#$ <b>|\n\n \nx\nx \nx", "\x85 \xa0 y\x1c", "long " * 30_000, "w" * 100_000]
    return odd + [" ".join(draw.choices(vocabulary, k=draw.randint(1, 120))) + draw.choice(["", "\nq w\nq w", " #"]) for _ in range(200)]


def table(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    return docs.selectExpr("*", "1 AS key", "2 AS n_words", "3 AS h", "4 AS start", "5 AS kept")


def test_counts_equal_the_definition(spark):
    rows = [(k, t, "en", "s") for k, t in enumerate(texts(random.Random(3)))] + [(None, None, None, None), (4, "copy", "en", "s"), (4, "copy", "en", "s")]
    got = outliers.quality_rules(table(spark, rows)).collect()
    want = sorted([(i, *counted(t)) for i, t, _, _ in rows], key=str)
    assert sorted([tuple(r)[:7] for r in got], key=str) == want
    assert not any(r.kept and r.base_failed for r in got)


def brute_estimate(x):
    """Regularised MCD of the same rule on arrays: distance classes, two starts, C-steps."""
    n, tol = len(x), np.diag(np.square(list(outliers.TOLERANCE.values())))
    need = math.ceil(n * outliers.SHARE)
    factor = outliers.SHARE / outliers.gamma_share(outliers.P / 2 + 1, outliers.chi2_quantile(outliers.SHARE, outliers.P) / 2)
    low = lambda v: np.sort(v, axis=0)[(n + 1) // 2 - 1]
    grid = np.round(x, 3)
    middle = low(grid)
    spread = np.sqrt((1.4826 * low(np.round(abs(grid - middle), 3))) ** 2 + np.diag(tol))
    y = np.tanh((x - middle) / spread)
    c = y.T @ y
    r = c / np.sqrt(np.outer(np.diag(c) + 1e-3, np.diag(c) + 1e-3))
    np.fill_diagonal(r, 1)
    best = None
    for s in (np.diag(spread**2), r * np.outer(spread, spread)):
        m, was = middle, None
        for _ in range(40):
            away = x - m
            d = np.einsum("ij,jk,ik->i", away, np.linalg.inv(s), away)
            near = np.ceil(np.log(d + 1e-6) * outliers.CLASSES)
            inside = x[near <= np.sort(near)[need - 1]]
            found = inside.mean(axis=0), np.cov(inside.T, bias=True) * factor + tol
            det = np.linalg.slogdet(found[1])[1]
            if was is not None and was <= det:
                break
            was, (m, s) = det, found
        if best is None or was < best[0]:
            best = (was, m, s)
    return best


@pytest.mark.parametrize("n", [1, 2, 400])
def test_estimate_equals_arrays_and_ignores_outliers(spark, n):
    draw = np.random.default_rng(n)
    mix = draw.normal(size=(5, 5)) * 0.3
    x = np.round(draw.normal(size=(n, 5)) @ mix + 1, 9)
    if n > 2:
        x[: n // 5] += 8
    rows = [("k", *map(float, v)) for v in x] + [("other", *[0.5] * 5)] * 7
    points = spark.createDataFrame(rows, "key string, " + ", ".join(f"{s} double" for s in outliers.STATS)).repartition(4)
    got = {r.key: r for r in outliers.estimate(points).collect()}
    _, m, s = brute_estimate(x)
    assert np.allclose([got["k"][f"m_{i}"] for i in range(5)], m, atol=2e-3)
    assert np.allclose([got["k"][f"s_{i}{j}"] for i, j in outliers.PAIRS], [s[i, j] for i, j in outliers.PAIRS], atol=5e-3)
    assert [got["other"][f"m_{i}"] for i in range(5)] == [0.5] * 5
    if n > 2:
        clean = x[n // 5 :].mean(axis=0)
        assert np.abs(m - clean).max() < 0.4


def test_factor_gives_distances(spark):
    draw = np.random.default_rng(4)
    a = draw.normal(size=(5, 5))
    s, x = a @ a.T + np.eye(5), draw.normal(size=5)
    row = {f"m_{i}": 0.0 for i in range(5)} | {f"s_{i}{j}": float(s[i, j]) for i, j in outliers.PAIRS} | dict(zip(outliers.STATS, map(float, x)))
    got = outliers.with_factor(spark.createDataFrame([row])).select(outliers.distance().alias("d"), "log_det").first()
    assert math.isclose(got.d, x @ np.linalg.inv(s) @ x, rel_tol=1e-9) and math.isclose(got.log_det, np.linalg.slogdet(s)[1], abs_tol=1e-8)


def test_quantiles():
    # known values of the chi-squared distribution
    assert math.isclose(outliers.chi2_quantile(0.95, 5), 11.0705, abs_tol=1e-3)
    assert math.isclose(outliers.chi2_quantile(0.5, 2), 2 * math.log(2), abs_tol=1e-6)


def prose(draw, n):
    return " ".join("".join(draw.choices("abcdefghij", k=draw.randint(3, 8))) for _ in range(n))


def test_outliers_go_and_usual_documents_stay(spark):
    draw = random.Random(7)
    rows = [(k, prose(draw, draw.randint(60, 300)), draw.choice(["en", None]), f"s{k % 3}") for k in range(300)]
    rows += [(1000 + k, " ".join(f"{w} ## $%" for w in prose(draw, 90).split()), "en", f"s{k % 3}") for k in range(20)]
    rows += [(2000 + k, "\n".join([prose(draw, 60)] + [prose(draw, 9)] * 4), "en", f"s{k % 3}") for k in range(20)]
    rows += [(3000, prose(draw, 80), "xx", "alone"), (3001, prose(draw, 80), "en", "rare")]
    kept = {r.doc_id for r in outliers.quality_rules(table(spark, rows)).filter("kept").collect()}
    assert {3000, 3001} <= kept
    assert len(kept & set(range(300))) >= 297 and not [k for k in kept if 1000 <= k < 3000]


def test_empty_and_wordless_tables(spark):
    assert outliers.quality_rules(table(spark, [])).count() == 0
    assert [tuple(r) for r in outliers.quality_rules(table(spark, [(1, None, None, None)])).collect()] == [(1, 0, 0, 0, 0, 0, True, None, False)]


def test_plan_is_native(spark):
    found = outliers.quality_rules(table(spark, [(1, "a b", "en", "s")]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
