"""Quality rules by robust multivariate outliers, in DataFrame functions alone.

Each document gives five statistics, transformed so that usual documents lie in one cloud. Per language
and source the minimum-covariance-determinant estimate is the mean and covariance of the subset of
``SHARE`` of the documents whose covariance has the least determinant. C-steps find it: distances
from the estimate, the nearest documents, their moments, and again, from two starts, the lower
determinant wins. A step is two aggregations: counts by distance class, from the nearest class
outward until the share is full, and the moments of those classes; a group of any size costs no more.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rinkspark.llm.common import drop_staged, release, staged, text_of

BLANKS = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Fewer words, or a larger share (percent) of words in repeated windows, fail without an estimate.
MIN_WORDS, MAX_REPEATED, WINDOW = 50, 50, 3

#: Transformed statistics, each with the spread that counts as usual however alike a group is.
TOLERANCE = {"log_words": 0.3, "log_word_size": 0.06, "symbols": 0.05, "dup_lines": 0.2, "repeats": 0.12}
STATS = list(TOLERANCE)
P = len(STATS)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
#: Share of the subset; weight of a group's language beside its own documents; kept probability of a usual document.
SHARE, PRIOR, USUAL = 0.75, 30, 0.999
STEPS, CLASSES = 12, 64
DIGITS = 9


def statistics(text: Column) -> list[dict[str, Column]]:
    """Columns in the order in which they build on each other; every array is a column, so it is made once."""
    hash_of = lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2))
    beside = lambda k: F.get("_sorted", k).getField("h")
    repeats = lambda h, other: F.coalesce(h == other, F.lit(False))
    grown = F.aggregate(
        F.sort_array(F.transform("_found", lambda x: x["i"])),
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("total")),
        lambda acc, i: F.struct(i.alias("last"), (acc["total"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("total")),
        lambda acc: acc["total"],
    )
    return [
        {"_text": text},
        {"_core": F.btrim("_text", F.lit(BLANKS))},
        {
            "_words": F.when(F.col("_core") == "", F.array().cast("array<string>")).otherwise(F.split("_core", SPACES)),
            "_lines": F.filter(F.split("_text", "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != ""),
            "word_chars": F.length(F.translate("_text", BLANKS, "")).cast("long"),
            "n_symbols": (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"),
        },
        {
            "n_words": F.size("_words").cast("long"),
            "_n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_windows": F.slice(F.transform("_words", hash_of), F.lit(1), F.greatest(F.size("_words") - (WINDOW - 1), F.lit(0))),
        },
        # windows in the order of their hashes, where any repeats at all
        {"_sorted": F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))},
        {"_found": F.filter("_sorted", lambda x, k: repeats(x["h"], F.when(k > 0, beside(k - 1))) | repeats(x["h"], beside(k + 1)))},
        {"n_repeat_words": F.coalesce(grown, F.lit(0).cast("long"))},
    ]


def vectors() -> dict[str, Column]:
    words = F.col("n_words")
    share = lambda part, whole: F.sqrt(F.least(F.lit(1.0), part / F.greatest(whole, F.lit(1))))
    found = {
        "log_words": F.log1p(words),
        "log_word_size": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(words, F.lit(1))),
        "symbols": share(F.col("n_symbols"), F.col("word_chars")),
        "dup_lines": share(F.col("n_dup_lines"), F.col("_n_lines") + 20),
        "repeats": share(F.col("n_repeat_words"), words),
    }
    return {name: F.round(c, DIGITS) for name, c in found.items()}


def gamma_share(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series."""
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a))


def chi2_quantile(share: float, freedom: int) -> float:
    low, high = 0.0, 10.0 * freedom + 100
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if gamma_share(freedom / 2, middle / 2) < share else (low, middle)
    return high


def with_factor(estimates: DataFrame) -> DataFrame:
    """Adds ``w_ij``, the rows of the inverse Cholesky factor of ``s_ij``, and ``log_det``. One row per group."""
    found = estimates
    for j in range(P):  # one column of the factor at a time: expressions stay short
        inner = sum((F.col(f"l_{j}{k}") * F.col(f"l_{j}{k}") for k in range(j)), F.lit(0.0))
        found = found.withColumn(f"l_{j}{j}", F.sqrt(F.greatest(F.col(f"s_{j}{j}") - inner, F.lit(1e-12))))
        rest = {}
        for i in range(j + 1, P):
            inner = sum((F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}") for k in range(j)), F.lit(0.0))
            rest[f"l_{i}{j}"] = (F.col(f"s_{i}{j}") - inner) / F.col(f"l_{j}{j}")
        found = found.withColumns(rest) if rest else found
    for d in range(P):  # by distance from the diagonal
        found = found.withColumns(
            {
                f"w_{i}{i - d}": F.lit(1.0) / F.col(f"l_{i}{i}")
                if d == 0
                else -sum((F.col(f"l_{i}{k}") * F.col(f"w_{k}{i - d}") for k in range(i - d, i)), F.lit(0.0)) / F.col(f"l_{i}{i}")
                for i in range(d, P)
            }
        )
    return found.withColumn("log_det", F.round(2 * sum((F.log(f"l_{i}{i}") for i in range(P)), F.lit(0.0)), DIGITS)).drop(*[f"l_{i}{j}" for i, j in PAIRS])


def distance() -> Column:
    """Squared Mahalanobis distance of the statistics from the estimate beside them."""
    away = [F.col(name) - F.col(f"m_{i}") for i, name in enumerate(STATS)]
    rows = [sum((F.col(f"w_{i}{j}") * away[j] for j in range(i + 1)), F.lit(0.0)) for i in range(P)]
    return sum((r * r for r in rows), F.lit(0.0))


def medians(values: DataFrame) -> DataFrame:
    """Median of ``value`` by ``key, stat``, exact: equal values are counted first, ``value`` being rounded to a grid."""
    counts = values.groupBy("key", "stat", "value").agg(F.count("*").alias("n"))
    group = Window.partitionBy("key", "stat")
    upto = F.sum("n").over(group.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = counts.select("key", "stat", "value", upto.alias("upto"), F.sum("n").over(group).alias("of"))
    return counts.filter(F.col("upto") * 2 >= F.col("of")).groupBy("key", "stat").agg(F.min("value").alias("median"))


def _tolerated(i: int, j: int) -> Column:
    return F.lit(TOLERANCE[STATS[i]] ** 2 if i == j else 0.0)


def starts(points: DataFrame) -> DataFrame:
    """Two estimates per key about the medians: independent spreads, and spreads with the correlation of squashed statistics."""
    grid = F.inline(F.array(*[F.struct(F.lit(i).alias("stat"), F.round(name, 3).alias("value")) for i, name in enumerate(STATS)]))
    values = points.select("key", grid)
    centre = staged(medians(values), "outlier-medians")
    off = values.join(centre, ["key", "stat"]).select("key", "stat", F.round(F.abs(F.col("value") - F.col("median")), 3).alias("value"))
    spread = medians(off).withColumnRenamed("median", "spread")
    both = centre.join(spread, ["key", "stat"])
    at = lambda c, i: F.max(F.when(F.col("stat") == i, F.col(c)))
    usual = [F.sqrt(F.pow(at("spread", i) * 1.4826, F.lit(2)) + _tolerated(i, i)) for i in range(P)]
    wide = both.groupBy("key").agg(*[at("median", i).alias(f"m_{i}") for i in range(P)], *[u.alias(f"d_{i}") for i, u in enumerate(usual)])
    wide = staged(wide, "outlier-centres")
    squashed = points.join(wide, "key").select("key", *[F.tanh((F.col(name) - F.col(f"m_{i}")) / F.col(f"d_{i}")).alias(f"y_{i}") for i, name in enumerate(STATS)])
    crossed = squashed.groupBy("key").agg(*[F.sum(F.col(f"y_{i}") * F.col(f"y_{j}")).alias(f"c_{i}{j}") for i, j in PAIRS])
    # the small term keeps a correlation of constants zero, and all others below one
    norm = lambda i, j: F.sqrt((F.col(f"c_{i}{i}") + 1e-3) * (F.col(f"c_{j}{j}") + 1e-3))
    scale = lambda i, j: F.col(f"d_{i}") * F.col(f"d_{j}")
    centres = [f"m_{i}" for i in range(P)]
    plain = wide.select("key", F.lit(0).alias("start"), *centres, *[(scale(i, j) if i == j else F.lit(0.0)).alias(f"s_{i}{j}") for i, j in PAIRS])
    bent = wide.join(crossed, "key").select(
        "key", F.lit(1).alias("start"), *centres, *[(scale(i, j) if i == j else scale(i, j) * F.col(f"c_{i}{j}") / norm(i, j)).alias(f"s_{i}{j}") for i, j in PAIRS]
    )
    return plain.unionByName(bent)


def step(points: DataFrame, estimates: DataFrame, factor: float) -> DataFrame:
    """Moments of the nearest ``SHARE`` of each key's points, distances taken in classes, as the next estimates.

    The points are read twice, so that only counts travel by class, and sums by key.
    """
    near = F.ceil(F.log(distance() + 1e-6) * CLASSES)
    classes = points.join(estimates, "key").groupBy("key", "start", near.alias("near")).agg(F.count("*").alias("n"))
    group = Window.partitionBy("key", "start")
    before = F.coalesce(F.sum("n").over(group.orderBy("near").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = classes.withColumns({"before": before, "of": F.sum("n").over(group)}).filter(F.col("before") < F.ceil(F.col("of") * SHARE))
    limits = staged(inside.groupBy("key", "start").agg(F.max("near").alias("limit")), "outlier-limits")
    placed = points.join(estimates.join(limits, ["key", "start"]), "key").filter(near <= F.col("limit"))
    placed = placed.select("key", "start", *[(F.col(name) - F.col(f"m_{i}")).alias(f"a_{i}") for i, name in enumerate(STATS)])
    sums = {f"x_{i}": F.sum(f"a_{i}") for i in range(P)} | {f"p_{i}{j}": F.sum(F.col(f"a_{i}") * F.col(f"a_{j}")) for i, j in PAIRS}
    total = placed.groupBy("key", "start").agg(F.count("*").alias("h"), *[v.alias(k) for k, v in sums.items()])
    mean = lambda i: F.col(f"x_{i}") / F.col("h")
    spread = lambda i, j: (F.col(f"p_{i}{j}") / F.col("h") - mean(i) * mean(j)) * factor + _tolerated(i, j)
    moved = total.join(estimates.select("key", "start", *[f"m_{i}" for i in range(P)]), ["key", "start"])
    return moved.select(
        "key", "start", "h", *[F.round(F.col(f"m_{i}") + mean(i), DIGITS).alias(f"m_{i}") for i in range(P)],
        *[F.round(spread(i, j), 12).alias(f"s_{i}{j}") for i, j in PAIRS],
    )


def estimate(points: DataFrame) -> DataFrame:
    """``key, h, m_i, s_ij``: the regularised minimum-covariance-determinant estimate of each key's points.

    A step that does not lower the determinant of a key is not taken; steps end when no key's falls by a hundredth.
    """
    factor = SHARE / gamma_share(P / 2 + 1, chi2_quantile(SHARE, P) / 2)
    names = ["h", *[f"m_{i}" for i in range(P)], *[f"s_{i}{j}" for i, j in PAIRS], *[f"w_{i}{j}" for i, j in PAIRS], "log_det"]
    # the starts are no subsets: any subset is better
    now = staged(with_factor(starts(points)).withColumns({"h": F.lit(0).cast("long"), "log_det": F.lit(float("inf"))}), "outlier-step")
    for _ in range(STEPS):
        both = with_factor(step(points, now, factor)).select(now.columns).unionByName(now.select(now.columns))
        both = both.withColumn("order", F.struct("log_det", "h"))  # an equal one stays
        after = staged(both.groupBy("key", "start").agg(F.min_by(F.struct(*names), "order").alias("e")).select("key", "start", "e.*"), "outlier-step")
        was = now.select("key", "start", F.col("log_det").alias("was"))
        still = after.join(was, ["key", "start"]).filter(F.col("was") - F.col("log_det") > 0.01).isEmpty()
        drop_staged(now)
        now = after
        release(points.sparkSession)  # of the step's shuffles
        if still:
            break
    names = ["h", *[f"m_{i}" for i in range(P)], *[f"s_{i}{j}" for i, j in PAIRS]]
    return now.groupBy("key").agg(F.min_by(F.struct(*names), F.struct("log_det", "start")).alias("e")).select("key", "e.*")


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    usual: float = USUAL,
) -> DataFrame:
    """One row per document: ``id_col``, its counts, ``base_failed``, ``distance``, ``kept``.

    ``base_failed``: under 50 words, or over half of them in windows of three words that the text holds
    twice (windows are compared by 64-bit hashes). Of the others those are kept whose squared
    Mahalanobis distance from the estimate of their language and source is within the ``usual`` quantile
    of its distribution. An estimate leans on the one of its language with the weight of ``PRIOR``
    documents, so a small source is judged much like its language, and a lone document by its own.

    A NULL text has no words and fails; a NULL language or source is a value of its own; ids are
    only carried along, NULL and repeated ones too, and equal rows get equal verdicts. An empty table
    gives no rows. A document's words are held by one task as an array. Runs jobs when called.
    """
    mark = lambda c: F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    lang, source = mark(lang_col), mark(source_col)
    found = docs.select(F.col(id_col).alias("_id"), lang.alias("_lang"), F.concat(lang, F.lit("|"), source).alias("_group"), text_of(text_col).alias("_text"))
    for columns in statistics(F.col("_text")):
        found = found.withColumns(columns)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)
    facts = staged(found.select("_id", "_lang", "_group", *counts, failed.alias("base_failed"), *[c.alias(k) for k, c in vectors().items()]), "outlier-facts")

    keys = F.explode(F.array(F.col("_lang"), F.col("_group"))).alias("key")
    points = staged(facts.filter("NOT base_failed").select(keys, *STATS), "outlier-points")
    found = staged(estimate(points), "outlier-estimates")
    own = facts.filter("NOT base_failed").select(F.col("_group").alias("key"), F.col("_lang").alias("wide")).distinct()
    wide = found.select(F.col("key").alias("wide"), *[F.col(c).alias(f"l{c}") for c in found.columns if c not in ("key", "h")])
    weight = F.col("h") / (F.col("h") + PRIOR)
    blend = [F.round(F.col(c) * weight + F.col(f"l{c}") * (1 - weight), 12).alias(c) for c in found.columns if c not in ("key", "h")]
    judged = staged(with_factor(found.join(own, "key").join(wide, "wide").select(F.col("key").alias("_group"), *blend)), "outlier-groups")
    verdict = facts.join(judged, "_group", "left").withColumn("distance", F.when(~F.col("base_failed"), F.round(distance(), 6)))
    kept = ~F.col("base_failed") & (F.col("distance") <= chi2_quantile(usual, P))
    return verdict.select(F.col("_id").alias(id_col), *counts, "base_failed", "distance", F.coalesce(kept, F.lit(False)).alias("kept"))
