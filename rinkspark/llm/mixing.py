"""Mixing sources to target weights by entropy balancing.

Targets are shares of all words, by source. The rates of documents that meet them and stay nearest,
in relative entropy, to taking each document once are exponential tilts of the size: rate =
min(most, exp(lambda * size / mean size)), one lambda per source. The dual is convex; Newton steps
kept inside a bracket solve it for all sources at once, each step one aggregation over the table
of distinct (source, size). Rates are then rounded to copies, with one offset per source chosen so
that the rounded words come near the target, and a few single copies per source close the gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rinkspark.llm.common import WORD, drop_staged, staged, text_of

#: Newton steps at most; candidates of the rounding offset per pass; passes.
STEPS, SECTIONS, PASSES = 60, 32, 5
#: Single copies added or removed per source at the end.
REPAIRS = 3
TOLERANCE = 1e-10


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Number of words by document; ``key`` tells a NULL source from all others."""
    source = F.col(source_col).cast("string")
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("key"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Per source: its size, and its share of all words by weight, at most ``most`` times its size.

    What a stopped source cannot take is shared again by weight among the others, until none is
    above. One row per source; this table alone is sorted as a whole, to deal the weights.
    """
    whole = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(whole) - 1) % len(weights) + 1).cast("int"))
    found = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    found = staged(found.withColumn("weight", weight.cast("double")), "mixing-sources")
    total = found.agg(F.sum("source_size")).first()[0] or 0
    stop, level = F.col("source_size") * F.lit(most), 0.0  # target = weight * level below the stop; the level only rises
    while True:
        stopped = F.col("weight") * level >= stop if level else F.lit(False)
        full, open_weight = found.agg(F.sum(F.when(stopped, stop)), F.sum(F.when(~stopped, F.col("weight")))).first()
        higher = (total - (full or 0)) / open_weight if open_weight else level
        if higher <= level:
            break
        level = higher
    return found.withColumn("target", F.least(F.col("weight") * level, stop.cast("double")))


def rate(most: int) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0))))


def solve(sizes: DataFrame, goals: DataFrame, most: int) -> DataFrame:
    """Adds ``mean`` and ``lam`` per source: Newton steps on the dual, halving where a step leaves its bracket."""
    counts = staged(sizes.filter("size > 0").groupBy("key", "size").agg(F.count("*").alias("n")), "mixing-counts")
    whole = counts.groupBy("key").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    spread = F.col("mean") / F.col("least")
    state = goals.join(whole, "key").select(
        *goals.columns,
        "mean",
        (F.log(F.col("target") / F.col("source_size")) * spread - 1e-9).alias("lo"),
        (F.log(F.lit(float(most))) * spread + 1e-9).alias("hi"),
        F.lit(0.0).alias("lam"),
        F.lit(None).cast("double").alias("off"),
    )
    state = staged(state.withColumn("lo", F.least("lo", F.lit(0.0))), "mixing-state")
    for _ in range(STEPS):
        words = F.col("n") * F.col("size")
        taken = counts.join(state, "key").groupBy("key").agg(
            F.sum(words * rate(most)).alias("got"),
            F.sum(F.when(rate(most) < most, words * F.col("size") / F.col("mean") * rate(most))).alias("slope"),
        )
        above = F.col("got") > F.col("target")
        moved = state.join(taken, "key").withColumns({"lo": F.when(above, F.col("lo")).otherwise(F.col("lam")), "hi": F.when(above, F.col("lam")).otherwise(F.col("hi"))})
        newton = F.col("lam") - (F.col("got") - F.col("target")) / F.col("slope")
        inside = (newton > F.col("lo")) & (newton < F.col("hi"))
        off = F.abs(F.col("got") - F.col("target")) / F.col("target")
        moved = moved.withColumn("off", off).withColumn(
            "lam", F.when(off <= TOLERANCE, F.col("lam")).when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        )
        after = staged(moved.select(*state.columns), "mixing-state")
        drop_staged(state)
        state = after
        if (state.agg(F.max(F.when(F.col("hi") - F.col("lo") > 1e-12, F.col("off")))).first()[0] or 0) <= TOLERANCE:
            break
    return state.select(*goals.columns, "mean", F.round("lam", 9).alias("lam"))


def copies(most: int, offset: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(most), F.floor(F.col("rate") + F.col("draw") + offset))).cast("long")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: ``id_col, size, source_size, target, copies, taken``.

    ``weights`` are dealt to the sources in the order of their code points, NULL last, repeating.
    ``taken`` = ``copies`` * ``size``. A document without words takes one copy of nothing; a NULL
    text has no words; a NULL source is a source of its own. Draws depend on the id alone, so equal
    rows take equally many copies and reruns agree. An empty table gives no rows. Runs jobs when called.
    """
    sizes = staged(sized(docs, id_col, text_col, source_col), "mixing-sizes")
    goals = targets(sizes, weights, most)
    state = solve(sizes, goals, most)
    draw = F.shiftrightunsigned(F.xxhash64("id"), 12) / F.lit(float(1 << 52))
    rated = staged(
        sizes.filter("size > 0").join(state.select("key", "target", "mean", "lam"), "key").select("key", "row", "size", "target", rate(most).alias("rate"), draw.alias("draw")),
        "mixing-rates",
    )
    bounds = staged(state.select("key", F.lit(-1.0).alias("lo"), F.lit(1.0).alias("hi")), "mixing-offsets")
    for last in [*[False] * PASSES, True]:
        # Words at each candidate offset; the words only rise with the offset.
        step = (F.col("hi") - F.col("lo")) / SECTIONS
        tried = rated.join(bounds, "key").groupBy("key").agg(
            F.first("target").alias("target"),
            F.first("lo").alias("lo"),
            F.first("hi").alias("hi"),
            F.array(*[F.sum(F.col("size") * copies(most, F.col("lo") + step * k)) for k in range(SECTIONS + 1)]).alias("words"),
        )
        if last:
            low = F.abs(F.col("words")[0] - F.col("target")) <= F.abs(F.col("words")[SECTIONS] - F.col("target"))
            after = tried.select("key", F.when(low, F.col("lo")).otherwise(F.col("hi")).alias("shift"))
        else:
            under = F.size(F.filter("words", lambda w: w <= F.col("target")))
            at = F.greatest(F.lit(0), F.least(F.lit(SECTIONS - 1), under - 1))
            after = tried.select("key", (F.col("lo") + step * at).alias("lo"), (F.col("lo") + step * (at + 1)).alias("hi"))
        after = staged(after, "mixing-offsets")
        drop_staged(bounds)
        bounds = after
    rated = staged(
        rated.join(bounds, "key").select("key", "row", "size", "target", "draw", copies(most, F.col("shift")).alias("copies")), "mixing-copies"
    )
    changed = staged(sizes.limit(0).select("row", F.lit(0).cast("long").alias("change")), "mixing-repairs")
    for _ in range(REPAIRS):
        # Per source: the copy whose size is nearest to what is still missing, or too much.
        now = rated.join(changed, "row", "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0)))
        gap = staged(now.groupBy("key").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap")), "mixing-gap")
        sign = F.signum("gap").cast("long")
        open_ = F.col("change").isNull() & (F.col("copies") + sign).between(0, most)
        left = F.abs(F.abs("gap") - F.col("size"))
        best = now.join(gap, "key").filter(open_ & (left < F.abs("gap"))).groupBy("key").agg(F.min(F.struct(left, "draw", "row", sign.alias("change"))).alias("b"))
        after = staged(changed.union(best.select("b.row", "b.change")), "mixing-repairs")
        drop_staged(changed)
        changed = after
    final = rated.join(changed, "row", "left").select("row", (F.col("copies") + F.coalesce("change", F.lit(0))).alias("copies"))
    found = sizes.join(goals.select("key", "source_size", "target"), "key", "left").join(final, "row", "left")
    found = found.withColumn("copies", F.coalesce("copies", F.lit(1).cast("long")))
    return found.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
