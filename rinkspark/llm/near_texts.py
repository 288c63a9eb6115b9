"""Near copies of texts: Jaccard similarity of their sets of 5-word shingles, verified for every link.

Candidates come from SimHash fingerprints of the sets, by operator 5's generalised pigeonhole probes. Few pairs of
similarity 0.8 differ in so few bits; what the probes cannot reach is found in two more ways.

Each distinct shingle set has ``BANDS`` keys of ``ROWS`` minima each: sets of similarity 0.8 share a
key with probability ``1 - (1 - 0.8**5)**12 = 0.99``. Inside a key, the first ``CENTRES`` sets, in an
order of the key's own, meet all others, so that a hot key costs in proportion to its members. SimHash
fingerprints of the sets drop most of the pairs that are far apart; the others are compared as sets.

A crowded key whose members that leaves in several groups may hide links between members that are no
centres. Its sets are joined exactly, by their rarest shingles: of two sets of similarity 0.8, in the
order of counts among such sets, the smaller has a common shingle in its first ninth, the larger in its
first fifth, and neither has too few shingles after the first common one for the overlap that 0.8 asks for.
A template that thousands of sets share stands behind their own words and pairs none of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rinkspark.llm.common import drop_staged, release, slices, staged, text_of, words
from rinkspark.llm.components import components
from rinkspark.llm.simhash import BITS, HASHES, SEED, links_within, shingles

WIDTH, BANDS, ROWS, CENTRES = 5, 12, 5, 8
#: Similarity as a fraction. Sets this similar differ in 10 bits of 64 on average, deviation 3: 24 keeps nearly all.
NUMERATOR, DENOMINATOR, RADIUS = 4, 5, 24
#: Bits in which fingerprints differ that the probes look for, as operator 5 does.
PROBED_BITS = 2
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = np.random.default_rng(SEED + 1).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles(words(text), width), repeat(SEED)), np.uint64))


def fingerprint(own: np.ndarray) -> int:
    """A bit is 1 if over half of the hashes set it, as a signed long."""
    ones = np.zeros(BITS, np.int64)
    for part in slices(len(own), HASHES):
        ones += np.unpackbits(own[part].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(own), bitorder="little").view("<i8")[0])


def band_keys(own: np.ndarray) -> list[int]:
    """One key per band from the minima of its rows; no keys for the empty set."""
    if not len(own):
        return []
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max)
    for part in slices(len(own), 1024):
        mixed = own[part, None] * FACTORS + SHIFTS
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, mixed.min(axis=0))
    return [xxhash.xxh64_intdigest(row.tobytes(), band) - (1 << 63) for band, row in enumerate(least.reshape(BANDS, ROWS))]


def similar(a: bytes, b: bytes) -> bool:
    left, right = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(left, right, assume_unique=True))
    return both * DENOMINATOR >= (len(left) + len(right) - both) * NUMERATOR


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar enough."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [similar(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(hit, pa.bool_()))

    one, two = sets.toDF("b", "set_b"), sets.toDF("a", "set_a")
    whole = pairs.join(one, "b").join(two, "a").select("a", "b", "set_a", "set_b")
    return whole.mapInArrow(kept, "a bigint, b bigint")


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, mark, n, fp, keys``: 128 bits that name the set, its size, its fingerprint, its band keys."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
            columns = [
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([fingerprint(s) for s in sets], pa.int64()),
                pa.array([band_keys(s) for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "mark", "n", "fp", "keys"])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return narrow.mapInArrow(found, "id bigint, mark binary, n bigint, fp bigint, keys array<bigint>")


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, own``: the shingle sets of the ids in ``wanted``."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], ["id", "own"])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return narrow.join(wanted, "id", "left_semi").mapInArrow(found, "id bigint, own binary")


def tokens_of(sets: DataFrame) -> DataFrame:
    """``id, n, token``: one row per shingle of the sets ``id, own``."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(o, np.int64) for o in batch.column(1).to_pylist()]
            columns = [pa.array([len(o) for o in own], pa.int64()), pa.array(own, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n", "tokens"])

    return sets.mapInArrow(found, "id bigint, n bigint, tokens array<bigint>").select("id", "n", F.explode("tokens").alias("token"))


def crowded(member: DataFrame, groups: DataFrame) -> DataFrame:
    """``id`` of the members of keys in which not all have met and that hold several groups (``node, component``)."""
    grouped = member.select("key", "id").join(groups, F.col("id") == F.col("node"), "left").withColumn("group", F.coalesce("component", "id"))
    found = grouped.groupBy("key").agg(F.count("*").alias("m"), F.min("group").alias("lo"), F.max("group").alias("hi"))
    return member.join(found.filter((F.col("m") > CENTRES + 1) & (F.col("lo") < F.col("hi"))), "key", "left_semi").select("id").distinct()


def candidates(tokens: DataFrame, nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of different groups that can be similar by the places of a shingle they share.

    ``tokens``: ``id, n, token``; every pair of similarity 0.8 whose fingerprints are near is among them.
    """
    counts = tokens.groupBy("token").agg(F.count("*").alias("df"))
    # Sets in the order of counts; a shingle of one set holds its place, but meets nothing.
    ranked = tokens.join(counts, "token").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("own"))
    first = F.expr(f"slice(own, 1, cast(floor(n * {DENOMINATOR - NUMERATOR} / {DENOMINATOR}) as int) + 1)")
    placed = ranked.select("id", "n", F.posexplode(first).alias("at", "t")).filter("t.df > 1").select("id", "n", "at", "t.token")
    known = nodes.select("id", "fp").join(groups, F.col("id") == F.col("node"), "left").select("id", "fp", F.coalesce("component", "id").alias("group"))
    placed = staged(placed.join(known, "id"), "copies-places")
    whole = NUMERATOR + DENOMINATOR
    small = placed.filter(F.col("at") * whole <= F.col("n") * (DENOMINATOR - NUMERATOR))
    small = small.select("token", *[F.col(c).alias(f"small_{c}") for c in ("id", "n", "at", "fp", "group")])
    sized = (F.col("small_n") <= F.col("n")) & (F.col("small_n") * DENOMINATOR >= F.col("n") * NUMERATOR) & (F.col("small_id") != F.col("id"))
    left = F.least(F.col("small_n") - F.col("small_at"), F.col("n") - F.col("at"))
    enough = left * whole >= (F.col("small_n") + F.col("n")) * NUMERATOR
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("small_fp"))) <= RADIUS
    met = small.join(placed, "token").filter(sized & enough & near & (F.col("small_group") != F.col("group")))
    return met.select(F.least("id", "small_id").alias("a"), F.greatest("id", "small_id").alias("b")).distinct()


def probed(nodes: DataFrame, most: int = PROBED_BITS) -> DataFrame:
    """Pairs ``a < b`` of ``nodes`` (``id, fp``) by operator 5's probes: fingerprints that differ in ``most`` bits at most.

    Of equal fingerprints the node of the least id meets the others, and stands for them.
    """
    least = staged(nodes.groupBy("fp").agg(F.min("id").alias("least")), "copies-prints")
    near = links_within(least.select("fp"), most)
    one, two = least.select(F.col("fp").alias("a"), F.col("least").alias("one")), least.select(F.col("fp").alias("b"), F.col("least").alias("two"))
    pairs = near.join(one, "a").join(two, "b").select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"))
    equal = nodes.select("id", "fp").join(least, "fp").filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    return pairs.union(equal)


def representatives(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """``id_col``: the smallest id of every group of near copies. Ids are unique longs.

    Texts with equal shingle sets are one node, linked nodes (similarity at least 0.8) one group; NULL
    texts and texts without words are equal. Texts of fewer than five words are one shingle. Groups do not depend
    on which of several equal texts is read first, and the smallest id stands for them. Long texts are read whole;
    an empty table gives no rows; other columns are not read. Runs jobs when called.
    """
    marks = sketched(docs, id_col, text_col)
    nodes = staged(marks.groupBy("mark").agg(F.min(F.struct("id", "n", "fp", "keys")).alias("first")).select("first.*"), "copies-nodes")
    # Bands are salted in their keys; the order of a key's members is its own, so centres differ by band.
    member = nodes.select(F.explode("keys").alias("key"), "id", "n", "fp").withColumn("turn", F.xxhash64("key", "id"))
    best = Window.partitionBy("key").orderBy("turn", "id")
    centre = member.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= CENTRES)
    centre = staged(centre.select("key", "rank", F.col("id").alias("c"), F.col("n").alias("cn"), F.col("fp").alias("cfp")), "copies-centres")
    sized = F.least("n", "cn") * DENOMINATOR >= F.greatest("n", "cn") * NUMERATOR
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("cfp"))) <= RADIUS

    def met(with_centres: DataFrame) -> DataFrame:
        found = member.join(with_centres, "key").filter((F.col("id") != F.col("c")) & sized & near)
        return found.select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b"))

    def kept(pairs: DataFrame) -> DataFrame:
        pairs = staged(pairs.distinct(), "copies-pairs")
        ends = pairs.select("a").distinct().union(pairs.select("b").distinct()).toDF("id").distinct()
        sets = staged(sets_of(docs, ends, id_col, text_col), "copies-sets")
        links = staged(verified(pairs, sets), "copies-links")
        drop_staged(pairs)
        drop_staged(sets)
        release(docs.sparkSession)
        return links

    def apart(pairs: DataFrame, group: DataFrame) -> DataFrame:
        """The pairs whose ends are not yet in one group."""
        of = [group.select(F.col("node").alias(end), F.col("component").alias(f"group_{end}")) for end in "ab"]
        open_pairs = pairs.join(of[0], "a", "left").join(of[1], "b", "left")
        return open_pairs.filter(F.coalesce("group_a", "a") != F.coalesce("group_b", "b")).select("a", "b")

    # First what the fingerprints' probes find; of the pairs with first centres, then with others, those still apart.
    links = kept(probed(nodes))
    for step in (centre.filter("rank = 1"), centre.filter("rank > 1")):
        group = staged(components(links), "copies-groups")
        links = staged(links.union(kept(apart(met(step), group))), "copies-links")
    group = staged(components(links), "copies-groups")
    # Then what the centres of crowded keys cannot see.
    tokens = tokens_of(staged(sets_of(docs, crowded(member, group), id_col, text_col), "copies-crowded"))
    more = kept(candidates(tokens, nodes, group))
    group = staged(components(links.union(more)), "copies-groups")
    gone = group.filter("node <> component").select(F.col("node").alias("id"))
    return nodes.select("id").join(gone, "id", "left_anti").select(F.col("id").alias(id_col))
