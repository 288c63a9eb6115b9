import random
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from rinkspark.llm import merkle
from rinkspark.llm.queries import op12_changes


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climbed(nodes, at):
    """Root and siblings of one node, from the definition."""
    siblings = []
    while len(nodes) > 1:
        start = at - at % 2
        run = nodes[start : start + 2]
        siblings += [(at % 2 == 1, x) for k, x in enumerate(run) if start + k != at] or [None]
        nodes = [h(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
        at //= 2
    return nodes[0], siblings


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    leaves = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        leaves[g] = [leaf_of(r) for r in groups[g]]
    subroots = [climbed(leaves[g], 0)[0] for g in names]
    out = []
    for place, g in enumerate(names):
        for at, row in enumerate(groups[g]):
            subroot, low = climbed(leaves[g], at)
            root, high = climbed(subroots, place)
            siblings = low + high
            seen = list(row)
            if row[0] is not None and crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
                seen[3] += 1
            node = leaf_of(seen)
            for s in siblings:
                node = h(node) if s is None else h(s[1], node) if s[0] else h(node, s[1])
            proof = h(*[s[1] for s in siblings if s])
            out.append((row[0], leaves[g][at], subroot, root, proof, node, node == root))
    return sorted(out, key=str)


def table(spark, rows):
    # names of the operator's own columns as further columns
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    return docs.selectExpr("*", "1 AS key", "2 AS at", "3 AS path", "4 AS root", "5 AS digest", "6 AS _row")


@pytest.mark.parametrize("levels,n", [(2, 150), (3, 64), (11, 90), (11, 1)])
def test_equals_the_definition(spark, levels, n):
    draw = random.Random(n)
    rows = [(k * 3, f"s{k % 4}", draw.choice(["en", "en", "de", "", "é", None]), draw.randint(0, 99), "tëxt " * (k % 5)) for k in range(n)]
    rows += [] if n < 2 else [(9, "s", "en", 4, "copy")] * 6 + [(None, None, None, None, None)] * 3 + [(9, "s", "en", None, ""), (10**12, "s", "de", 7, "x" * 300_000)]
    got = merkle.manifest(table(spark, rows), found=op12_changes(), block_levels=levels)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_without_changes_every_row_verifies(spark):
    rows = [(k, "s", f"l{k % 40}", k, None) for k in range(300)]
    got = merkle.manifest(table(spark, rows))
    assert got.filter("verified AND folded_root = root").count() == 300
    assert got.select("root").distinct().count() == 1


def test_one_group_over_many_superblocks(spark):
    rows = [(k, "s", "en", k, "t") for k in range(700)]
    got = merkle.manifest(table(spark, rows), found={"text": F.when(F.col("doc_id") == 300, F.lit("u")).otherwise(F.col("text"))}, block_levels=4)
    assert [r.doc_id for r in got.filter("NOT verified").collect()] == [300]


def test_empty_table(spark):
    assert merkle.manifest(table(spark, []), found=op12_changes()).count() == 0
