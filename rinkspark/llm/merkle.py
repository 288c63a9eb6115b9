"""Merkle manifest of a dataset: a digest per row, a tree per group, one root, and a proof per row.

The rows of a group stand in one order and form superblocks of ``2 ** LEVELS`` leaves. Each
superblock is reduced to its top by itself; the tops form superblocks again, and so on to the root
of the group; the roots of the groups form one more tree. Coming back down, the nodes that a
superblock needs from outside, one list for all its leaves, are exchanged: leaves and outer nodes
are cogrouped by superblock, and one function finishes the reduction inside, joins the proofs and
folds them. A group of any size is spread over its superblocks; no task holds more than one.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinkspark.llm.common import numbered, staged
from rinkspark.llm.ordering import in_order

#: Levels of a superblock.
LEVELS = 11
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256 of the values in order: ``-`` for NULL, else the UTF-8 byte count, ``:`` and the value."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def reduced(nodes: list[str], n: int, block_levels: int) -> list[list[str]]:
    """All levels of a superblock of a group of ``n`` nodes, from its nodes to its top."""
    levels = [nodes]
    for _ in range(min(block_levels, (n - 1).bit_length())):
        last = levels[-1]
        levels.append([digest("".join(last[k : k + 2])) for k in range(0, len(last), 2)])
    return levels


def path_of(levels: list[list[str]], at: int) -> list[str]:
    """What node ``at`` meets level by level: ``<`` or ``>`` and the sibling on that side, empty without one."""
    path = []
    for nodes in levels[:-1]:
        beside = at ^ 1
        path.append(("<" if beside < at else ">") + nodes[beside] if beside < len(nodes) else "")
        at >>= 1
    return path


def fold(node: str, path: list[str]) -> str:
    """The root that follows from a node and its path."""
    for step in path:
        node = digest(step[1:] + node if step[:1] == "<" else node + step[1:])
    return node


def _blocks(nodes: DataFrame, block_levels: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("at", block_levels))


def _above(nodes: DataFrame, block_levels: int) -> DataFrame:
    """``key, at, path, root`` of every superblock ``at`` of ``nodes``: from its top to the root of its group."""

    def top(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        key, block, n = rows["key"].iloc[0], rows["block"].iloc[0], int(rows["n"].iloc[0])
        last = reduced(rows["digest"].tolist(), n, block_levels)[-1][0]
        return pd.DataFrame({"key": [key], "at": [block], "n": [((n - 1) >> block_levels) + 1], "digest": [last]})

    narrow = _blocks(nodes.select("key", "at", "n", "digest"), block_levels)
    tops = staged(narrow.groupBy("key", "block").applyInPandas(top, "key string, at long, n long, digest string"), "merkle-tops")
    if tops.filter("n > 1").isEmpty():
        return tops.select("key", "at", F.array().cast("array<string>").alias("path"), F.col("digest").alias("root"))
    return staged(_paths(tops, block_levels), "merkle-paths")


def _paths(nodes: DataFrame, block_levels: int) -> DataFrame:
    """``key, at, path, root`` of every node."""

    def join(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        levels = reduced(rows["digest"].tolist(), int(rows["n"].iloc[0]), block_levels)
        beyond, root = list(outer["path"].iloc[0]), outer["root"].iloc[0]
        paths = [path_of(levels, k) + beyond for k in range(len(rows))]
        return pd.DataFrame({"key": rows["key"].to_numpy(), "at": rows["at"].to_numpy(), "path": paths, "root": root})

    both = _blocks(nodes, block_levels).groupBy("key", "block").cogroup(_above(nodes, block_levels).groupBy("key", "at"))
    return both.applyInPandas(join, "key string, at long, path array<string>, root string")


def manifest(
    docs: DataFrame,
    columns: Sequence[str] = COLUMNS,
    id_col: str = "doc_id",
    group_col: str = "lang",
    found: dict[str, Column] | None = None,
    block_levels: int = LEVELS,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``leaf`` is the digest of ``columns``. Leaves of one ``group_col`` stand by ``id_col`` and are
    paired level by level up to ``subroot``, the last one alone where their number is odd; subroots
    stand by group, NULL first, and are paired likewise up to ``root``. ``proof_sha256`` is the digest
    of a leaf's siblings from the leaf upward, ``folded_root`` what leaf and siblings lead to.
    ``found`` gives columns as an audit finds them: where they differ, the leaf as found is folded
    with the recorded siblings, and ``verified`` is false.

    A NULL id stands first; rows of one id stand by their digest, so equal rows are neighbours with
    one leaf and each its own proof; a NULL group is a group. An empty table gives no rows; a single
    leaf is its own root. Other columns are not read. Runs jobs when called.
    """
    change = found or {}
    as_found = [change.get(c, F.col(c)) for c in columns]
    leaf = leaf_digest([F.col(c) for c in columns])
    group = F.col(group_col).cast("string")
    narrow = numbered(docs, "_row").select(
        F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("key"),
        F.col(id_col).alias("id"),
        leaf.alias("digest"),
        (leaf_digest(as_found) if change else leaf).alias("seen"),
        F.col("_row").alias("row"),
    )
    narrow = staged(narrow, "merkle-leaves")
    order = [F.col("key").asc(), F.col("id").asc_nulls_first(), F.col("digest").asc(), F.col("row").asc()]
    ordered = in_order(narrow, order, "number")
    groups = staged(ordered.groupBy("key").agg(F.min("number").alias("first"), F.count("*").alias("n")), "merkle-groups")
    leaves = ordered.join(groups, "key").select("key", "id", "digest", "seen", "n", (F.col("number") - F.col("first")).alias("at"))
    above = _above(leaves, block_levels)

    subroots = in_order(above.filter("at = 0").select("key", F.col("root").alias("digest")), [F.col("key").asc()], "at")
    nodes = subroots.select(F.lit("").alias("key"), "at", F.lit(subroots.rows).cast("long").alias("n"), "digest")
    tree = _paths(nodes, block_levels).select("at", F.col("path").alias("onward"), F.col("root").alias("whole"))
    onward = staged(tree.join(subroots.select("key", "at"), "at").drop("at"), "merkle-roots")
    outer = above.join(onward, "key").select(
        "key", "at", F.concat("path", "onward").alias("path"), F.col("root").alias("subroot"), F.col("whole").alias("root")
    )

    def finish(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        leaf, seen = rows["digest"].tolist(), rows["seen"].tolist()
        levels = reduced(leaf, int(rows["n"].iloc[0]), block_levels)
        beyond, subroot, root = list(outer["path"].iloc[0]), outer["subroot"].iloc[0], outer["root"].iloc[0]
        paths = [path_of(levels, k) + beyond for k in range(len(rows))]
        folded = [fold(node, path) for node, path in zip(seen, paths)]
        return pd.DataFrame(
            {
                "id": rows["id"].to_numpy(),
                "leaf": leaf,
                "subroot": subroot,
                "root": root,
                "proof_sha256": [digest("".join(step[1:] for step in path)) for path in paths],
                "folded_root": folded,
                "verified": [value == root for value in folded],
            }
        )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    done = _blocks(leaves, block_levels).groupBy("key", "block").cogroup(outer.groupBy("key", "at")).applyInPandas(finish, schema)
    return done.withColumnRenamed("id", id_col)
