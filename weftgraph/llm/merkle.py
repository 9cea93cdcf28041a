"""A Merkle manifest of a table: leaves, subtree roots, proofs, and what they say of a changed copy.

1. Each row becomes a leaf, and a number by order in its group: rows are dealt to ranges,
   and the counts of the ranges are offsets, so a group with most of the rows is many tasks.
2. Upwards: 2**LEVELS consecutive nodes of a group are a superblock. Each is reduced to one
   node, these again by superblock, until a group has one node left, its subroot. The
   subroots, in order, are one more group, with the root at its end.
3. Downwards: the nodes of a superblock and the outer nodes that their proofs need, those
   above the superblock, are cogrouped. One function reduces the superblock, joins its own
   siblings with the outer ones, and folds each changed leaf along them.

A round of superblocks takes away LEVELS levels, so there are few rounds, however many rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import dropped, written

LEVELS = 12


def encoded(value: Column) -> Column:
    """``-`` if null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf has by its proof: steps ``L`` or ``R`` and the sibling's digest, or an empty one for a node that stands alone."""

    def up(node: Column, step: Column) -> Column:
        side, other = F.substring(step, 1, 1), F.substring(step, 2, 64)
        return F.sha2(F.when(side == "L", F.concat(other, node)).otherwise(F.concat(node, other)), 256)

    return F.aggregate(proof, leaf, up)


def _digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _levels(nodes: list[str], total: int, height: int) -> list[list[str]]:
    """The levels of a superblock from its nodes to its top; ``total``: the nodes of its group."""
    out = [nodes]
    for _ in range(height if total > 1 << height else (total - 1).bit_length()):
        last = out[-1]
        out.append([_digest("".join(last[k : k + 2])) for k in range(0, len(last), 2)])
    return out


def _siblings(levels: list[list[str]], at: int) -> list[str]:
    """Steps of the proof of node ``at`` up to the top of its superblock."""
    out = []
    for level in levels[:-1]:
        other = at ^ 1
        out.append(("R" if other > at else "L") + level[other] if other < len(level) else "")
        at >>= 1
    return out


def _fold(node: str, steps: list[str]) -> str:
    for step in steps:
        node = _digest(step[1:] + node if step.startswith("L") else node + step[1:])
    return node


def _topper(height: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def top(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        total = int(rows["n"].iloc[0])
        digest = _levels(rows["digest"].tolist(), total, height)[-1][0]
        return pd.DataFrame({"grp": rows["grp"].iloc[:1].tolist(), "pos": [int(rows["block"].iloc[0])], "digest": [digest], "n": [-(-total // (1 << height))]})

    return top


def _opened(nodes: pd.DataFrame, outer: pd.DataFrame, height: int) -> tuple[pd.DataFrame, list[list[str]], pd.Series]:
    """The nodes in order, the levels of their superblock, and what its outer row says."""
    nodes = nodes.sort_values("pos").reset_index(drop=True)
    return nodes, _levels(nodes["digest"].tolist(), int(nodes["n"].iloc[0]), height), outer.iloc[0]


def _passer(height: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def pass_down(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        """The outer nodes of each node, which is itself the top of a superblock one round below."""
        nodes, levels, above = _opened(nodes, outer, height)
        paths = [_siblings(levels, k) + list(above["path"]) for k in range(len(nodes))]
        return pd.DataFrame({"grp": nodes["grp"], "block": nodes["pos"], "path": paths, "subroot": above["subroot"], "root": above["root"]})

    return pass_down


def _finisher(height: int, proofs: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def finish(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes, levels, above = _opened(nodes, outer, height)
        path, beyond = list(above["path"]), {}
        out: dict[str, list] = {"proof_sha256": [], "folded_root": [], "proof": []}
        for k, (leaf, changed) in enumerate(zip(nodes["digest"], nodes["changed"], strict=True)):
            own = _siblings(levels, k)
            top = _fold(changed or leaf, own)
            if top not in beyond:  # most leaves of a superblock meet the same outer nodes with the same top
                beyond[top] = _fold(top, path)
            out["proof_sha256"].append(_digest("".join(s[1:] for s in (*own, *path))))
            out["folded_root"].append(beyond[top])
            if proofs:
                out["proof"].append([*own, *path])
        return pd.DataFrame({"row_key": nodes["row_key"], "leaf": nodes["digest"], "subroot": above["subroot"], "root": above["root"]} | {c: v for c, v in out.items() if proofs or c != "proof"})

    return finish


def _numbered(nodes: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``nodes`` with pos, the number from 0 by ``order`` within grp, and n, the nodes of grp.

    Rows that tie in all of ``order`` are told apart by their place in a written table, so
    that a lost task deals them as before.
    """
    first = written(nodes)
    ranged = first.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("grp", *order, "tie").sortWithinPartitions("grp", *order, "tie")
    rows = written(ranged.drop("tie").withColumn("at", F.monotonically_increasing_id()))
    dropped(first)
    part = F.shiftrightunsigned("at", 33)  # the number of the partition
    parts = rows.groupBy("grp", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("held"))
    group = Window.partitionBy("grp")
    before = F.coalesce(F.sum("held").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("grp", "part", "first", before.alias("before"), F.sum("held").over(group).alias("n"))
    placed = rows.withColumn("part", part).join(parts, ["grp", "part"])
    out = written(placed.withColumn("pos", F.col("before") + F.col("at") - F.col("first")).drop("part", "first", "before", "at"))
    dropped(rows)
    return out


def _by_block(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", height))


def _rounds(nodes: DataFrame, height: int) -> Iterator[tuple[DataFrame, DataFrame]]:
    """The nodes of each round, and the tops of their superblocks."""
    while True:
        tops = written(_by_block(nodes.select("grp", "pos", "digest", "n"), height).groupBy("grp", "block").applyInPandas(_topper(height), "grp string, pos long, digest string, n long"))
        yield nodes, tops
        nodes = tops.where("n > 1")
        if nodes.isEmpty():
            return


_OUTER = "grp string, block long, path array<string>, subroot string, root string"


def _outer(rounds: list[tuple[DataFrame, DataFrame]], ends: DataFrame, height: int) -> DataFrame:
    """The outer nodes of each superblock of the first round (grp, block, path, subroot, root); ``ends``: those of each group."""

    def ending(tops: DataFrame) -> DataFrame:
        return ends.join(tops.where("n = 1").select("grp"), "grp", "left_semi").select("grp", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")

    out = ending(rounds[-1][1])
    for (_, below), (nodes, _) in zip(rounds[-2::-1], rounds[:0:-1], strict=True):
        carried = _by_block(nodes, height).groupBy("grp", "block").cogroup(out.groupBy("grp", "block")).applyInPandas(_passer(height), _OUTER)
        out = written(carried.unionByName(ending(below)))
    return out


def manifest(docs: DataFrame, *, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), by: str = "lang", order: str = "doc_id", changed: dict[str, Column] | None = None, proofs: bool = True, levels: int = LEVELS) -> DataFrame:
    """A row for each row of ``docs``: ``order``, leaf, subroot, root, proof_sha256, folded_root, verified and, with ``proofs``, proof.

    H is the lowercase hex SHA-256 of its inputs one after the other, digests as hex text. A
    leaf is H of ``columns``, each ``-`` if null, else its UTF-8 byte count, a colon and its
    value. The leaves of each value of ``by`` ascend by ``order`` (null first, then by leaf);
    every two consecutive nodes, or one at the end, become their H until one is left, the
    subroot. The subroots by ``by`` (null first, then by UTF-8 bytes) give the root likewise.
    proof holds the siblings up to the root for ``fold``; proof_sha256 is H of them.

    ``changed`` has new values for columns of a copy whose rows are checked against this
    manifest: folded_root is what the changed row's leaf gives along the proof, verified
    whether that is the root. Null or repeated ids and rows get a leaf each; an empty table
    gives no rows; other columns are not read.
    """
    changed = changed or {}
    own = [F.col(c) for c in columns]
    copy = [changed.get(c, F.col(c)) for c in columns]
    differs = F.lit(False)
    for c in changed:
        differs = differs | ~changed[c].eqNullSafe(F.col(c))
    leaves = docs.select(F.col(order).alias("row_key"), encoded(F.col(by)).alias("grp"), leaf_digest(*own).alias("digest"), F.when(differs, leaf_digest(*copy)).alias("changed"))
    nodes = _numbered(leaves, ["row_key", "digest"])
    rounds = list(_rounds(nodes, levels))
    ends = rounds[0][1].where("n = 1")
    for _, tops in rounds[1:]:
        ends = ends.unionByName(tops.where("n = 1"))
    # subroots are ordered by the value itself, which follows the colon
    value = F.when(F.col("name") != "-", F.expr("substr(name, instr(name, ':') + 1)"))
    subroots = _numbered(ends.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest").withColumn("value", value), ["value"])
    above = list(_rounds(subroots, levels))
    top = above[-1][1].where("n = 1").select(F.lit("").alias("grp"), F.array().cast("array<string>").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    outer = _outer(above, top, levels)
    named = _by_block(subroots, levels).groupBy("grp", "block").cogroup(outer.groupBy("grp", "block")).applyInPandas(_passer(levels), _OUTER)
    ends = written(named.withColumnRenamed("block", "pos").drop("grp").join(subroots.select("pos", "name", "digest"), "pos").select(F.col("name").alias("grp"), "path", F.col("digest").alias("subroot"), "root"))
    outer = _outer(rounds, ends, levels)
    kind = leaves.schema["row_key"].dataType
    schema = "row_key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + (", proof array<string>" if proofs else "")
    # keys go as text: pandas would make doubles of a column of integers that has a null
    keyed = _by_block(nodes, levels).withColumn("row_key", F.col("row_key").cast("string"))
    found = keyed.groupBy("grp", "block").cogroup(outer.groupBy("grp", "block")).applyInPandas(_finisher(levels, proofs), schema)
    dropped(*(tops for _, tops in above))
    return found.withColumn("row_key", F.col("row_key").cast(kind)).withColumnRenamed("row_key", order).withColumn("verified", F.col("folded_root") == F.col("root"))
