"""SimHash near-duplicates: all fingerprints within a few bits of each other, by a hierarchical index in Gray order.

1. One pass makes each text's fingerprint; equal ones are one node from there on.
2. Fingerprints are dealt to groups in which all links can be found: a group that is too
   large for one task is dealt to distance + 1 new ones for each member, by the values of
   disjoint sets of bits. Two fingerprints within the distance agree in one of the sets, so
   they meet there. The sets are made of the bits that split the group best, and of as
   many as its size asks for; groups that are still too large are dealt again.
3. In a group fingerprints are sorted by Gray rank. FAN consecutive ones are a node that
   holds the bits all of them share, FAN of these are one node above, and so on; a node
   keeps only the bits that its parent lacks. A search goes down from the top, adds up the
   differences in the bits of each node, and drops a node with all below it once they are
   more than the distance. A node all of whose members are near enough, whatever their other
   bits, is taken whole; one that is linked with the searched fingerprint already is passed.
4. Only a spanning forest of the links leaves a group; components of these are the result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .links import components
from .near import _forest
from .tables import dropped, written
from .words import LOWER, Words, map_blocks

FAN = 8
#: Groups of up to so many fingerprints are searched in one task.
GROUP = 8192
#: So many fingerprints at a time are searched for.
SEARCHED = 512
#: So often groups that are too large are dealt again; one that is too large even then is searched as it is.
ROUNDS = 8
_ALL = ~np.uint64(0)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of each text's n-word shingles, words lower-cased and joined by one space, and the bounds of each text's.

    A text with fewer words has one shingle, the whole sequence.
    """
    words = Words(LOWER[data], offsets)
    size = words.last - words.first
    ends = np.cumsum(size + 1)
    spaced = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    begins = ends - size - 1
    # the bytes of all words, each word's moved to where it begins in ``spaced``
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    spaced[np.repeat(begins, size) + at] = words.data[np.repeat(words.first, size) + at]
    held = np.diff(words.bounds)
    made = np.where(held >= n, held - n + 1, np.minimum(held, 1))
    bounds = np.concatenate(([0], np.cumsum(made)))
    text = np.repeat(np.arange(len(made)), made)
    first = words.bounds[text] + np.arange(len(text)) - bounds[text]
    last = first + np.minimum(n, held[text]) - 1
    whole, hashed = spaced.tobytes(), xxhash.xxh64_intdigest
    out = [hashed(whole[a:b], 42) for a, b in zip(begins[first].tolist(), (ends[last] - 1).tolist(), strict=True)]
    return np.array(out, np.uint64), bounds


def fingerprints_of(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text the bits that are set in over half of its hashes; 0 without hashes."""
    out, full = np.zeros(len(bounds) - 1, np.uint64), np.flatnonzero(np.diff(bounds))
    if len(full):
        starts, held = bounds[full], np.diff(bounds)[full]
        for k in range(64):
            bits = (hashes >> np.uint64(k)) & np.uint64(1)
            out[full] |= (2 * np.add.reduceat(bits.astype(np.int64), starts) > held).astype(np.uint64) << np.uint64(k)
    return out


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the order of the reflected Gray code."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """Distinct 64-bit codes in Gray order below a tree of shared bits.

    Level 0 are the codes. A node of level k covers FAN**k consecutive codes: ``mask`` are the
    bits they share and its parent's members don't, ``pattern`` their values, ``free`` the number
    of bits that are not shared at all.
    """

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        both, some = [self.codes], [self.codes]
        while len(both[-1]) > 1:
            starts = np.arange(0, len(both[-1]), FAN)
            both.append(np.bitwise_and.reduceat(both[-1], starts))
            some.append(np.bitwise_or.reduceat(some[-1], starts))
        shared = [a | ~o for a, o in zip(both, some, strict=True)]
        self.free = [64 - np.bitwise_count(s).astype(np.int64) for s in shared]
        self.mask, self.pattern = [], []
        for k, s in enumerate(shared):
            lacks = ~shared[k + 1][np.arange(len(s)) // FAN] if k + 1 < len(shared) else _ALL
            self.mask.append(s & lacks)
            self.pattern.append(both[k] & s & lacks)

    def uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """For each level and node the label of all its members, -1 if they have several."""
        low, high, out = label, label, [label]
        for level in self.mask[1:]:
            starts = np.arange(0, len(low), FAN)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            out.append(np.where(low == high, low, -1))
            assert len(level) == len(low)
        return out

    def search(self, lo: int, hi: int, distance: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links between codes number lo to hi and later ones with another label: one for each node that is taken whole."""
        asks = np.arange(lo, hi)
        node, apart = np.zeros(len(asks), np.int64), np.zeros(len(asks), np.int64)
        labels = self.uniform(label)
        left, right = [], []
        for k in range(len(self.mask) - 1, -1, -1):
            if k < len(self.mask) - 1:  # go down to the children
                first = node * FAN
                held = np.minimum(first + FAN, len(self.mask[k])) - first
                inside = np.arange(int(held.sum())) - np.repeat(np.cumsum(held) - held, held)
                asks, apart, node = np.repeat(asks, held), np.repeat(apart, held), np.repeat(first, held) + inside
            apart = apart + np.bitwise_count((self.codes[asks] ^ self.pattern[k][node]) & self.mask[k][node])
            stay = (apart <= distance) & (labels[k][node] != label[asks]) & ((node + 1) * FAN**k - 1 > asks)
            asks, apart, node = asks[stay], apart[stay], node[stay]
            whole = (apart + self.free[k][node] <= distance) & (node * FAN**k > asks)
            left.append(asks[whole])
            right.append(node[whole] * FAN**k)
            asks, apart, node = asks[~whole], apart[~whole], node[~whole]
        return np.concatenate(left), np.concatenate(right)

    def links(self, distance: int) -> np.ndarray:
        """A spanning forest, as pairs of codes, of the pairs within ``distance`` bits."""
        n = len(self.codes)
        label, out = np.arange(n), []

        def join(a: np.ndarray, b: np.ndarray) -> None:
            """Adds links, of those between the same labels one, and gives what they join one label."""
            nonlocal label
            ends = np.stack((label[a], label[b]), 1)
            ends, first = np.unique(ends, axis=0, return_index=True)
            tree = np.fromiter(_forest(map(tuple, ends.tolist())), np.int64)
            out.append(np.stack((self.codes[a[first[tree]]], self.codes[b[first[tree]]]), 1))
            root = dict(enumerate(range(n))) if not len(tree) else {}
            for x, y in ends[tree].tolist():
                x, y = _root(root, x), _root(root, y)
                root[max(x, y)] = min(x, y)
            if len(tree):
                moved = {x: _root(root, x) for x in list(root)}
                table = np.arange(n)
                table[list(moved)] = list(moved.values())
                label = table[label]

        # members of a node that are near whatever their other bits, and neighbours in Gray order, first
        for k in range(1, len(self.mask)):
            near = np.flatnonzero(self.free[k] <= distance)
            first = np.repeat(near * FAN**k, FAN**k)
            other = first + np.tile(np.arange(FAN**k), len(near))
            keep = (other < n) & (other > first)
            if keep.any():
                join(first[keep], other[keep])
        for step in range(1, FAN + 1):
            a = np.arange(max(0, n - step))
            a = a[(np.bitwise_count(self.codes[a] ^ self.codes[a + step]) <= distance) & (label[a] != label[a + step])]
            if len(a):
                join(a, a + step)
        for lo in range(0, n, SEARCHED):
            a, b = self.search(lo, min(n, lo + SEARCHED), distance, label)
            if len(a):
                join(a, b)
        return np.concatenate(out) if out else np.zeros((0, 2), np.uint64)


def _root(root: dict[int, int], x: int) -> int:
    while (up := root.get(x, x)) != x:
        root[x] = root.get(up, up)
        x = up
    return x


def _linked(distance: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        pairs = GrayIndex(np.unique(group.column("code").to_numpy()).view(np.uint64)).links(distance).view(np.int64)
        return pa.table({"a": np.minimum(pairs[:, 0], pairs[:, 1]), "b": np.maximum(pairs[:, 0], pairs[:, 1])})

    return run


def _masks(distance: int) -> Callable:
    """Sets of bits for each group (key, n, set_0 to set_63: how many members have the bit): those that split it best, dealt in turn."""

    def run(batches):
        for batch in batches:
            counts = np.stack([batch.column(f"set_{k}").to_numpy() for k in range(64)], 1)
            n = batch.column("n").to_numpy()
            out = []
            for held, row in zip(n.tolist(), counts, strict=True):
                balance = np.minimum(row, held - row)
                best = [int(b) for b in np.argsort(-balance, kind="stable") if balance[b]]
                bits = max(1, (4 * held // GROUP).bit_length())
                masks = [sum(1 << b for b in best[k :: distance + 1][:bits]) for k in range(distance + 1)]
                out.append(np.array(masks, np.uint64).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.list_(pa.int64()))], ["key", "masks"])

    return run


def linked_codes(codes: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b) of distinct 64-bit values in ``codes`` (code) that connect just what pairs within ``distance`` bits connect."""
    groups = written(codes.select("code", F.lit(0).cast("long").alias("key")).distinct())
    parts = []
    for k in range(ROUNDS + 1):
        sums = [F.sum(F.shiftrightunsigned("code", b).bitwiseAND(F.lit(1))).alias(f"set_{b}") for b in range(64)]
        sizes = written(groups.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *sums))
        large = sizes.where(F.col("n") > GROUP) if k < ROUNDS else sizes.where("false")
        done = large.isEmpty()
        fit = groups.join(sizes.where(F.col("n") > (1 if done else 0)).join(large.select("key"), "key", "left_anti").select("key"), "key", "left_semi")
        parts.append(written(fit.groupBy("key").applyInArrow(_linked(distance), "a long, b long")))
        if done:
            dropped(groups, sizes)
            break
        masks = written(large.mapInArrow(_masks(distance), "key long, masks array<bigint>"))
        dealt = groups.join(masks, "key").select("code", "key", F.posexplode("masks").alias("number", "mask"))
        again = written(dealt.select("code", F.xxhash64("key", "number", F.col("code").bitwiseAND(F.col("mask"))).alias("key")).distinct())
        dropped(groups, sizes, masks)
        groups = again
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    pairs = written(out.distinct())
    dropped(*parts)
    return pairs


def fingerprints(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id and code, the 64-bit fingerprint as a long, of each row of ``docs`` (doc_id, text)."""

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(fingerprints_of(*shingle_hashes(data, offsets, shingle)).view(np.int64))], ["doc_id", "code"])

    return map_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", work, "doc_id long, code long")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, distance: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row of ``docs`` (doc_id, text).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A fingerprint has the bits that are
    set in over half of the XXH64 hashes of the text's ``shingle``-word shingles, repeats
    included; with fewer words the whole sequence is one shingle. Rows are linked if their
    fingerprints differ in at most ``distance`` bits; component_id is the smallest doc_id
    reachable.

    Null and empty texts have fingerprint 0 and are linked like others. Repeated ids: a row
    each. Rows with a null id link others, and have the smallest id of their component, null if
    there is none. Empty table: no rows. Other columns are not read.
    """
    rows = written(fingerprints(docs, shingle))
    nodes = written(rows.groupBy("code").agg(F.min("doc_id").alias("least")))
    pairs = linked_codes(nodes.select("code"), distance)
    of = components(pairs)
    placed = nodes.join(of.withColumnRenamed("node", "code"), "code", "left").withColumn("component", F.coalesce("component", "code"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = written(placed.join(least, "component").select("code", "component_id"))
    out = rows.join(named, "code").select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")
    dropped(nodes, pairs, of)
    return out
