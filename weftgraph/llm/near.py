"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian pruning, exact confirmation.

1. One pass makes each text's shingle set size, a 128-bit identity of the set, and a
   signature of BANDS * ROWS MinHash values (16 bits each). Texts with equal sets are one
   class, of which only the smallest id goes on.
2. Classes that agree in a whole band are candidates. First each is compared with the hub of
   one of its band keys, then, in rounds, with the hub of every key that still holds several
   components; a hub that all of its key were compared with leaves the key. What is left
   after HUB_ROUNDS is compared in tiles: chunks of bounded size against each other, of
   which only a spanning forest of the links goes out. So no group is expanded into its
   pairs, and no candidate link between components is left out.
3. A candidate pair's signatures are compared in batches; after each, the pair is dropped if
   the posterior probability of a similarity at the threshold is below MISS.
4. Survivors are confirmed on the full shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .links import components
from .tables import dropped, written
from .words import LOWER, Words, map_blocks, mixed, paired

BANDS, ROWS = 32, 6
BATCH = 32
MISS = 1e-6
HUB_ROUNDS = 1
#: A chunk holds classes of about so many shingles, if no single class has more; small ones count as LEAST_SHINGLES.
TILE_SHINGLES, LEAST_SHINGLES = 50_000, 64
#: So many shingles at a time are columns of the matrices of a tile, so many pairs at a time are compared.
TILE_COLUMNS, TILE_PAIRS = 4096, 100_000
_SEEDS = np.random.default_rng(7).integers(1, 1 << 32, (2, BANDS * ROWS), dtype=np.uint32) | np.uint32(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-word shingles; of all its words, if fewer."""
    words = Words(LOWER[data], offsets)
    hashes = words.hashes()
    grams, at = words.grams(hashes, n)
    bounds = np.searchsorted(at, words.bounds)
    out = [np.unique(grams[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    for k in np.flatnonzero((np.diff(words.bounds) > 0) & (np.diff(bounds) == 0)):
        own, whole = hashes[words.bounds[k] : words.bounds[k + 1]], np.full(1, n, np.uint64)
        for j in range(len(own)):
            whole = paired(whole, own[j : j + 1])
        out[k] = whole
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Low 16 bits of the smallest value of each hash function, a row for each set; 0 for empty ones."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), BANDS * ROWS), np.uint16)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        starts, value = np.concatenate(([0], np.cumsum(sizes[full])[:-1])), np.empty_like(flat)
        for k in range(BANDS * ROWS):
            np.multiply(flat ^ _SEEDS[1, k], _SEEDS[0, k], out=value)
            least = np.minimum.reduceat(value, starts).astype(np.uint64)
            out[full, k] = mixed(least).astype(np.uint16)
    return out


def least_matches(of: int, percent: int, miss: float) -> int:
    """The fewest equal values among ``of`` with which a pair stays: with a uniform prior, the
    posterior of the similarity after m matches is Beta(m + 1, of - m + 1), and its mass above
    the threshold t is the chance that a binomial of ``of`` + 1 draws at t gives at most m."""
    t, mass = percent / 100, 0.0
    for m in range(of + 1):
        mass += comb(of + 1, m) * t**m * (1 - t) ** (of + 1 - m)
        if mass >= miss:
            return m
    return of


def _band_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            sig = np.stack([np.frombuffer(x, np.uint16) for x in part.column("signature").to_pylist()]).astype(np.uint64).reshape(len(part), BANDS, ROWS)
            key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(part), BANDS)).copy()
            for k in range(ROWS):
                key = paired(key, sig[:, :, k])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), part.column("rep").take(pa.array(np.repeat(np.arange(len(part)), BANDS)))], ["key", "rep"])


def _bars(percent: int, miss: float) -> list[tuple[int, int]]:
    return [(n, least_matches(n, percent, miss)) for n in range(BATCH, BANDS * ROWS + 1, BATCH)]


def _pruned(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, bars: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (x of a, y of b) that pass every batch."""
    same = np.zeros(len(x), np.int64)
    for n, bar in bars:
        same = same + (a[x, n - BATCH : n] == b[y, n - BATCH : n]).sum(axis=1)
        stay = same >= bar
        x, y, same = x[stay], y[stay], same[stay]
    return x, y


def _likely(percent: int, miss: float):
    bars = _bars(percent, miss)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                a, b = (np.stack([np.frombuffer(x, np.uint16) for x in part.column(c).to_pylist()]) for c in ("of_a", "of_b"))
                every = np.arange(len(part))
                yield part.select(["a", "b"]).take(pa.array(_pruned(a, b, every, every, bars)[0]))

    return run


class _Chunk:
    """The classes of one side of a tile."""

    def __init__(self, column: pa.Array, k: int) -> None:
        rows = column[k].values
        lists = rows.field("shingles")
        self.rep, self.component = rows.field("rep").to_numpy(), rows.field("component").to_numpy()
        self.signature = np.stack([np.frombuffer(x, np.uint16) for x in rows.field("signature").to_pylist()])
        self.flat, self.size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        self.bounds = np.concatenate(([0], np.cumsum(self.size)))

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of these rows, and the place in ``rows`` of each."""
        place = np.repeat(np.arange(len(rows)), self.size[rows])
        inside = np.arange(len(place)) - np.repeat(np.cumsum(self.size[rows]) - self.size[rows], self.size[rows])
        return self.flat[self.bounds[rows][place] + inside], place


def _shared(one: _Chunk, two: _Chunk, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of all intersections of rows ``left`` of one with rows ``right`` of two, as a matrix product."""
    (flat, row), (flat2, row2) = one.of(left), two.of(right)
    common = np.intersect1d(flat, flat2)
    out = np.zeros((len(left), len(right)), np.float32)
    placed = []
    for values, at in ((flat, row), (flat2, row2)):
        column = np.minimum(np.searchsorted(common, values), max(0, len(common) - 1))
        hit = np.flatnonzero(common[column] == values) if len(common) else np.zeros(0, np.int64)
        placed.append((at[hit], column[hit]))
    for lo in range(0, len(common), TILE_COLUMNS):
        matrices = np.zeros((len(left), TILE_COLUMNS), np.float32), np.zeros((len(right), TILE_COLUMNS), np.float32)
        for matrix, (at, column) in zip(matrices, placed, strict=True):
            here = (column >= lo) & (column < lo + TILE_COLUMNS)
            matrix[at[here], column[here] - lo] = 1
        out += matrices[0] @ matrices[1].T
    return out


def _forest(links: Iterable[tuple[int, int]]) -> Iterator[int]:
    """The numbers of the links that join two parts not joined before."""
    root: dict[int, int] = {}
    for k, ends in enumerate(links):
        a, b = ends
        while (up := root.get(a, a)) != a:
            a = up
        while (up := root.get(b, b)) != b:
            b = up
        if a != b:
            root[b] = a
            yield k
        for x in ends:
            root[x] = a


def _tiles(percent: int, miss: float):
    bars = _bars(percent, miss)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A spanning forest of the links between different components in each tile."""
        for batch in batches:
            for k in range(batch.num_rows):
                one, two = (_Chunk(batch.column(c), k) for c in ("rows", "others"))
                x, y = np.nonzero(one.component[:, None] != two.component)
                likely = [_pruned(one.signature, two.signature, x[lo : lo + TILE_PAIRS], y[lo : lo + TILE_PAIRS], bars) for lo in range(0, len(x), TILE_PAIRS)]
                x, y = (np.concatenate(v or [np.zeros(0, np.int64)]) for v in (list(zip(*likely, strict=True)) or ((), ())))
                if not len(x):
                    continue
                (left, at), (right, at2) = np.unique(x, return_inverse=True), np.unique(y, return_inverse=True)
                shared = _shared(one, two, left, right)[at, at2]
                linked = np.flatnonzero(100 * shared >= percent * (one.size[x] + two.size[y] - shared))
                ends = zip(one.component[x[linked]].tolist(), two.component[y[linked]].tolist(), strict=True)
                linked = linked[np.fromiter(_forest(ends), np.int64)]
                a, b = one.rep[x[linked]], two.rep[y[linked]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


class _Confirmer:
    """Tells which candidate pairs are links; holds the tables that this takes."""

    def __init__(self, docs: DataFrame, classes: DataFrame, crowded: DataFrame, shingle: int, percent: int, miss: float) -> None:
        self.percent, self.miss = percent, miss
        self.signatures = classes.select("rep", "signature")

        def sets(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
            own = shingle_sets(data, offsets, shingle)
            sizes = np.cumsum([0, *map(len, own)])
            flat = np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat))], ["rep", "shingles"])

        reps = crowded.select("rep").distinct()
        mine = docs.join(reps, docs["doc_id"] == reps["rep"], "left_semi")
        self.sets = written(map_blocks(mine, "text", sets, "rep long, shingles array<bigint>"))

    def across(self, placed: DataFrame) -> DataFrame:
        """Links between components among the classes of each key (key, rep, component).

        The classes of a key are dealt to chunks of about TILE_SHINGLES; each pair of chunks
        is a tile. Only links leave a tile, at most one fewer than it has components.
        """
        sized = self.sets.select("rep", F.greatest(F.size("shingles"), F.lit(LEAST_SHINGLES)).cast("long").alias("size"))
        totals = written(placed.join(sized, "rep").groupBy("key").agg(F.ceil(F.sum("size") / TILE_SHINGLES).alias("chunks")))
        dealt = placed.join(self.sets, "rep").join(self.signatures, "rep").join(totals, "key").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")))
        packed = written(dealt.groupBy("key", "chunk").agg(F.collect_list(F.struct("rep", "component", "signature", "shingles")).alias("rows")))
        other = packed.select("key", F.col("chunk").alias("its"), F.col("rows").alias("others"))
        tiles = packed.join(other, "key").where("chunk <= its").select("rows", "others")
        found = written(tiles.mapInArrow(_tiles(self.percent, self.miss), "a long, b long").distinct())
        dropped(totals, packed)
        return found

    def links(self, pairs: DataFrame) -> DataFrame:
        a = self.signatures.select(F.col("rep").alias("a"), F.col("signature").alias("of_a"))
        b = self.signatures.select(F.col("rep").alias("b"), F.col("signature").alias("of_b"))
        likely = written(pairs.join(a, "a").join(b, "b").select("a", "b", "of_a", "of_b").mapInArrow(_likely(self.percent, self.miss), "a long, b long"))
        a = self.sets.select(F.col("rep").alias("a"), F.col("shingles").alias("of_a"))
        b = self.sets.select(F.col("rep").alias("b"), F.col("shingles").alias("of_b"))
        both = likely.join(a, "a").join(b, "b")
        shared = F.size(F.array_intersect("of_a", "of_b"))
        found = written(both.where(100 * shared >= self.percent * (F.size("of_a") + F.size("of_b") - shared)).select("a", "b"))
        dropped(likely)
        return found


def _placed(rows: DataFrame, of: DataFrame | None) -> DataFrame:
    """(key, rep) with the component of rep: itself, if it is linked with nothing."""
    if of is None:
        return rows.select("key", "rep", F.col("rep").alias("component"))
    return rows.select("key", "rep").join(of.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))


def _open(placed: DataFrame) -> DataFrame:
    """The rows of keys with several components, with their number; of keys with the same rows, one."""
    same = F.bit_xor(F.xxhash64("rep")).alias("one"), F.sum(F.xxhash64("rep", F.lit(1)).cast("decimal(38,0)")).alias("two")
    keys = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"), *same).where("low < high")
    keys = keys.groupBy("one", "two").agg(F.min(F.struct("key", "n")).alias("first")).select("first.key", "first.n")
    return written(placed.join(keys, "key"))


def _joined(of: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) after more links between nodes."""
    if of is None:
        return components(links)
    at = of.unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("component"))).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")))
    at = written(at.groupBy("node").agg(F.min("component").alias("component")))
    ends = links.join(at.select(F.col("node").alias("a"), F.col("component").alias("x")), "a").join(at.select(F.col("node").alias("b"), F.col("component").alias("y")), "b")
    moved = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    out = written(at.join(moved.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component")))
    dropped(of, at, moved)
    return out


def _components(crowded: DataFrame, confirm: _Confirmer, links: DataFrame | None) -> DataFrame | None:
    """(node, component) of all classes that are linked; ``links``: those known before. Drops ``crowded``."""
    of = None if links is None else components(links)
    rows = _open(_placed(crowded, of))
    dropped(crowded)
    for k in range(1 + HUB_ROUNDS):
        if rows.isEmpty():
            break
        degrees = rows.groupBy("rep").agg(F.sum("n").alias("degree"))
        hubs = rows.join(degrees, "rep").groupBy("key").agg(F.max(F.struct("degree", (-F.col("rep")).alias("id"), "component")).alias("hub"))
        hubs = written(hubs.select("key", F.col("hub.degree").alias("degree"), (-F.col("hub.id")).alias("leader"), F.col("hub.component").alias("its")))
        pairs = rows.join(hubs, "key").where("component <> its")
        if k:
            pairs = pairs.select(F.least("leader", "rep").alias("a"), F.greatest("leader", "rep").alias("b")).distinct()
        else:  # of each class only the pair with its greatest hub
            pairs = pairs.groupBy("rep").agg(F.max(F.struct("degree", (-F.col("leader")).alias("id"))).alias("hub")).select((-F.col("hub.id")).alias("a"), F.col("rep").alias("b"))
        found = confirm.links(pairs)
        if not found.isEmpty():
            of = _joined(of, found)
        left = rows.join(hubs, "key").where("rep <> leader") if k else rows
        again = _open(_placed(left, of))
        dropped(rows, hubs, found)
        rows = again
    if not rows.isEmpty() and not (found := confirm.across(rows)).isEmpty():
        of = _joined(of, found)
        dropped(found)
    dropped(rows)
    return of


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of ``docs`` (doc_id, text).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a document's set are its distinct
    ``shingle``-word shingles, with fewer words the whole sequence as one. Two documents are
    linked if 100 * shared >= ``percent`` * united shingles; component_id is the smallest
    doc_id reachable, and kept says whether that is the document's own.

    Null and empty texts: no shingles, linked with nothing. Rows that repeat a doc_id count
    as one document when links are followed, and each gets a row. A null doc_id: linked with
    nothing, component null, kept. Empty table: no rows. Other columns are not read.
    """

    def sketch(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        own = shingle_sets(data, offsets, shingle)
        sizes = np.array([len(s) for s in own], np.int64)
        same = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in own], np.int64).reshape(-1, 2)
        rest = [pa.array(sizes), pa.array(same[:, 0]), pa.array(same[:, 1]), pa.array([s.tobytes() for s in signatures(own)], pa.binary())]
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), *rest], ["doc_id", "n_shingles", "set_a", "set_b", "signature"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = written(map_blocks(docs, "text", sketch, "doc_id long, n_shingles long, set_a long, set_b long, signature binary"))
    full = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    first = full.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "signature")).alias("first"))
    classes = written(first.select("set_a", "set_b", F.col("first.doc_id").alias("rep"), F.col("first.signature").alias("signature")))

    keyed = classes.select("rep", "signature").mapInArrow(_band_rows, "key long, rep long")
    crowds = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    crowded = written(keyed.join(crowds, "key").select("key", "rep"))
    confirm = _Confirmer(docs, classes, crowded, shingle, percent, miss)
    # a document id with several texts is one node, whose classes are linked
    several = written(full.select("doc_id", "set_a", "set_b").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    links = None
    if not several.isEmpty():
        named = full.join(several, "doc_id").join(classes.select("set_a", "set_b", "rep"), ["set_a", "set_b"])
        links = written(named.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a <> b").distinct())
    of = _components(crowded, confirm, links)
    named = classes.select("set_a", "set_b", "rep")
    if of is None:
        named = named.withColumnRenamed("rep", "component")
    else:
        named = named.join(of.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    named = written(named)
    out = sketches.select("doc_id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    out = written(out.select("doc_id", "n_shingles", component.alias("component_id")))
    dropped(sketches, classes, crowds, confirm.sets, several, links, of, named)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
