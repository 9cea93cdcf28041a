"""Benchmark decontamination by pigeonhole edit matching on words.

An item of m words may differ from a passage by k = floor(m * rate) edits of words. If it
does, one of its k + 1 pieces is in the passage unchanged. So each document is searched for
the hashes of all pieces, and where one is found, Myers' bit-parallel algorithm tells the
smallest distance of the whole item to a passage around it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import dropped, written
from .words import LOWER, Words, bytes_of, code_points, extend, map_blocks

#: Between words here: ASCII that is neither letter nor digit.
BETWEEN = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
FIELDS = [("item_id", pa.int64()), ("distance", pa.int32()), ("first", pa.int64()), ("last", pa.int64())]


#: So many hits of pieces at a time are looked at, and so many bits tell whether a hash may be a piece's.
HITS, SIEVE_BITS = 1_000_000, 1 << 27


class Item(NamedTuple):
    """One wording, with the ids of all items that have it."""

    ids: tuple[int, ...]
    words: tuple[int, ...]
    budget: int


class Pieces(NamedTuple):
    """Of one length: distinct hashes in order, and by hash and then item: number of the hash times items plus item, place in the item."""

    hashes: np.ndarray
    keys: np.ndarray
    places: np.ndarray


def distances(pattern: Sequence[int], text: Sequence[int], begin: int = 0) -> Iterator[int]:
    """For each prefix of text[begin:], the smallest edit distance of pattern to a suffix of it (Myers, 1999)."""
    same: dict[int, int] = {}
    for i, x in enumerate(pattern):
        same[x] = same.get(x, 0) | 1 << i
    full, top = (1 << len(pattern)) - 1, 1 << len(pattern) - 1
    up, down, now = full, 0, len(pattern)
    for k in range(begin, len(text)):
        eq = same.get(text[k], 0)
        vertical = eq | down
        diagonal = (((eq & up) + up) ^ up) | eq
        rises, falls = down | (full & ~(diagonal | up)), up & diagonal
        now += bool(rises & top) - bool(falls & top)
        rises, falls = rises << 1 & full, falls << 1 & full
        up, down = falls | (full & ~(vertical | rises)), rises & vertical
        yield now


def matches(item: Item, text: list[int]) -> list[tuple[int, int, int]]:
    """Passages of text within the item's budget, as (distance, first, last), not overlapping, in order.

    From the left, a passage gives way to a better one that overlaps it; what is taken is
    not searched again, so the work grows with the text, however many passages there are.
    """
    out, at, reach = [], 0, len(item.words) + item.budget

    def begin(end: int, distance: int) -> int:
        before = text[max(at, end - reach) : end][::-1]
        return end - 1 - max(k for k, d in enumerate(distances(item.words[::-1], before)) if d == distance)

    while True:
        best = None
        for end, d in enumerate(distances(item.words, text, at), at + 1):
            if best is None:
                best = (d, begin(end, d), end) if d <= item.budget else None
            elif end > best[2] + reach:
                break
            elif d < best[0] and (first := begin(end, d)) < best[2]:
                best = (d, first, end)
        if best is None:
            return out
        out.append(best)
        at = best[2]


def cut(words: int, rate: float) -> np.ndarray:
    """Where an item of so many words is cut into one piece more than its budget."""
    return np.linspace(0, words, int(words * rate) + 2).astype(int)


def prepared(rows: list[tuple[int, str]], rate: float) -> tuple[list[Item], dict[int, Pieces]]:
    """The wordings with a word, and their pieces by length."""
    data, offsets = bytes_of(pa.array([t for _, t in rows], pa.string()))
    words = Words(LOWER[data], offsets, BETWEEN)
    hashes, pieces = words.hashes(), {}
    wordings: dict[tuple[int, ...], list[int]] = {}
    for k in np.flatnonzero(np.diff(words.bounds)).tolist():
        said = tuple(hashes[words.bounds[k] : words.bounds[k + 1]].tolist())
        known = said in wordings
        wordings.setdefault(said, []).append(rows[k][0])
        if not known:
            cuts = cut(len(said), rate)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                pieces.setdefault(b - a, []).append((int(words.bounds[k]) + a, len(wordings) - 1, a))
    items, out = [Item(tuple(ids), said, int(len(said) * rate)) for said, ids in wordings.items()], {}
    for n, own in pieces.items():
        first, item, place = np.array(own).T
        grams, at = words.grams(hashes, n)
        values, number = np.unique(grams[np.searchsorted(at, first)], return_inverse=True)
        keys = number * len(items) + item
        order = np.argsort(keys, kind="stable")
        out[n] = Pieces(values, keys[order], place[order])
    return items, out


def _hits(words: Words, hashes: np.ndarray, pieces: dict[int, Pieces], items: int) -> Iterator[np.ndarray]:
    """Rows (text, item, word where the item would begin) of all pieces found, sorted and distinct, for one range of items after the other.

    A piece that many items share is not expanded to all of them at once: with many hits the ranges are short.
    """
    found, total = [], 0
    for n, own in pieces.items():
        grams, at = words.grams(hashes, n)
        few = np.zeros(1 << 16, bool)
        few[(own.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        here = np.flatnonzero(few[(grams & np.uint64(0xFFFF)).astype(np.int64)])
        number = np.searchsorted(own.hashes, grams[here])
        same = np.flatnonzero(own.hashes[np.minimum(number, len(own.hashes) - 1)] == grams[here])
        here, number = here[same], number[same]
        total += int((np.searchsorted(own.keys, (number + 1) * items) - np.searchsorted(own.keys, number * items)).sum())
        found.append((own, at[here], number))
    ranges = max(1, min(items, -(-total // HITS)))
    for begin, end in zip(*(np.linspace(0, items, ranges + 1).astype(int)[k:][:ranges] for k in (0, 1)), strict=True):
        out = [np.zeros((0, 3), np.int64)]
        for own, at, number in found:
            lo, hi = (np.searchsorted(own.keys, number * items + x) for x in (begin, end))
            times = hi - lo
            place = np.repeat(lo - np.cumsum(times) + times, times) + np.arange(times.sum())
            word = np.repeat(at, times)
            out.append(np.stack((words.text[word], own.keys[place] % items, word - own.places[place]), axis=1))
        yield np.unique(np.concatenate(out), axis=0)


KIND = "array<struct<item_id: bigint, distance: int, first: bigint, last: bigint>>"


def _searched(docs: DataFrame, rows: list[tuple[int, str]], rate: float, text: str, column: str, every: bool) -> DataFrame:
    """``docs`` with ``column``: what it holds of these items."""
    entries, pieces = prepared(rows, rate)

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        words = Words(LOWER[data], offsets, BETWEEN)
        hashes, point = words.hashes(), None
        found: list[list[dict]] = [[] for _ in range(rows.num_rows)]
        for part in _hits(words, hashes, pieces, len(entries)):
            hits, k = part.tolist(), 0
            while k < len(hits):
                t, i, begin = hits[k]
                item, end = entries[i], begin
                while k < len(hits) and hits[k][:2] == [t, i] and hits[k][2] <= end + 2 * item.budget + 1:
                    end, k = hits[k][2], k + 1
                if found[t] and not every:
                    continue
                lo = max(int(words.bounds[t]), begin - item.budget)
                hi = min(int(words.bounds[t + 1]), end + len(item.words) + item.budget)
                near = hashes[lo:hi].tolist()
                if len(set(item.words).difference(near)) > item.budget:  # each of these takes an edit
                    continue
                for d, a, b in matches(item, near):
                    point = code_points(data) if point is None else point
                    place = point[words.first[lo + a]] - point[offsets[t]], point[words.last[lo + b - 1]] - point[offsets[t]]
                    found[t] += [{"item_id": one, "distance": d, "first": int(place[0]), "last": int(place[1])} for one in item.ids]
        return [pa.array([sorted(x, key=lambda m: (m["first"], m["item_id"])) for x in found], pa.list_(pa.struct(FIELDS)))]

    return extend(docs, text, work, {column: KIND})


def _piece_rows(items: DataFrame, rate: float) -> DataFrame:
    """size, hash and shard of the pieces of all items."""

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        words = Words(LOWER[data], offsets, BETWEEN)
        hashes = words.hashes()
        shards, out = rows.column("shard").to_pylist(), []
        for k in np.flatnonzero(np.diff(words.bounds)).tolist():
            cuts = cut(int(words.bounds[k + 1] - words.bounds[k]), rate) + int(words.bounds[k])
            out += [(int(b - a), int(a), shards[k]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        size, first, shard = np.array(out, np.int64).reshape(-1, 3).T
        value = np.zeros(len(out), np.uint64)
        for n in np.unique(size).tolist():
            grams, at = words.grams(hashes, n)
            value[size == n] = grams[np.searchsorted(at, first[size == n])]
        return pa.RecordBatch.from_arrays([pa.array(size.astype(np.int32)), pa.array(value.view(np.int64)), pa.array(shard)], ["size", "hash", "shard"])

    return map_blocks(items, "text", work, "size int, hash long, shard long")


def _asked(docs: DataFrame, pieces: DataFrame, text: str, number: str) -> DataFrame:
    """(number, shard) of each text that holds a piece of an item of the shard.

    One pass: a sieve of SIEVE_BITS bits, whatever the size of the benchmark, lets only few
    word sequences through that are no piece; those that pass meet the pieces in a join.
    """
    sizes = [n for (n,) in pieces.select("size").distinct().collect()]  # lengths of pieces: at most 1 / rate + 1
    bit = F.pmod("hash", F.lit(SIEVE_BITS)) + 1
    parts = pieces.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    sieve = np.zeros(SIEVE_BITS // 8, np.uint8)
    for part, bits in parts:
        sieve[(part - 1) * len(bits) : part * len(bits)] = np.frombuffer(bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(sieve)

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        words, sieve, own = Words(LOWER[data], offsets, BETWEEN), shared.value, rows.column(number).to_numpy()
        hashes, out = words.hashes(), []
        for n in sizes:
            grams, at = words.grams(hashes, n)
            bit = (grams & np.uint64(SIEVE_BITS - 1)).astype(np.int64)
            here = np.flatnonzero(sieve[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
            out.append(np.unique(np.stack((own[words.text[at[here]]], grams[here].view(np.int64), np.full(len(here), n)), axis=1), axis=0))
        of, value, size = np.concatenate(out or [np.zeros((0, 3), np.int64)]).T
        return pa.RecordBatch.from_arrays([pa.array(of), pa.array(value), pa.array(size.astype(np.int32))], [number, "hash", "size"])

    held = map_blocks(docs.select(number, text), text, work, f"`{number}` long, hash long, size int")
    return written(held.join(pieces, ["hash", "size"]).select(number, "shard").distinct())


def find(docs: DataFrame, benchmark: DataFrame, *, rate: float = 0.2, shard_bytes: int = 4_000_000, text: str = "text", column: str = "leaks", every: bool = True) -> DataFrame:
    """``docs`` with ``column``: an array of (item_id, distance, first, last) in order of place.

    ``first`` and ``last`` are code points, end exclusive. Words are runs of letters and
    digits, ASCII lower-cased; equality is that of 64-bit hashes of words. Without ``every``
    a text is not searched on once one of its passages is found. Items of one wording are
    searched for once, and each is named in the result.

    A benchmark of up to ``shard_bytes`` goes to the executors, and nothing is shuffled. A
    larger one is dealt to shards of that size, of which one at a time is in the driver. One
    pass over the texts tells which shards' pieces each of them holds; a shard is searched
    for only in the texts that hold one. Items without a word match nothing; null texts hold
    nothing; an item that is there twice is found twice; an empty benchmark or table gives
    empty arrays or no rows.
    """
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_bytes))

    def of_shard(k: int) -> list[tuple[int, str]]:
        return [tuple(r) for r in sharded.where(F.col("shard") == k).orderBy("item_id", "text").select("item_id", "text").collect()]

    sharded = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    if shards == 1:
        return _searched(docs, of_shard(0), rate, text, column, every)

    number = f"{column}_row"
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()))
    pieces = written(_piece_rows(sharded, rate).distinct())
    asked = _asked(rows, pieces, text, number)
    parts = []
    for k in range(shards):
        own = rows.select(number, F.col(text).alias("text")).join(asked.where(F.col("shard") == k), number, "left_semi")
        parts.append(written(_searched(own, of_shard(k), rate, "text", column, every).where(F.size(column) > 0).select(number, column)))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    joined = F.array_sort(F.flatten(F.collect_list(column)), lambda a, b: F.when(a["first"] < b["first"], -1).when(a["first"] > b["first"], 1).when(a["item_id"] < b["item_id"], -1).when(a["item_id"] > b["item_id"], 1).otherwise(0))
    found = written(found.groupBy(number).agg(joined.alias(column)))
    dropped(pieces, asked, *parts)
    return rows.join(found, number, "left").withColumn(column, F.coalesce(column, F.array().cast(KIND))).drop(number)
