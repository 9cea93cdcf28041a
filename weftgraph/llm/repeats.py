"""Removal of repeated word sequences: suffix automata of reference shards give matching statistics.

The reference is the corpus itself, which no broadcast can hold. So it is cut into shards by
content: of each window of words the k-gram with the smallest hash is its anchor, and equal
windows have equal anchors. The windows of one anchor at one place are a short passage. All
passages of an anchor are a reference shard; its automaton grows in (document, place) order
as the passages stream by, and a window whose matching statistic reaches the window length
starts earlier. Of equal texts only the first is searched; all windows of the others start
earlier. So it is with equal passages of an anchor that has more than ``hot`` of them. If it
still has more than ``hot`` different ones, its shard would be unbounded, and their windows
are compared by two independent 64-bit hashes, with pre-aggregated minima, instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .suffix import SuffixAutomaton
from .tables import dropped, written
from .words import Words, blocks, extend

GRAM = 10


def passages(words: Words, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: its hash, first window and last window, as word numbers."""
    n, gram = len(words), min(GRAM, window)
    starts = np.arange(max(0, n - window + 1))
    starts = starts[words.text[starts] == words.text[starts + window - 1]] if len(starts) else starts
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts
    grams = np.full(n, np.iinfo(np.uint64).max)
    values, at = words.grams(hashes, gram)
    grams[at] = values
    view = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)
    anchor = np.empty(len(starts), np.int64)
    for lo in range(0, len(starts), 1 << 15):
        mine = starts[lo : lo + (1 << 15)]
        anchor[lo : lo + (1 << 15)] = mine + view[mine[0] : mine[-1] + 1].argmin(axis=1)[mine - mine[0]]
    cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(starts) != 1)) + 1
    first = np.concatenate(([0], cut))
    last = np.concatenate((cut, [len(starts)])) - 1
    return grams[anchor[first]], starts[first], starts[last]


def _anchors(window: int):
    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        """The number of words and the anchors of each text, one for each of its passages."""
        words = Words(data, offsets)
        anchor, first, _ = passages(words, words.hashes(), window)
        cuts = np.searchsorted(words.text[first], np.arange(rows.num_rows + 1))
        return [pa.array(np.diff(words.bounds)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(anchor.view(np.int64)))]

    return work


def _passages(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The passages of each text whose anchor is in ``cool`` or ``warm``."""
        for batch in batches:
            for rows, data, offsets in blocks(batch, "text"):
                words = Words(data, offsets)
                anchor, first, last = passages(words, words.hashes(), window)
                anchor, cuts = anchor.view(np.int64), np.searchsorted(words.text[first], np.arange(rows.num_rows + 1))
                numbers, hot = [], []
                for k in range(rows.num_rows):
                    mine = np.arange(cuts[k], cuts[k + 1])
                    cool, warm = (np.asarray(rows.column(c)[k].as_py() or (), np.int64) for c in ("cool", "warm"))
                    is_hot = np.isin(anchor[mine], warm)
                    taken = is_hot | np.isin(anchor[mine], cool)
                    numbers.append(mine[taken])
                    hot.append(is_hot[taken])
                numbers, hot = np.concatenate(numbers), np.concatenate(hot)
                lo, hi = first[numbers], last[numbers] + window
                text = words.text[lo]
                said = [b" ".join(data[a:b].tobytes().split()) for a, b in zip(words.first[lo].tolist(), words.last[hi - 1].tolist(), strict=True)]
                take = pa.array(text)
                out = [pa.array(anchor[numbers]), pa.array(hot), rows.column("doc").take(take), rows.column("part").take(take), pa.array((lo - words.bounds[text]).astype(np.int32)), pa.array((hi - lo).astype(np.int32)), pa.array(said, pa.binary())]
                yield pa.RecordBatch.from_arrays(out, ["anchor", "hot", "doc", "part", "place", "length", "passage"])

    return run


RANGES = "doc bigint, part bigint, first int, last int"


def _ranges(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc", "part", "first", "last"])


def _streamed(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Word ranges that start earlier; the rows of an anchor come together, in order."""
        anchor, automaton, before = None, SuffixAutomaton(), None
        for batch in batches:
            out = []
            for a, doc, part, place, passage in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc", "part", "place", "passage")), strict=True):
                if a != anchor:
                    anchor, automaton, before = a, SuffixAutomaton(), None
                if (doc, part, place) == before:  # the same row of the corpus again
                    continue
                before, done = (doc, part, place), -1
                for end, length in enumerate(automaton.add(passage.split(b" ")), place + 1):
                    if length >= window:
                        if done >= end - window:
                            out[-1] = (doc, part, out[-1][2], end)
                        else:
                            out.append((doc, part, end - window, end))
                        done = end
            if out:
                yield _ranges(out)

    return run


def _windows(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """128-bit hashes of all windows of the passages."""
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                rows = batch.slice(lo, 1000)
                said = rows.column("passage").to_pylist()
                words = Words(np.frombuffer(b"\n".join(said), np.uint8), np.cumsum([0, *(len(x) + 1 for x in said[:-1]), len(said[-1])]))
                one, at = words.grams(words.hashes(), window)
                two, _ = words.grams(words.hashes(1), window)
                row = words.text[at]
                place, take = rows.column("place").to_numpy()[row] + (at - words.bounds[row]), pa.array(row)
                out = [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), rows.column("doc").take(take), rows.column("part").take(take), pa.array(place.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(out, ["one", "two", "doc", "part", "place"])

    return run


def _kept(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    n_words, n_removed, kept, spans = [], [], [], []
    ranges, whole = rows.column("ranges"), rows.column("whole")
    for k in range(rows.num_rows):
        words = data[offsets[k] : offsets[k + 1]].tobytes().split()
        own, left, done = [], [], 0
        gone = [(0, len(words))] if whole[k].as_py() else sorted((x["first"], x["last"]) for x in ranges[k].as_py() or ())
        for x in gone:
            if own and x[0] <= own[-1][1]:
                own[-1][1] = max(own[-1][1], x[1])
            else:
                own.append(list(x))
        for a, b in own:
            left += words[done:a]
            done = b
        left += words[done:]
        n_words.append(len(words))
        n_removed.append(len(words) - len(left))
        kept.append(b" ".join(left).decode("utf-8", "replace"))
        spans.append([{"first": a, "last": b} for a, b in own])
    return [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))]


def without_repeats(docs: DataFrame, *, window: int = 20, hot: int = 1000) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and removed (word ranges) of each row of docs (doc_id, text).

    A word goes if it is in a window of ``window`` words whose sequence also starts earlier:
    in a row with a smaller doc_id, or before in the same text. Windows are judged on the
    input. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; the kept ones are joined by one space.

    Null and empty texts have no words. A null doc_id comes after all others. Rows that
    repeat a doc_id with another text are ordered by a 64-bit hash of it; rows that repeat both
    are one occurrence, and each gets the same result. Other columns are not read.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumns({"doc": F.coalesce("doc_id", F.lit(2**63 - 1)), "part": F.xxhash64("text")})
    known = extend(keyed.select("doc", "part", F.xxhash64(F.lit(1), "text").alias("more"), "text"), "text", _anchors(window), {"n": "bigint", "anchors": "array<bigint>"})
    known = written(known.drop("text"))
    firsts = written(known.groupBy("part", "more").agg(F.min("doc").alias("owner")))
    owned = known.where(F.col("n") >= window).join(firsts, ["part", "more"])
    copies = written(owned.where("doc > owner").select("doc", "part").distinct())
    anchors = written(owned.where("doc = owner").select("doc", "part", "anchors").distinct())
    dropped(known, firsts)
    each = anchors.select("doc", "part", F.explode("anchors").alias("anchor"))
    shared = written(each.groupBy("anchor").count().where("count > 1").select("anchor", (F.col("count") > hot).alias("hot")))
    mine = each.join(shared, "anchor").groupBy("doc", "part").agg(F.collect_set(F.when(~F.col("hot"), F.col("anchor"))).alias("cool"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("warm"))
    mine = written(mine)
    dropped(anchors, shared)
    found = keyed.select("doc", "part", "text").join(mine, ["doc", "part"]).mapInArrow(_passages(window), "anchor bigint, hot boolean, doc bigint, part bigint, place int, length int, passage binary")
    found = written(found)
    dropped(mine)

    # one row for each different passage of a crowded anchor; the others are repeats as a whole
    where = F.struct("doc", "part", "place")
    crowd = found.where("hot")
    unlike = written(crowd.groupBy("passage").agg(F.min("anchor").alias("anchor"), F.min(where).alias("least")))
    equal = crowd.join(unlike.select("passage", "least"), "passage").where(where > F.col("least"))
    equal = written(equal.select("doc", "part", F.col("place").alias("first"), (F.col("place") + F.col("length")).alias("last")))
    vast = written(unlike.groupBy("anchor").count().where(F.col("count") > hot).select("anchor"))
    alone = unlike.select("anchor", "least.*", "passage")

    cool = found.where("NOT hot").select("anchor", "doc", "part", "place", "passage").unionByName(alone.join(vast, "anchor", "left_anti"))
    cool = cool.repartition("anchor").sortWithinPartitions("anchor", "doc", "part", "place")
    ranges = written(cool.mapInArrow(_streamed(window), RANGES))

    warm = alone.join(vast, "anchor", "left_semi").select("doc", "part", "place", "passage").mapInArrow(_windows(window), "one bigint, two bigint, doc bigint, part bigint, place int")
    least = written(warm.groupBy("one", "two").agg(F.min(where).alias("least"), F.max(where).alias("most")).where("least < most").select("one", "two", "least"))
    later = written(warm.join(least, ["one", "two"]).where(where > F.col("least")).select("doc", "part", F.col("place").alias("first"), (F.col("place") + window).alias("last")))
    dropped(found, unlike, vast, least)

    every = ranges.unionByName(equal).unionByName(later).groupBy("doc", "part").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    every = written(every.withColumn("whole", F.lit(False)).unionByName(copies.withColumns({"ranges": F.lit(None).cast("array<struct<first: int, last: int>>"), "whole": F.lit(True)})))
    dropped(ranges, equal, later, copies)
    joined = keyed.join(every, ["doc", "part"], "left").select("doc_id", "text", "ranges", "whole")
    fields = {"n_words": "bigint", "n_removed": "bigint", "kept_text": "string", "removed": "array<struct<first: int, last: int>>"}
    return extend(joined, "text", _kept, fields).drop("text", "ranges", "whole")
