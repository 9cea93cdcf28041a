"""Language identification: the family first, then one-versus-one linear SVMs inside it."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import dropped, written
from .words import map_blocks, summed

#: Families of ISO 639-1 codes. A language that is not listed is its own family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bg"),
    "uralic": ("fi", "et", "hu"),
}
UNKNOWN = "und"
SLOTS = 1 << 12
#: Margins are of 3-gram shares, times this.
SCALE = 50.0

_LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 97 <= b <= 122 else 32 for b in range(256)], np.uint32)


class Model(NamedTuple):
    """Linear SVMs: ``pairs`` of labels (families or languages), weights by slot, biases."""

    family: Mapping[str, str]
    pairs: tuple[tuple[str, str], ...]
    weights: np.ndarray
    biases: np.ndarray


def slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot of the byte 3-gram that begins at each position, and which of them count.

    Letters are lower-cased, all ASCII that is not a letter is a space; 3-grams across
    texts and those of spaces only don't count.
    """
    a = _LETTERS[data]
    a = np.concatenate((a, np.full(2, 32, np.uint32)))
    code = a[:-2] << np.uint32(16) | a[1:-1] << np.uint32(8) | a[2:]
    counts = code != 0x202020
    for k in (1, 2):
        ends = offsets[1:] - k
        counts[ends[ends >= offsets[:-1]]] = False
    return (code * np.uint32(2654435761)) >> np.uint32(20), counts


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    ascii_letters = summed((_LETTERS[data] != 32) & (data < 0x80), offsets) > 0
    others = summed(data >= 0x80, offsets) > 0
    for k in np.flatnonzero(~ascii_letters & others):
        ascii_letters[k] = any(map(str.isalpha, data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")))
    return ascii_letters


def _svm(x: np.ndarray, y: np.ndarray, rounds: int, decay: float) -> tuple[np.ndarray, float]:
    """Averaged sub-gradient descent on the hinge loss with both classes of equal weight; y is -1 or 1."""
    cost = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, b = np.zeros(x.shape[1]), 0.0
    mean_w, mean_b = w.copy(), 0.0
    for k in range(rounds):
        hit = cost * y * (y * (x @ w + b) < 1)
        step = 2.0 / (1 + 0.05 * k)
        w += step * (hit @ x - decay * w)
        b += step * 0.1 * hit.sum()
        mean_w += (w - mean_w) / (k + 1)
        mean_b += (b - mean_b) / (k + 1)
    return mean_w, mean_b


def _counted(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """The slots that each text has, and their shares."""
    at, counts = slots(data, offsets)
    places, shares = [], []
    for k in range(rows.num_rows):
        mine = slice(offsets[k], offsets[k + 1])
        share = np.bincount(at[mine][counts[mine]], minlength=SLOTS)[:SLOTS].astype(np.float32)
        place = np.flatnonzero(share)
        places.append(place.astype(np.uint16).tobytes())
        shares.append((share[place] / max(1, share.sum())).astype(np.float16).tobytes())
    return pa.RecordBatch.from_arrays([rows.column("lang").cast(pa.string()), pa.array(places, pa.binary()), pa.array(shares, pa.binary())], ["lang", "places", "shares"])


def sample(rows: DataFrame, per_language: int) -> DataFrame:
    """lang and text of ``per_language`` distinct texts of each lang, all where there are fewer: those with the smallest hashes.

    Only hashes are shuffled until the texts are known. Of each language a share of the
    hashes goes on, twice the number wanted, so that no task ranks a whole language.
    """
    hashed = rows.withColumn("hash", F.xxhash64("text"))
    distinct = written(hashed.select("lang", "hash").distinct())
    counts = distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    unit = F.pmod(F.xxhash64("hash"), F.lit(1 << 40)) / float(1 << 40)
    near = distinct.join(F.broadcast(counts), "lang").where(unit < F.lit(2.0 * per_language + 100) / F.col("n"))
    ranked = near.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(unit, "hash")))
    chosen = written(ranked.where(F.col("place") <= per_language).select("lang", "hash"))
    return hashed.join(F.broadcast(chosen), ["lang", "hash"]).groupBy("lang", "hash").agg(F.min("text").alias("text")).select("lang", "text")


def train(docs: DataFrame, usable: Column, *, per_language: int = 400, families: Mapping[str, tuple[str, ...]] = FAMILIES, rounds: int = 150, decay: float = 1e-4) -> Model:
    """Fits the SVMs on a sample of the ``usable`` rows with text and lang, bounded for each language.

    Every lang value is learnt, from ``per_language`` of its distinct texts (see ``sample``);
    the 3-gram shares that are not 0 come to the driver. The pairs grow with the square of
    the number of families. No usable row: a model without languages, which says ``und`` to
    everything.
    """
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    texts = written(sample(rows, per_language))
    taken = map_blocks(texts, "text", _counted, "lang string, places binary, shares binary").toPandas()
    dropped(texts)
    if not len(taken):
        return Model({}, (), np.zeros((0, SLOTS), np.float32), np.zeros(0, np.float32))
    taken = taken.sort_values(["lang", "places", "shares"], ignore_index=True)
    lang = taken["lang"].to_numpy(dtype=object)

    def dense(mine: np.ndarray) -> np.ndarray:
        x = np.zeros((len(mine), SLOTS))
        for k, row in enumerate(mine):
            x[k, np.frombuffer(taken["places"][row], np.uint16)] = np.frombuffer(taken["shares"][row], np.float16).astype(np.float64) * SCALE
        return x

    known = {code: name for name, codes in families.items() for code in codes}
    family = {x: known.get(x, x) for x in sorted({*lang})}
    of = np.array([family[v] for v in lang], object)
    pairs, weights, biases = [], [], []
    for labels, names in [(of, sorted({*family.values()}))] + [(lang, sorted(x for x in family if family[x] == f)) for f in sorted({*family.values()})]:
        for a, b in combinations(names, 2):
            mine = np.flatnonzero((labels == a) | (labels == b))
            w, c = _svm(dense(mine), np.where(labels[mine] == a, 1.0, -1.0), rounds, decay)
            pairs.append((a, b))
            weights.append(w.astype(np.float32))
            biases.append(c)
    return Model(family, tuple(pairs), np.array(weights, np.float32).reshape(-1, SLOTS), np.array(biases, np.float32))


def _vote(margin: Callable[[int], np.ndarray], n: int, pairs: list[tuple[int, str, str]], names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The name with most wins for each of n rows (ties: larger sum of margins), and its weakest margin.

    ``margin`` gives one pair's margins; they are asked for once, so that never all pairs' are held.
    """
    wins, total, least = np.zeros((len(names), n)), np.zeros((len(names), n)), np.full((len(names), n), 8.0)
    for k, a, b in pairs:
        m = margin(k)
        for name, sign in ((a, 1), (b, -1)):
            at = names.index(name)
            wins[at] += sign * m > 0
            total[at] += sign * m
            least[at] = np.minimum(least[at], sign * m)
    best = np.argmax(wins + 0.4 * np.tanh(total), axis=0)
    return best, least[best, np.arange(n)]


def identify(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every whole text; no shuffle.

    ``und`` with score 0 where the text is null or has no letter, or where the model knows
    no language. Repeated rows are told alike; other columns are not read.
    """
    families, languages = sorted({*model.family.values()}), sorted(model.family)
    among = [(k, a, b) for k, (a, b) in enumerate(model.pairs[: len(list(combinations(families, 2)))])]
    inside = {f: [(k, a, b) for k, (a, b) in enumerate(model.pairs) if k >= len(among) and model.family[a] == f] for f in families}

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        n = rows.num_rows
        names, score = np.full(n, UNKNOWN, object), np.zeros(n)
        if languages:
            at, counts = slots(data, offsets)
            length, sizes = np.maximum(1, summed(counts, offsets)), np.diff(offsets)

            def margin(k: int, at: np.ndarray, counts: np.ndarray, offsets: np.ndarray, length: np.ndarray) -> np.ndarray:
                return summed(model.weights[k][at] * counts, offsets) / length * SCALE + model.biases[k]

            told = has_letter(data, offsets)
            family, sure = _vote(lambda k: margin(k, at, counts, offsets, length), n, among, families)
            for f, name in enumerate(families):
                mine = np.flatnonzero(told & (family == f))
                own = [x for x in languages if model.family[x] == name]
                # only the family's texts are held against its pairs
                places = np.repeat(offsets[:-1][mine] - np.concatenate(([0], np.cumsum(sizes[mine])[:-1])), sizes[mine]) + np.arange(sizes[mine].sum()) if len(mine) else mine
                some = at[places], counts[places], np.concatenate(([0], np.cumsum(sizes[mine]))), length[mine]
                best, close = _vote(lambda k, some=some: margin(k, *some), len(mine), inside[name], own)
                names[mine] = np.array(own, object)[best]
                score[mine] = 1 / (1 + np.exp(-2 * np.minimum(sure[mine], close)))
        return pa.RecordBatch.from_arrays([rows.column(doc_id), pa.array(names, pa.string()), pa.array(score)], [doc_id, "lang_pred", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_blocks(docs.select(doc_id, text), text, work, f"`{doc_id}` {kind}, lang_pred string, score double")
