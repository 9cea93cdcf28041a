"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, learnt from document labels."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import dropped, written
from .words import LOWER, NOT_LETTER, Words, code_points, extend, map_blocks

#: Lengths in bytes of the word beginnings that are features beside whole words.
PREFIXES = (4, 5, 6)
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True


class Model(NamedTuple):
    """Sorted feature hashes with their weights, and the logit of a sentence without any."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float


def features(words: Words) -> list[np.ndarray]:
    """Feature hashes of each word: the word itself and its beginnings (0: none)."""
    own = words.hashes()
    return [own, *((words.prefixes(n) + np.uint64(n)) * (words.last - words.first > n) for n in PREFIXES)]


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the sentences of a block, and their bounds by text; at least one a text."""
    ends = np.flatnonzero(_ENDS[data]) + 1
    first = np.unique(np.concatenate((offsets[:-1], ends[ends < len(data)])))
    return first, np.searchsorted(first, offsets)


def _said(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """(label, distinct feature hashes) of each text."""
    words = Words(LOWER[data], offsets, NOT_LETTER)
    every = features(words)
    out = [np.unique(np.concatenate([f[words.bounds[k] : words.bounds[k + 1]] for f in every])).view(np.int64) for k in range(rows.num_rows)]
    sizes = np.cumsum([0, *map(len, out)])
    flat = np.concatenate(out) if out else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([rows.column("label"), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat))], ["label", "said"])


def train(docs: DataFrame, labels: DataFrame, usable: Column, *, label: str = "toxic", train_rows: int = 20_000, most_features: int = 4096, least_docs: int = 3, least_z: float = 4.0, rounds: int = 300, decay: float = 2e-3, toxic_weight: float = 3.0) -> Model:
    """Learns from at most ``train_rows`` labelled documents, chosen by a hash of the id.

    Spark counts each feature's documents by label and keeps the ``most_features`` that
    differ most from chance; what is left of the sample's sentences comes to the driver,
    where the noisy-or likelihood is maximised. Without documents of both labels the model
    knows no feature and gives every sentence the same small score. Null labels and ids
    are left out; a document that is labelled twice counts twice.
    """
    chosen = labels.where(usable & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", label).limit(train_rows).select(F.col("doc_id").alias("labelled"), F.col(label).cast("int").alias("label"))
    # at most train_rows pairs of numbers: the side that is broadcast is bounded
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))
    sample = written(sample.select("label", "text"))
    count, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < toxic < count:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -6.0 if not toxic else 6.0)
    rate = toxic / count
    said = map_blocks(sample, "text", _said, "label int, said array<bigint>").select("label", F.explode("said").alias("feature"))
    seen = said.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("t")).where(F.col("n") >= least_docs)
    z = F.abs(F.col("t") - rate * F.col("n")) / F.sqrt(F.col("n") * (rate * (1 - rate)))
    kept = seen.where("feature <> 0").withColumn("z", z).where(F.col("z") >= least_z).orderBy(F.desc("z"), "feature").limit(most_features).select("feature").toPandas()
    hashes = np.sort(kept["feature"].to_numpy(np.int64).view(np.uint64))
    bags = map_blocks(sample, "text", _bags(hashes), "label int, plain long, at array<int>, bag array<int>").toPandas()
    dropped(sample)
    weights, bias = _fit(bags, len(hashes), rounds, decay, toxic_weight)
    return Model(hashes, weights, bias)


def _found(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (word number, feature number) of the block."""
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    few = np.zeros(1 << 16, bool)
    few[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
    word, feature = [], []
    for h in features(words):
        at = np.flatnonzero(few[(h & np.uint64(0xFFFF)).astype(np.int64)])
        k = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
        hit = hashes[k] == h[at]
        word.append(at[hit])
        feature.append(k[hit])
    return np.concatenate(word), np.concatenate(feature)


def _by_sentence(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sentences of a block, their bounds by text, and distinct pairs (sentence, feature) in order."""
    first, bounds = sentences(data, offsets)
    words = Words(LOWER[data], offsets, NOT_LETTER)
    word, feature = _found(words, hashes)
    sentence = np.searchsorted(first, words.first[word], "right") - 1
    pairs = np.unique(sentence * max(1, len(hashes)) + feature)
    return first, bounds, pairs // max(1, len(hashes)), pairs % max(1, len(hashes))


def _bags(hashes: np.ndarray):
    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        """For each text: sentences without a feature, and (sentence, feature) pairs of the others."""
        _, bounds, sentence, feature = _by_sentence(data, offsets, hashes)
        cut, plain, at, bag = np.searchsorted(sentence, bounds), [], [], []
        for k in range(rows.num_rows):
            mine, number = np.unique(sentence[cut[k] : cut[k + 1]], return_inverse=True)
            plain.append(int(max(1 if offsets[k] == offsets[k + 1] else 0, bounds[k + 1] - bounds[k] - len(mine))))
            at.append(number.astype(np.int32))
            bag.append(feature[cut[k] : cut[k + 1]].astype(np.int32))
        return pa.RecordBatch.from_arrays([rows.column("label"), pa.array(plain, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(bag, pa.list_(pa.int32()))], ["label", "plain", "at", "bag"])

    return work


def _fit(bags, n_features: int, rounds: int, decay: float, toxic_weight: float) -> tuple[np.ndarray, float]:
    """Gradient ascent (Adam) on the noisy-or likelihood of the documents' labels; a toxic one counts ``toxic_weight`` times."""
    y, plain = bags["label"].to_numpy(float), bags["plain"].to_numpy(float)
    sizes = np.array([max(a) + 1 if len(a) else 0 for a in bags["at"]], np.int64)
    base = np.concatenate(([0], np.cumsum(sizes)))
    doc = np.repeat(np.arange(len(bags)), sizes)
    at = np.concatenate([np.asarray(a, np.int64) + base[k] for k, a in enumerate(bags["at"])] or [np.zeros(0, np.int64)])
    feature = np.concatenate([np.asarray(b, np.int64) for b in bags["bag"]] or [np.zeros(0, np.int64)])
    theta = np.zeros(n_features + 1)
    theta[-1] = -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        z = np.clip(theta[-1] + np.bincount(at, theta[feature], base[-1]), -30, 30)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-theta[-1]))
        none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(bags)) + plain * np.log1p(-p0)
        odds = np.where(y > 0, toxic_weight * np.exp(none) / np.maximum(-np.expm1(none), 1e-9), -1.0)
        slope = odds[doc] * p
        grad = np.concatenate((np.bincount(feature, slope[at], n_features), [slope.sum() + (odds * plain).sum() * p0])) / len(bags)
        grad[:-1] -= decay * theta[:-1] / 10
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return theta[:-1], float(theta[-1])


def score(docs: DataFrame, model: Model, *, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with {prefix}score, {prefix}predicted and {prefix}offending; no shuffle.

    The score is 1 minus the product over sentences of 1 minus their scores; predicted is
    1 from 0.5 on. ``offending`` lists the sentences whose own score is 0.5 or more as
    (first, last, score), code points, end exclusive. Null and empty texts are one empty
    sentence. All columns of docs are kept; ``prefix`` avoids clashes with them.
    """

    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        first, bounds, sentence, feature = _by_sentence(data, offsets, model.hashes)
        weights = model.weights[feature] if len(feature) else np.zeros(0)
        z = np.clip(model.bias + np.bincount(sentence, weights, len(first)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.zeros(len(first) + 1)
        np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-12)), out=none[1:])
        lengths = np.diff(offsets)
        total = np.where(lengths > 0, none[bounds[1:]] - none[bounds[:-1]], np.log1p(-1 / (1 + np.exp(-model.bias))))
        whole = -np.expm1(total)
        spans = [[] for _ in range(rows.num_rows)]
        if len(bad := np.flatnonzero(p >= 0.5)):
            point, last = code_points(data), np.append(first[1:], len(data))
            for s in bad:
                k = int(np.searchsorted(offsets, first[s], "right")) - 1
                if lengths[k]:
                    spans[k].append({"first": int(point[first[s]] - point[offsets[k]]), "last": int(point[min(last[s], offsets[k + 1])] - point[offsets[k]]), "score": float(p[s])})
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))
        return [pa.array(whole), pa.array((whole >= 0.5).astype(np.int32)), pa.array(spans, kind)]

    return extend(docs, text, work, {prefix + "score": "double", prefix + "predicted": "int", prefix + "offending": "array<struct<first: bigint, last: bigint, score: double>>"})
