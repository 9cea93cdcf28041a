"""An inverted file of vectors: cells around centroids, int8 codes, and exact scores for what the codes let through.

Centroids are fitted on a bounded sample; every usable vector is a row of a store whose buckets are the cells, with its
int8 code. A search reads the cells whose centroids are nearest to a question, bounds each score by the code, and
computes only what can be among the best from the vector itself. With all cells probed the result is exact. Rows come
and go without the centroids being fitted again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftgraph.sources.store import Store
from weftgraph.sources.tables import dropped, written

#: Rows that centroids are fitted on, at most; cells, at most; rounds of fitting.
SAMPLE, MOST_CELLS, FITTING_ROUNDS = 20_000, 4096, 10
#: So many questions go to the executors at a time, and so many rows meet them at a time: what a task holds has a bound.
QUESTIONS, ROWS = 2048, 1024


def usable(vector: Column, dim: int | None = None) -> Column:
    """Not null, all components finite, not all zero, and of the right length."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(finite if dim is None else finite & (F.size(vector) == dim), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fitted(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids of unit vectors, by k-means on the cosine; a cell that loses all its rows starts again at the row that fits worst."""
    random = np.random.default_rng(0)
    centroids = sample[random.permutation(len(sample))[:cells]]
    for _ in range(FITTING_ROUNDS):
        score = sample @ centroids.T
        own = score.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1)
        lost = np.flatnonzero(size < 1e-12)
        sums[lost] = sample[np.argsort(score.max(axis=1), kind="stable")[: len(lost)]]
        centroids = _unit(sums)
    return centroids


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, at most ``ROWS`` at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _open_pairs(batch: pa.RecordBatch, x: np.ndarray, q: np.ndarray, asked: np.ndarray, own: list[int] | None, bar: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, question) whose score can be among the k best of the question.

    A pair is out if what its code allows at most is below ``bar``, or below what k others of these rows have at least.
    """
    step, norm, size = batch.column("step").to_numpy(), np.sqrt((x * x).sum(axis=1)), np.linalg.norm(q, axis=1)
    codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.int8).reshape(x.shape).astype(np.float64)
    about = (codes @ q.T) * (step / norm)[:, None] / size
    error = (0.5 * step / norm)[:, None] * (np.abs(q).sum(axis=1) / size) * (1 + 1e-9) + 1e-9
    open_ = asked & (about + error >= bar)
    if own is not None:
        mine = np.array(own)
        rows = np.flatnonzero(mine >= 0)
        open_[rows, mine[rows]] = False
    many = np.flatnonzero(open_.sum(axis=0) > k)
    if len(many):
        least = np.where(open_[:, many], about[:, many] - error[:, many], -np.inf)
        open_[:, many] &= about[:, many] + error[:, many] >= np.partition(least, -k, axis=0)[-k]
    return np.nonzero(open_)


class VectorIndex:
    """``VectorIndex.create`` makes one from a table, ``VectorIndex(spark, path)`` opens it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.store = spark, Store(spark, path)
        notes = self.store.version(0).notes
        self.key, self.vector, self.dim = notes["key"], notes["vector"], notes["dim"]
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
        self.centroids = np.array([r["centroid"] for r in rows]).reshape(len(rows), self.dim)

    @classmethod
    def create(cls, spark: SparkSession, path: str, rows: DataFrame, *, key: str = "chunk_id", vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """Fits centroids on at most ``sample`` rows, those with the smallest hashes of their keys, and indexes all.

        The number of cells is about the root of the number of rows unless given. The length of
        the vectors is that of most rows. Other columns are kept, for ``where`` in searches.
        """
        good = rows.where(usable(F.col(vector)) & F.col(key).isNotNull())
        sizes = good.groupBy(F.size(vector).alias("dim")).count().orderBy(F.desc("count"), "dim").first()
        dim, n = (int(sizes["dim"]), int(sizes["count"])) if sizes else (0, 0)
        some = good.where(F.size(vector) == dim).orderBy(F.xxhash64(key), key).select(F.col(vector).cast("array<double>").alias("v")).limit(sample).toArrow()
        data = _unit(_vectors(some.column("v").combine_chunks(), dim)) if n else np.zeros((0, dim))
        centroids = fitted(data, min(cells or max(1, round(n**0.5)), MOST_CELLS, len(data))) if n else data
        schema = StructType([f for f in rows.schema.fields]).add("cell", "integer").add("code", "binary").add("step", "double")
        Store.create(spark, path, schema, [key], buckets=max(1, len(centroids)), by="cell", notes={"key": key, "vector": vector, "dim": dim})
        spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
        made = cls(spark, path)
        if n:
            made.store.replace(made._coded(rows))
        return made

    def _coded(self, rows: DataFrame) -> DataFrame:
        """The usable rows with cell, code and step: an entry is about its code times the step."""
        centroids, dim, vector = self.centroids, self.dim, self.vector
        good = rows.where(usable(F.col(vector), dim) & F.col(self.key).isNotNull())

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                x = _vectors(batch.column(vector), dim)
                # scaled first, so that squares stay within the range of doubles
                cell = (_unit(x / np.abs(x).max(axis=1, keepdims=True)) @ centroids.T).argmax(axis=1)
                step = np.maximum(np.abs(x).max(axis=1) / 127, 1e-300)
                codes = np.rint(x / step[:, None]).astype(np.int8)
                more = [pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(step)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "cell", "code", "step"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in good.schema.fields)
        return good.mapInArrow(run, f"{kinds}, cell int, code binary, step double")

    def upsert(self, rows: DataFrame, *, batch: tuple[str, int] | None = None) -> int:
        """Rows take the place of those with their key; one whose vector isn't usable only takes the old one away."""
        bad = rows.where(~usable(F.col(self.vector), self.dim) & F.col(self.key).isNotNull())
        if not bad.isEmpty():
            self.store.delete(bad.select(self.key))
        return self.store.upsert(self._coded(rows), batch=batch)

    def delete(self, keys: DataFrame) -> int:
        return self.store.delete(keys)

    def search(self, questions: DataFrame, k: int, *, probes: int | None = 8, where: Column | None = None, others: bool = False) -> DataFrame:
        """query_id, rank, the key and score (cosine) of the k best rows for each question (query_id, embedding).

        ``probes``: how many cells are looked into; None: all, which is exact. ``where`` is a
        condition on the kept columns that holds before the cut. ``others``: a question's own id is
        no answer. Ties go to the smaller key. Questions without a usable vector have no answers;
        of those that repeat an id one counts.
        """
        good = questions.where(usable(F.col("embedding"), self.dim) & F.col("query_id").isNotNull())
        good = good.groupBy("query_id").agg(F.min(F.col("embedding").cast("array<double>")).alias("embedding"))
        good = written(good)
        blocks = max(1, -(-good.count() // QUESTIONS))
        parts = []
        for block in range(blocks):
            own = good.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).orderBy("query_id").toArrow()
            if own.num_rows:
                parts.append(self._best(own, good.schema["query_id"].dataType.simpleString(), k, probes, where, others))
        if not parts:
            kind = self.store.version().schema[self.key].dataType.simpleString()
            return self.spark.createDataFrame([], f"query_id {good.schema['query_id'].dataType.simpleString()}, rank int, `{self.key}` {kind}, score double")
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        dropped(good)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), self.key))
        return out.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", self.key, "score")

    def _best(self, own: pa.Table, kind: str, k: int, probes: int | None, where: Column | None, others: bool) -> DataFrame:
        """The k best of each task for a block of questions."""
        key, vector, dim = self.key, self.vector, self.dim
        ids, q = own.column("query_id").combine_chunks(), _vectors(own.column("embedding").combine_chunks(), dim)
        near = (q / np.abs(q).max(axis=1, keepdims=True)) @ self.centroids.T
        asked = np.ones(near.shape, bool)
        if probes is not None and probes < near.shape[1]:
            asked[:] = False
            np.put_along_axis(asked, np.argpartition(-near, probes - 1, axis=1)[:, :probes], True, axis=1)
        rows = self.store.read(buckets=np.flatnonzero(asked.any(axis=0)).tolist())
        rows = rows if where is None else rows.where(where)
        size = np.linalg.norm(q, axis=1)

        place_of = {i: n for n, i in enumerate(ids.to_pylist())} if others else {}

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            who, what, score = np.zeros(0, np.int64), [], np.zeros(0)
            bar = np.full(len(q), -np.inf)  # what the k-th best of this task has
            for batch in sliced(batches):
                cells, names = batch.column("cell").to_numpy(), batch.column(key)
                x = _vectors(batch.column(vector), dim)
                row, one = _open_pairs(batch, x, q, asked[:, cells].T, [place_of.get(i, -1) for i in names.to_pylist()] if others else None, bar, k)
                if not len(row):
                    continue
                norm, total = np.sqrt((x * x).sum(axis=1)), np.zeros(len(row))
                for d in range(dim):  # component by component: the sum has one defined order
                    total += x[row, d] * q[one, d]
                names = names.take(pa.array(row))
                who, score = np.concatenate((who, one)), np.concatenate((score, total / (norm[row] * size[one])))
                what = pa.concat_arrays([what, names]) if len(what) else names
                place = pa.compute.rank(what).to_numpy()
                order = np.lexsort((place, -score, who))
                who, score, what = who[order], score[order], what.take(pa.array(order))
                begins = np.flatnonzero(np.diff(who, prepend=-1))
                at = np.arange(len(who)) - np.repeat(begins, np.diff(np.append(begins, len(who))))
                keep = np.flatnonzero(at < k)
                last = np.flatnonzero(at == k - 1)
                bar[who[last]] = score[last]
                who, score, what = who[keep], score[keep], what.take(pa.array(keep))
            if len(who):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(who)), what, pa.array(score)], ["query_id", key, "score"])

        of_key = rows.schema[key].dataType.simpleString()
        return rows.select(key, "cell", "code", "step", vector).mapInArrow(run, f"query_id {kind}, `{key}` {of_key}, score double")


def recall(found: DataFrame, exact: DataFrame, key: str = "chunk_id") -> float:
    """The share of the exact answers (query_id, key) that were found."""
    total, hit = exact.select("query_id", key).join(found.select("query_id", key).withColumn("hit", F.lit(1)), ["query_id", key], "left").agg(F.count(F.lit(1)), F.count("hit")).first()
    return hit / total if total else 1.0


def fused(k: int, *lists: DataFrame, key: str = "chunk_id", how: str = "max", weights: Sequence[float] | None = None) -> DataFrame:
    """key, score and rank of the k best of several ranked lists (key, score), each divided by its largest score.

    ``max``: a row's best place counts; ``sum``: the weighted sum. Scores of 0 or less count as they are.
    """
    weights = weights or [1.0] * len(lists)
    every = None
    for part, weight in zip(lists, weights, strict=True):
        top = part.agg(F.max("score").alias("top"))
        scaled = part.join(F.broadcast(top)).select(key, (weight * F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(F.col("score"))).alias("score"))  # one row
        every = scaled if every is None else every.unionByName(scaled)
    joined = every.groupBy(key).agg((F.max if how == "max" else F.sum)("score").alias("score")).orderBy(F.desc("score"), key).limit(k)
    return joined.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))
