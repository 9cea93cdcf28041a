"""Nearest neighbours by a block matrix join with int8 tiles.

Vectors are packed into blocks. A tile is one block of queries against one block of
candidates: its int8 matrix product gives all inner products up to a bound on the
quantisation error. Only pairs that could still be among a query's nearest within the tile
are computed again from the original vectors in double precision; the tiles' short lists
are merged by a heap for each query. The tiles of the first block of candidates go first:
the worst of what a query has found there is a bound, below which the other tiles return
nothing. The result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

SUB_BLOCK = 512


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups consecutive rows of one (dim, block) into rows of (dim, block, ids, bounds, vectors), SUB_BLOCK each at most."""
    for batch in batches:
        bounds = batch.column("bound").to_numpy()
        dims, tiles = batch.column("dim").to_numpy(), batch.column("block").to_numpy()
        ids, vectors = batch.column("vec_id").to_numpy(), batch.column("vector")
        for dim, tile in {*zip(dims.tolist(), tiles.tolist(), strict=True)}:
            at = np.flatnonzero((dims == dim) & (tiles == tile))
            for lo in range(0, len(at), SUB_BLOCK):
                mine = at[lo : lo + SUB_BLOCK]
                flat = vectors.take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([tile], pa.int64()), pa.array([ids[mine].tobytes()], pa.binary()), pa.array([bounds[mine].tobytes()], pa.binary()), pa.array([flat.tobytes()], pa.binary())], ["dim", "block", "ids", "bounds", "vectors"])


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Int8 codes by row, and the step of each row: x is step * code, within half a step."""
    step = np.maximum(np.abs(x).max(axis=1) / 127, 1e-300)
    return np.rint(x / step[:, None]).astype(np.int8), step


def tile_nearest(query_ids: np.ndarray, q: np.ndarray, bounds: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the k best of the tile (all, if fewer) that reach its bound: its id, their ids, exact scores."""
    (qc, qs), (xc, xs) = quantised(q), quantised(x)
    dim = q.shape[1]
    # |q.x - steps * codes| <= half a step against the other's absolute sum, and the rest, with room for rounding
    with np.errstate(over="ignore", invalid="ignore"):
        q_sum, x_sum = np.abs(q).sum(axis=1), np.abs(x).sum(axis=1)
    # codes are below 128, so float32 products are exact integers up to 1024 components
    kind = np.float32 if dim <= 1024 else np.float64
    with np.errstate(over="ignore", invalid="ignore"):
        product = (qc.astype(kind) @ xc.T.astype(kind)).astype(np.float64) * qs[:, None] * xs
        error = 0.5 * (qs[:, None] * x_sum + xs * q_sum[:, None]) + 0.25 * dim * qs[:, None] * xs
        error = error * (1 + 1e-9) + 1e-12 * (q_sum[:, None] * x_sum)
        # beyond the range of doubles a bound says nothing
        low, high = product - error, product + error
        low, high = np.where(np.isfinite(low), low, -np.inf), np.where(np.isfinite(high), high, np.inf)
    for i, own in enumerate(query_ids):
        mine = np.flatnonzero((ids != own) & (high[i] >= bounds[i]))
        if len(mine) > k:
            bar = np.partition(low[i, mine], len(mine) - k)[len(mine) - k]
            mine = mine[~(high[i, mine] < bar)]
        score = np.zeros(len(mine))
        with np.errstate(over="ignore", invalid="ignore"):
            for d in range(dim):  # component by component: the sum has one defined order
                score += q[i, d] * x[mine, d]
        best = np.lexsort((ids[mine], -np.where(np.isnan(score), -np.inf, score)))[:k]
        best = best[~(score[best] < bounds[i])]
        yield int(own), ids[mine][best], score[best]


def _tile(dim: int, queries, candidates, k: int) -> pa.Table:
    def unpacked(t):
        return np.concatenate([np.frombuffer(b, np.int64) for b in t["ids"]]), np.concatenate([np.frombuffer(b, np.float64) for b in t["bounds"]]), np.concatenate([np.frombuffer(b, np.float64).reshape(-1, dim) for b in t["vectors"]])

    (qi, bounds, q), (xi, _, x) = unpacked(queries), unpacked(candidates)
    out = []
    for a in range(0, len(qi), 256):
        for b in range(0, len(xi), 4096):
            out += tile_nearest(qi[a : a + 256], q[a : a + 256], bounds[a : a + 256], xi[b : b + 4096], x[b : b + 4096], k)
    sizes = [len(ids) for _, ids, _ in out]
    return pa.table({"query_id": np.repeat(np.array([o for o, _, _ in out], np.int64), sizes), "vec_id": np.concatenate([i for _, i, _ in out] or [np.zeros(0, np.int64)]), "score": np.concatenate([s for _, _, s in out] or [np.zeros(0)])})


def _merged(k: int):
    """Keeps k of each query's rows, which come one after the other, by a heap; ranks them."""

    def ranked(query: int, heap: list[tuple[float, int, float]]) -> list[tuple[int, int, int, float]]:
        return [(query, r, -v, s) for r, (_, v, s) in enumerate(sorted(heap, reverse=True), 1)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heap = None, []

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], ["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            done = []
            for q, v, s in zip(*(batch.column(c).to_pylist() for c in ("query_id", "vec_id", "score")), strict=True):
                if q != now:
                    done += ranked(now, heap)
                    now, heap = q, []
                found = (s if s == s else -float("inf"), -v, s)
                if len(heap) < k:
                    heapq.heappush(heap, found)
                elif found[:2] > heap[0][:2]:
                    heapq.heapreplace(heap, found)
            if done:
                yield out(done)
        if heap:
            yield out(ranked(now, heap))

    return run


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 20, query_block: int = 2048, candidate_block: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k nearest by inner product.

    Columns used: vec_id, embedding. Candidates are all other rows with as many components;
    rows that are null, empty, zero or not finite, or have a null id, take no part. Ties go
    to the smaller vec_id. Rows that repeat a vec_id are candidates of their own, except to
    the query with that id; a repeated query is one query. A score beyond the range of
    doubles is infinite, or NaN if infinities meet in it; NaN ranks like the lowest. With fewer than k candidates all
    are returned; an empty table gives no rows. A tile has about ``query_block`` by
    ``candidate_block`` vectors, whatever the sizes of the tables.
    """
    kind = "array<double>"
    rows = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vector"), is_query.alias("asks"))
    # rows are dealt to blocks by a number of their own, so that repeated ones spread
    rows = written(rows.where(usable(F.col("vector"))).withColumns({"dim": F.size("vector"), "number": F.monotonically_increasing_id()}))
    total, asked = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1))).first()
    across, down = max(1, -(-total // candidate_block)), max(1, -(-asked // query_block))
    schema = "dim int, block long, ids binary, bounds binary, vectors binary"

    def packed(df: DataFrame, blocks: int) -> DataFrame:
        dealt = df.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks)))
        return dealt.select("dim", "block", "vec_id", "bound", "vector").mapInArrow(_packed, schema)

    def tile(key, left, right):
        left, right = left.to_pydict(), right.to_pydict()
        if not left["ids"] or not right["ids"]:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return _tile(key[0].as_py(), left, right, k)

    def tiles(asks: DataFrame, first: int, last: int) -> DataFrame:
        """The tiles of all queries against blocks first to last of the candidates."""
        queries = packed(asks, down).select("dim", F.col("block").alias("row"), F.explode(F.sequence(F.lit(first), F.lit(last))).alias("col"), "ids", "bounds", "vectors")
        candidates = packed(rows.withColumn("bound", F.lit(0.0)), across).where(F.col("block").between(first, last))
        candidates = candidates.select("dim", F.col("block").alias("col"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("row"), "ids", "bounds", "vectors")
        sides = queries.groupBy("dim", "row", F.col("col").cast("long").alias("col")), candidates.groupBy("dim", F.col("row").cast("long").alias("row"), "col")
        return sides[0].cogroup(sides[1]).applyInArrow(tile, "query_id long, vec_id long, score double")

    # a query id with several vectors asks with one of them, always the same
    one = F.min_by(F.struct("dim", "vector", "number"), F.struct(F.xxhash64("vector"), "number")).alias("one")
    asks = written(rows.where("asks").groupBy("vec_id").agg(one).select("vec_id", "one.*"))
    found = written(tiles(asks.withColumn("bound", F.lit(float("-inf"))), 0, 0))
    if across > 1:
        bounds = found.groupBy("query_id").agg(F.when((F.count(F.lit(1)) >= k) & ~F.bool_or(F.isnan("score")), F.min("score")).alias("bound"))
        bounded = asks.join(bounds, F.col("vec_id") == F.col("query_id"), "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
        found = found.unionByName(tiles(bounded, 1, across - 1))
    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(_merged(k), "query_id long, rank int, vec_id long, score double")
