"""Principal components and whitened coordinates of vectors by Golub-Kahan-Lanczos bidiagonalisation.

1. Entries become integers, so that counts, sums and deviations are exact. Rows are packed
   into blocks of centred doubles, which are written once.
2. Each step is one pass over the blocks: y = X c and X'y, added up over all blocks. The left
   vectors u = X w are as long as the table; they are never stored, only the w that makes
   them, as wide as a row, and X'u. So inner products of left vectors are inner products of
   what the driver holds, and each is made orthogonal to all before it, as is each right
   vector. Where that takes away much of a vector, the pass is made again.
3. The singular values and vectors of the small bidiagonal matrix give the components and
   deviations, as soon as those asked for no longer change.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import dropped, written

#: Entries become floor(SCALE * c) + SHIFT; beyond LARGEST they are set to it.
SCALE, SHIFT, LARGEST = 1024, 100_000, 1 << 44
BLOCK_ROWS = 1024
#: A triplet is done when its residual is below this share of the largest singular value.
TOLERANCE = 1e-14
_RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
_BLOCKS = "vec_id array<bigint>, deviation array<decimal(38,0)>, centred binary"


def _whole(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The integer entries of the batch's vectors, a row for each."""
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(np.clip(flat * SCALE, -LARGEST, LARGEST)).astype(np.int64) + SHIFT).reshape(-1, dim)


def _summed(df: DataFrame, work: Callable[[pa.RecordBatch], np.ndarray], size: int, kind: str = "double") -> list:
    """Sums over all batches of the ``size`` values that ``work`` makes of each: added up in the tasks, then by Spark."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                made = work(batch)
                total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total.tolist(), pa.float64() if kind == "double" else pa.decimal128(38, 0))], ["at", "value"])

    rows = df.mapInArrow(run, f"at int, value {kind}").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out: list = [0] * size
    for at, value in rows:
        out[at] = value
    return out


def _matrix(batch: pa.RecordBatch, dim: int) -> Iterator[np.ndarray]:
    for block in batch.column("centred"):
        yield np.frombuffer(block.as_buffer(), np.float64).reshape(-1, dim)


def _products(blocks: DataFrame, dim: int, c: np.ndarray) -> tuple[np.ndarray, float]:
    """X'Xc, and the square of the length of Xc."""

    def work(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(dim + 1)
        for x in _matrix(batch, dim):
            y = x @ c
            out[:dim] += x.T @ y
            out[dim] += y @ y
        return out

    found = np.array(_summed(blocks, work, dim + 1), np.float64)
    return found[:dim], float(found[dim])


def bidiagonalised(product: Callable[[np.ndarray], tuple[np.ndarray, float]], dim: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest singular values of X and their right vectors as columns; ``product``: X'Xc and the squared length of Xc.

    Fewer than ``wanted``, if X has a lower rank.
    """
    random = np.random.default_rng(13)
    right = np.zeros((dim, 0))  # v
    makes, back = np.zeros((dim, 0)), np.zeros((dim, 0))  # w with u = Xw, and X'u
    alphas: list[float] = []
    betas: list[float] = []

    def fresh() -> np.ndarray | None:
        """A unit vector orthogonal to all right vectors."""
        for _ in range(3 if right.shape[1] < dim else 0):
            v = random.standard_normal(dim)
            for _ in range(2):
                v -= right @ (right.T @ v)
            if (size := np.linalg.norm(v)) > 1e-8:
                return v / size
        return None

    v = fresh()
    while v is not None:
        right = np.column_stack((right, v))
        c = v - betas[-1] * makes[:, -1] if betas else v
        for _ in range(4):
            made, square = product(c)
            along = makes.T @ made  # of Xc with each u
            removed = float(along @ along)
            c, made = c - makes @ along, made - back @ along
            if removed <= 1e-6 * square:
                break
        alpha = np.sqrt(max(0.0, square - removed))
        scale = max([alpha, *alphas])
        if alpha <= 1e-12 * scale or scale == 0:
            alpha = 0.0
            makes, back = np.column_stack((makes, np.zeros(dim))), np.column_stack((back, np.zeros(dim)))
            rest = np.zeros(dim)
        else:
            makes, back = np.column_stack((makes, c / alpha)), np.column_stack((back, made / alpha))
            rest = back[:, -1] - alpha * v
        alphas.append(float(alpha))
        for _ in range(2):
            rest -= right @ (right.T @ rest)
        beta = float(np.linalg.norm(rest))
        if beta <= 1e-13 * scale:
            beta, v = 0.0, fresh()
        else:
            v = rest / beta
        small = np.diag(alphas) + np.diag(betas, 1)
        left_of, values, right_of = np.linalg.svd(small)
        done = min(wanted, len(values))
        # X'U of a triplet is its right vector up to beta times the last entry of the left one
        if beta and len(values) > wanted and np.all(beta * np.abs(left_of[-1, :done]) <= TOLERANCE * values[0]):
            break
        betas.append(beta)
    small = np.diag(alphas) + np.diag(betas[: len(alphas) - 1], 1)
    _, values, right_of = np.linalg.svd(small)
    found = right @ right_of.T
    keep = np.flatnonzero(values > 1e-9 * max(values[0], 1e-300) if len(values) else [])[:wanted]
    return values[keep], found[:, keep]


def whiten(vectors: DataFrame, *, components: int = 8) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error for each fit row and component.

    Columns used: vec_id, embedding. Rows whose vector is null or empty, or holds null or
    non-finite entries, are dropped; of vectors of several lengths only those of the most common
    one (the larger, if two are) are taken. An entry c becomes x = floor(1024 c) + 100000, c
    being kept within 2**34 for it. All n rows are fitted: components are unit eigenvectors of
    the covariance (divisor n) by falling eigenvalue e, each with its largest entry positive;
    whitened is the centred row along the component over sqrt(e), explained e over the trace,
    deviation (a decimal) the sum over dimensions of (n x - sum)**2, and identity_error the
    largest difference between the covariance of whitened and the identity.

    Directions without variance are no components, so equal rows, or one row, give none; nor
    does an empty table. Repeated and null ids: a row each. Other columns are not read.
    """
    vector = F.col("embedding").cast("array<double>")
    finite = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = vectors.where(finite & (F.size("embedding") > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    nothing = vectors.sparkSession.createDataFrame([], _RESULT)
    sizes = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if sizes is None:
        return nothing
    dim, n = sizes
    rows = rows.where(F.size("vector") == dim)

    sums = [int(s) for s in _summed(rows, lambda batch: _whole(batch, dim).sum(axis=0), dim, "decimal(38,0)")]
    largest = max(abs(s) for s in sums) + n * (LARGEST if n * LARGEST < 1 << 62 else 1 << 62)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                x = _whole(part, dim)
                if largest < 1 << 62:
                    apart = n * x - np.array(sums, np.int64)
                    centred = apart / n
                    small = int(np.abs(apart).max()) ** 2 * dim < 1 << 62
                    square = (apart * apart).sum(axis=1) if small else (apart.astype(object) ** 2).sum(axis=1)
                else:  # products beyond 64 bits, by whole numbers of any size
                    apart = n * x.astype(object) - np.array(sums, object)
                    centred, square = (apart / n).astype(np.float64), (apart**2).sum(axis=1)
                square = [Decimal(int(s)) for s in square]
                columns = [pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64())), pa.array([square], pa.list_(pa.decimal128(38, 0))), pa.array([centred.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "deviation", "centred"])

    blocks = written(rows.mapInArrow(pack, _BLOCKS))
    values, found = bidiagonalised(lambda c: _products(blocks, dim, c), dim, min(components, dim))
    if not len(values):
        dropped(blocks)
        return nothing
    found = found * np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])])
    turn, k = found / (values / np.sqrt(n)), len(values)
    trace = _summed(blocks, lambda batch: np.array([sum(float((x * x).sum()) for x in _matrix(batch, dim))]), 1)[0] / n
    means = np.array(_summed(blocks, lambda batch: sum(((x @ turn).sum(axis=0) for x in _matrix(batch, dim)), np.zeros(k)), k)) / n

    def covariance(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((k, k))
        for x in _matrix(batch, dim):
            y = x @ turn - means
            out += y.T @ y
        return out.ravel()

    error = float(np.abs(np.array(_summed(blocks, covariance, k * k)).reshape(k, k) / n - np.eye(k)).max())
    explained, names = values * values / n / trace, nothing.columns

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in enumerate(_matrix(batch, dim)):
                every = np.repeat(np.arange(len(x)), k)
                ids, square = (batch.column(c)[at].values.take(pa.array(every)) for c in ("vec_id", "deviation"))
                size = len(every)
                columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(size, n, np.int64)), square, pa.array((x @ turn).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(size, error))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return blocks.mapInArrow(project, _RESULT)
