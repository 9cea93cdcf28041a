"""Words and hashes of a block of texts at once: numpy on the bytes of an Arrow string column.

Spark reads, deals and shuffles the rows; these helpers only work on what one task holds,
about half a megabyte of text at a time (or one text, if that is longer).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BLOCK_BYTES = 1 << 19

#: ASCII white space: what lies between words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are not part of a letter, for ASCII; all others are taken as letters.
NOT_LETTER = np.array([b < 0x80 and not chr(b).isalpha() for b in range(256)])
#: A-Z to a-z, all else unchanged.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

#: Words of more bytes are hashed one by one.
LONG_WORD = 64
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads each of the 64 bits over all; in place."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(31)
    return h


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of ordered pairs of hashes."""
    b = b * _ODD[1]
    turned = b >> np.uint64(29)
    b <<= np.uint64(35)
    b |= turned
    b ^= a * _ODD[0]
    return mixed(b)


def byte_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of data[first:last] for each pair, by eight bytes at a time; long ones by BLAKE2. Other seeds: others."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    size = last - first
    h = mixed((size.astype(np.uint64) + np.uint64(seed << 56)) * _ODD[0] + _ODD[1])
    left, done = np.flatnonzero((size > 0) & (size <= LONG_WORD)), 0
    while len(left):
        here = np.minimum(8, size[left] - done).astype(np.uint64)
        part = eight[first[left] + done] & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * here))
        h[left] = mixed(h[left] ^ (part * _ODD[1]))
        done += 8
        left = left[size[left] > done]
    for k in np.flatnonzero(size > LONG_WORD):
        h[k] = int.from_bytes(hashlib.blake2b(data[first[k] : last[k]].tobytes(), digest_size=8, salt=bytes([seed])).digest(), "little")
    return h


class Words:
    """Words of a block: text number, first and last (exclusive) byte, in order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> None:
        inside = ~between[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = offsets[:-1][offsets[:-1] < len(data)]
        begins[cut] = inside[cut]
        cut = offsets[1:][offsets[1:] > 0] - 1
        ends[cut] = inside[cut]
        self.first, self.last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.bounds = np.searchsorted(self.first, offsets)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))
        self.data = data

    def __len__(self) -> int:
        return len(self.first)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return byte_hashes(self.data, self.first, self.last, seed)

    def prefixes(self, n: int) -> np.ndarray:
        """Hashes of the first n bytes of the words that are longer; 0 for others."""
        out, longer = np.zeros(len(self), np.uint64), np.flatnonzero(self.last - self.first > n)
        out[longer] = byte_hashes(self.data, self.first[longer], self.first[longer] + n)
        return out

    def grams(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n consecutive words of one text, and the number of the first word.

        Those of 2, 4, 8 and so on words are pairs of the ones before; n is put together from them.
        """
        at = np.arange(max(0, len(self) - n + 1))
        at = at[self.text[at] == self.text[at + n - 1]] if len(at) else at
        out, done, power, size = None, 0, hashes, 1
        while len(at):
            if n & size:
                here = power[at + done]
                out, done = here if out is None else paired(out, here), done + size
            if done == n:
                return out, at
            power, size = paired(power[:-size], power[size:]), 2 * size
        return np.zeros(0, np.uint64), at


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its texts; null: empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def blocks(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batch with about BLOCK_BYTES of text, and their bytes and offsets."""
    if not batch.num_rows:
        return
    data, offsets = bytes_of(batch.column(text))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK_BYTES, "right")) - 1)
        yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def map_blocks(df: DataFrame, text: str, work: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``work`` on each block of each partition: rows, bytes and offsets in, rows out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in blocks(batch, text):
                if (out := work(rows, data, offsets)) is not None and out.num_rows:
                    yield out
            batch = rows = data = offsets = out = None  # not kept while the next batch is read

    return df.mapInArrow(run, schema)


def extend(df: DataFrame, text: str, work: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], list[pa.Array]], fields: dict[str, str]) -> DataFrame:
    """``df`` with more columns, which ``work`` makes from each block; fields: names and Spark types."""

    def run(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, *work(rows, data, offsets)], [*rows.schema.names, *fields])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields} | fields
    return map_blocks(df, text, run, ", ".join(f"`{k}` {v}" for k, v in kinds.items()))


def summed(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i + 1]]; 0 where that is empty."""
    sums = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def code_points(data: np.ndarray) -> np.ndarray:
    """For each byte position, and the end, how many code points begin before it."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
