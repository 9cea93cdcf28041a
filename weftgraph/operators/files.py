"""Work on one file, or one piece of a text, at a time, in tasks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: So many rows, or results from so many characters, leave a task at a time.
ROWS, CHARACTERS = 2000, 1_000_000
#: Tasks for each core: files differ in length.
TASKS_A_CORE = 4

_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def spread(files: DataFrame, *by: str) -> DataFrame:
    """Dealt anew by ``by``: work on a text takes long for its size, and a small table, or a compressed one, is few tasks."""
    spark = files.sparkSession
    tasks = max(TASKS_A_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(tasks, *by)


def mapped(rows: DataFrame, work: Callable[..., Iterable[dict]], schema: str) -> DataFrame:
    """What ``work`` gives for the values of each row; ``schema`` is a list of names and types. Rows leave as they come."""
    fields = [c.split() for c in schema.split(", ")]
    names = pa.schema([(name, _ARROW[kind]) for name, kind in fields])

    return rows.mapInArrow(lambda batches: in_batches(batches, work, names), schema)


def in_batches(batches: Iterable[pa.RecordBatch], work: Callable[..., Iterable[dict]], names: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``work`` on the values of each row, and at most ``ROWS`` results at a time."""
    out: list[dict] = []
    read = 0
    for batch in batches:
        for k in range(batch.num_rows):
            values = [c[k].as_py() for c in batch.columns]
            read += sum(len(v) for v in values if isinstance(v, str))
            for row in work(*values):
                out.append(row)
                if len(out) >= ROWS:
                    yield pa.RecordBatch.from_pylist(out, names)
                    out = []
            if read >= CHARACTERS:
                if out:
                    yield pa.RecordBatch.from_pylist(out, names)
                out, read = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, names)
