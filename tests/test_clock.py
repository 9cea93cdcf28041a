"""Streams by the clock, with a restart."""

import time

import pytest

pytest.importorskip("google.protobuf")

from weftgraph.streaming import clock  # noqa: E402


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield clock.on_rocksdb(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def started(df, tmp_path, seen):
    return df.writeStream.foreachBatch(lambda rows, _: seen.extend(tuple(r) for r in rows.collect())).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="500 milliseconds").start()


def until(condition, seconds=90):
    end = time.time() + seconds
    while not condition() and time.time() < end:
        time.sleep(0.2)
    return condition()


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(path)


def test_silence_makes_beats_and_a_restart_goes_on(rocks, tmp_path):
    source, schema = str(tmp_path / "in"), "client string, n int"
    put(rocks, source, [("a", 1), ("b", 1)], schema)
    stream = lambda: clock.beats(rocks.readStream.schema(schema).json(source), "client", silence=2, most=3)
    seen = []
    query = started(stream(), tmp_path, seen)
    assert until(lambda: {c for c, *_ in seen} == {"a", "b"})
    query.stop()
    query.awaitTermination(30)
    assert all(first == 1 for first in {c: n for c, n, _ in reversed(seen)}.values())
    query = started(stream(), tmp_path, seen)  # the timers that were running go on with the next event of any key
    put(rocks, source, [("c", 1)], schema)
    assert until(lambda: ("a", 3, True) in seen and ("b", 3, True) in seen)
    put(rocks, source, [("a", 2)], schema)
    assert until(lambda: [x for x in seen if x[0] == "a"][-1][1] < 3)
    query.stop()
    assert sorted({n for c, n, _ in seen if c == "b"}) == [1, 2, 3]


def test_values_live_for_a_while(rocks, tmp_path):
    source, schema, seen = str(tmp_path / "in"), "k string, v string, n int", []
    put(rocks, source, [("a", "x", 1), ("a", "y", 2), ("b", "z", 3)], schema)
    query = started(clock.remembered(rocks.readStream.schema(schema).json(source), "k", "v", "n", lifetime=20), tmp_path, seen)
    assert until(lambda: len(seen) == 3)
    put(rocks, source, [("a", "w", 4)], schema)
    assert until(lambda: len(seen) == 4)
    time.sleep(21)
    put(rocks, source, [("a", "late", 5)], schema)
    assert until(lambda: len(seen) == 5)
    query.stop()
    assert sorted(seen, key=lambda x: x[1])[:3] == [("a", 1, "x", False), ("a", 2, "x", True), ("b", 3, "z", False)] and seen[4] == ("a", 5, "late", False)
