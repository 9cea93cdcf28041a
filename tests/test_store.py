"""The store: what lands, what a crash leaves, batches that come again, and older versions."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.sources.store import Conflict, Store


def store(spark, tmp_path, **how):
    return Store.create(spark, str(tmp_path / "t"), "id long, value string", ["id"], buckets=4, **how)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, value string")


def rows(table, version=None):
    return sorted((tuple(r) for r in table.read(version).collect()), key=repr)


def test_changes_land_and_older_versions_stay(spark, tmp_path):
    made = store(spark, tmp_path)
    assert rows(made) == [] and made.versions() == [0]
    model, history = {}, {0: []}
    r = random.Random(1)
    for _ in range(6):
        some = {r.randrange(30): r.choice("abc") for _ in range(8)}
        if r.random() < 0.6:
            number = made.upsert(frame(spark, list(some.items())))
            model |= some
        else:
            number = made.delete(frame(spark, [(k, None) for k in some]).select("id"))
            model = {k: v for k, v in model.items() if k not in some}
        history[number] = sorted(model.items(), key=repr)
    again = Store(spark, str(tmp_path / "t"))
    assert all(rows(again, n) == want for n, want in history.items())
    with pytest.raises(FileExistsError):
        store(spark, tmp_path)
    assert again.vacuum(keep=1) > 0 and again.versions() == [max(history)] and rows(again) == history[max(history)]
    assert again.delete_where(F.col("value") == "a") and rows(again) == sorted(((k, v) for k, v in model.items() if v != "a"), key=repr)


def test_only_touched_buckets_are_written_again(spark, tmp_path):
    made = store(spark, tmp_path)
    made.upsert(frame(spark, [(k, "a") for k in range(100)]))
    before = made.version()
    made.upsert(frame(spark, [(5, "b")]))
    after = made.version()
    assert sum(before.parts[b] != after.parts[b] for b in range(4)) == 1 and len(rows(made)) == 100


def test_a_crash_before_the_rename_leaves_the_old_version(spark, tmp_path, monkeypatch):
    made = store(spark, tmp_path)
    made.upsert(frame(spark, [(1, "a"), (2, "b")]))

    def crash(self, version):
        raise OSError("the machine is gone")

    with monkeypatch.context() as broken:
        broken.setattr(Store, "_commit", crash)
        with pytest.raises(OSError):
            made.upsert(frame(spark, [(1, "z"), (3, "c")]))
    again = Store(spark, str(tmp_path / "t"))
    assert rows(again) == [(1, "a"), (2, "b")] and again.vacuum() > 0 and rows(again) == [(1, "a"), (2, "b")]
    again.upsert(frame(spark, [(1, "z"), (3, "c")]))
    assert rows(again) == [(1, "z"), (2, "b"), (3, "c")]


def test_a_writer_that_comes_second_starts_again(spark, tmp_path, monkeypatch):
    one, two = store(spark, tmp_path), Store(spark, str(tmp_path / "t"), tries=2)
    own = Store._commit
    late = []

    def commit(self, version):
        if self is two and not late:
            late.append(1)
            one.upsert(frame(spark, [(1, "one"), (7, "one")]))
        return own(self, version)

    monkeypatch.setattr(Store, "_commit", commit)
    two.upsert(frame(spark, [(1, "two")]))
    assert rows(one) == [(1, "two"), (7, "one")] and one.versions() == [0, 1, 2]
    monkeypatch.setattr(Store, "_commit", lambda self, version: False)
    with pytest.raises(Conflict):
        two.upsert(frame(spark, [(1, "x")]))


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    made = store(spark, tmp_path)
    land = made.sink("s", "append")
    for batch in (0, 1, 1, 0, 2):
        land(frame(spark, [(batch, "a"), (None, "n")]), batch)
    assert rows(made) == sorted([(b, "a") for b in range(3)] + [(None, "n")] * 3, key=repr) and made.version().batches == {"s": 2}
    made.sink("t")(frame(spark, [(0, "b"), (None, "m"), (None, "m")]), 0)
    assert rows(made) == sorted([(0, "b"), (1, "a"), (2, "a"), (None, "m")], key=repr)


def test_a_stream_that_starts_again(spark, tmp_path):
    source, made = str(tmp_path / "in"), store(spark, tmp_path)
    for k in range(3):
        frame(spark, [(k % 2, f"v{k}")]).write.mode("append").json(source)
        stream = spark.readStream.schema("id long, value string").json(source).writeStream.foreachBatch(made.sink("s")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        stream.awaitTermination()
    assert rows(made) == [(0, "v2"), (1, "v1")] and made.version().batches == {"s": 2}
    # without its checkpoint the stream begins anew, but the batches have landed
    spark.readStream.schema("id long, value string").json(source).writeStream.foreachBatch(made.sink("s")).option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start().awaitTermination()
    assert rows(made) == [(0, "v2"), (1, "v1")]


def test_buckets_of_the_callers_choice(spark, tmp_path):
    made = Store.create(spark, str(tmp_path / "t"), "id long, cell int", ["id"], by="cell")
    of = lambda some: spark.createDataFrame(some, "id long, cell int")
    made.upsert(of([(1, 0), (2, 0), (3, 5)]))
    made.upsert(of([(2, 5), (4, 9)]))  # a row changes its bucket
    assert rows(made) == [(1, 0), (2, 5), (3, 5), (4, 9)] and sorted(made.version().parts) == [0, 5, 9]
    assert sorted(r["id"] for r in made.read(buckets=[5, 7]).collect()) == [2, 3]
    made.delete(of([(1, None), (3, None), (77, None)]).select("id"))
    assert rows(made) == [(2, 5), (4, 9)] and sorted(made.version().parts) == [5, 9]
