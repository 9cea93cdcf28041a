"""Streams that act by the clock: beats while a key is silent, and values that live for a while.

State is kept by key in the RocksDB store, with timers in processing time, so a restart from the checkpoint goes on with
the timers and lifetimes that were running; Spark runs the first micro-batch after a restart when the next event, of any
key, comes. ``on_rocksdb`` chooses that store for a session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def on_rocksdb(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    return spark


class _Beats(StatefulProcessor):
    def __init__(self, key: str, silence_ms: int, most: int) -> None:
        self.key, self.silence, self.most = key, silence_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.beats = handle.getValueState("beats", "n int")

    def _wait(self, now: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + self.silence)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for _ in rows:  # what the events say doesn't matter, only that they came
            pass
        self.beats.update((0,))
        self._wait(timerValues.getCurrentProcessingTimeInMs())
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n = (self.beats.get()[0] if self.beats.exists() else 0) + 1
        if n < self.most:
            self.beats.update((n,))
            self._wait(timerValues.getCurrentProcessingTimeInMs())
        else:
            self.beats.clear()  # given up: nothing of the key is left until it speaks again
        yield pd.DataFrame({self.key: [key[0]], "beat": [n], "last": [n >= self.most]})

    def close(self) -> None:
        pass


def beats(events: DataFrame, key: str, *, silence: float = 25.0, most: int = 100) -> DataFrame:
    """A row (key, beat 1, 2, ..., last) whenever a key has had no event and no beat for ``silence`` seconds.

    An event starts the count anew. After ``most`` beats a key is given up, and its state with it.
    """
    kind = events.schema[key].dataType.simpleString()
    return events.select(key).groupBy(key).transformWithStateInPandas(_Beats(key, int(silence * 1000), most), f"`{key}` {kind}, beat int, last boolean", "append", "processingTime")


class _Remembered(StatefulProcessor):
    def __init__(self, key: str, value: str, order: str, kind: str, lifetime_ms: int) -> None:
        self.key, self.value, self.order, self.kind, self.lifetime = key, value, order, kind, lifetime_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", f"value {self.kind}", self.lifetime)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        known = self.held.get()[0] if self.held.exists() else None
        hits = []
        for value in asked[self.value]:
            hits.append(known is not None)
            if known is None:
                known = value
                self.held.update((value,))
        yield pd.DataFrame({self.key: [key[0]] * len(asked), self.order: asked[self.order].to_list(), "held": [known] * len(asked), "hit": hits})

    def close(self) -> None:
        pass


def remembered(requests: DataFrame, key: str, value: str, order: str, *, lifetime: float = 3600.0) -> DataFrame:
    """Each request with the value that its key holds, as ``held``, and whether it was held before, as ``hit``.

    A key holds the value of the first request that finds none, for ``lifetime`` seconds of the
    clock; the store drops it after that. Requests of one micro-batch go by ``order``.
    """
    kinds = {c: requests.schema[c].dataType.simpleString() for c in (key, value, order)}
    return requests.select(key, value, order).groupBy(key).transformWithStateInPandas(
        _Remembered(key, value, order, kinds[value], int(lifetime * 1000)), f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, held {kinds[value]}, hit boolean", "append", "processingTime"
    )
