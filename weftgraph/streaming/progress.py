"""Progress events: validation, percentages, and Structured Streaming over them.

The batch functions work on streams too. Windows and watermarks are extensions of this engine.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Retrieval steps, of eight.
STEPS = {"initializing": 1, "question_analyzed": 2, "embedding_generation": 3, "vector_search": 4, "graph_expansion": 5, "context_ranking": 6, "agent_analyzing": 7, "formatting_response": 8, "complete": 8}


def valid(events: DataFrame) -> DataFrame:
    """Events with phase and message, and a percent of -1 or 0 to 100."""
    named = (F.coalesce(F.trim("phase"), F.lit("")) != "") & (F.coalesce(F.trim("message"), F.lit("")) != "")
    return events.where(named & ((F.col("percent") == -1) | F.col("percent").between(0, 100)))


def step_percent(step: Column) -> Column:
    """An unknown or missing step is at 0."""
    number = F.create_map(*(F.lit(x) for kv in STEPS.items() for x in kv))[step]
    return F.coalesce(number, F.lit(0)) * 100.0 / 8


def phase_percent(phase: Column, counters: Mapping[str, tuple[Column, Column]], default: tuple[Column, Column]) -> Column:
    """done / total of the phase's own counters, else of the default ones; 0 without a total."""

    def share(done: Column, total: Column) -> Column:
        return F.when(total > 0, 100.0 * done / total).otherwise(F.lit(0.0))

    out = share(*default)
    for name, pair in counters.items():
        out = F.when(phase == name, share(*pair)).otherwise(out)
    return out


def overall_progress(weights: Mapping[str, float], completed: Column, current: Column, progress: Column) -> Column:
    """Sum of the weights of completed phases (array), and of the current one's share; at most 1."""
    total = F.lit(0.0)
    for phase, weight in weights.items():
        part = F.when(current == phase, weight * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(progress, F.lit(0.0))))).otherwise(F.lit(0.0))
        total = total + F.when(F.array_contains(completed, phase), F.lit(weight)).otherwise(part)
    return F.least(F.lit(1.0), total)


def workflow_percent(events: DataFrame, workflow: str, node: str, total: int) -> DataFrame:
    """Distinct nodes done of ``total``, at most 100; -1 where the workflow has no fixed total."""
    done = events.groupBy(workflow).agg(F.count_distinct(node).alias("done"))
    percent = F.least(F.lit(100.0), 100.0 * F.col("done") / total) if total > 0 else F.lit(-1.0)
    return done.select(workflow, percent.alias("percent"))


def stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files in a folder; the rate is limited, nothing is dropped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by key and tumbling window; those later than ``late`` are left out (extension)."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by key and session window (extension)."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))


def latest_state(events: DataFrame, key: str, order: str) -> DataFrame:
    """The newest event of each key, for complete or update mode."""
    return events.groupBy(key).agg(F.max(F.struct(order, *(c for c in events.columns if c not in (key, order)))).alias("latest")).select(key, "latest.*")


def into(events: DataFrame, consume: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``consume`` on each micro-batch of what is there now; restarting goes on from the checkpoint."""
    return events.writeStream.foreachBatch(consume).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def numbered(events: DataFrame, key: str, order: str) -> DataFrame:
    """``events`` with ``sequence``: 1, 2, 3 ... for each key, in order of arrival and, within a
    micro-batch, of ``order``. The count of each key is the only state; each micro-batch of a key
    goes through one task."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def number(_, frames, state: GroupState):
        import pandas as pd

        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        done = state.get[0] if state.exists else 0
        rows["sequence"] = range(done + 1, done + len(rows) + 1)
        state.update((done + len(rows),))
        yield rows

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    return events.groupBy(key).applyInPandasWithState(number, f"{kinds}, sequence long", "done long", "append", GroupStateTimeout.NoTimeout)


def expiring(events: DataFrame, key: str, time: str, lifetime: str = "1 hour") -> DataFrame:
    """One row for each key and hour-like span in which it was alive: a key lives ``lifetime`` after
    its last event, and is given out once the watermark has passed that."""
    return events.withWatermark(time, "0 seconds").groupBy(F.session_window(time, lifetime), key).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("session_window.end").alias("expired_at"), "events")
