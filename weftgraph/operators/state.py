"""Tables of state: upserts, deletions with counts, snapshots, merges of maps and lists."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.sources.tables import written


def upserted(old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """All rows by key: the new one where there is one (of several the first in ``order``)."""
    both = old.withColumn("age", F.lit(1)).unionByName(new.withColumn("age", F.lit(0)), allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("age", *order))
    return both.withColumn("rank", rank).where("rank = 1").drop("rank", "age")


def _running(rows: DataFrame, key: str, order: Sequence[str], value: Column, name: str, of: Callable[[str], Column], before: bool = False) -> DataFrame:
    """``rows`` with ``name``: ``of`` the values up to each row of its key, in ``order``; with ``before`` without the row's own.

    The rows are dealt to ranges of key and order, so a key with many rows is many groups:
    whole ranges first, then inside each.
    """
    ranged = written(rows.withColumn(name, value).repartitionByRange(key, *order).withColumn("in_range", F.spark_partition_id()))
    held = ranged.groupBy(key, "in_range").agg(of(name).alias("held"))
    earlier = Window.partitionBy(key).orderBy("in_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(F.col(key).alias("of_key"), F.col("in_range").alias("of_range"), of("held").over(earlier).alias("offset"))
    inside = Window.partitionBy(key, "in_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    joined = ranged.join(offsets, F.col(key).eqNullSafe(F.col("of_key")) & (F.col("in_range") == F.col("of_range")))
    return joined.withColumn("inside", of(name).over(inside)).drop("of_key", "of_range", "in_range", name)


def running_total(rows: DataFrame, key: str, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` up to each row of its key, in ``order``, however many rows a key has."""
    out = _running(rows, key, order, value, name, F.sum)
    return out.withColumn(name, F.coalesce("offset", F.lit(0)) + F.col("inside")).drop("offset", "inside")


def running_greatest(rows: DataFrame, key: str, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the greatest ``value`` of the rows of its key before each, in ``order``; null for the first."""
    return _running(rows, key, order, value, name, F.max, before=True).withColumn(name, F.greatest("offset", "inside")).drop("offset", "inside")


def uncovered(bounds: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """key, first, last: what ``ranges`` (key, first, last; they may overlap) leave of ``bounds`` (key, first, last; one for each key).

    A sweep by first with the greatest end so far, in ranges of key and first, so a key with
    many ranges is many groups. Ranges may reach over the bounds; those that end before they
    begin, or have a null, cover nothing; keys without bounds are left out.
    """
    low, high = F.col("low"), F.col("high")
    within = bounds.select(key, F.col("first").alias("low"), F.col("last").alias("high"))
    good = ranges.where("first <= last").select(key, "first", "last").join(within, key).where((F.col("last") >= low) & (F.col("first") <= high))
    swept = written(running_greatest(good, key, ["first", "last"], F.col("last"), "reached"))
    between = swept.select(key, F.coalesce(F.greatest(F.col("reached") + 1, low), low).alias("first"), (F.col("first") - 1).alias("last"))
    ends = swept.groupBy(key).agg(F.max("last").alias("reached"))
    after = within.join(ends, key, "left").select(key, F.coalesce(F.greatest(F.col("reached") + 1, low), low).alias("first"), high.alias("last"))
    return between.unionByName(after).where("first <= last")


def larger(a: Column, b: Column) -> Column:
    """The larger of two values; the one that is there, if the other is null."""
    return F.greatest(a, b)


def joined_texts(a: Column, b: Column, separator: str = "\n") -> Column:
    """Both texts with the separator between; an empty or null one leaves the other as it is."""
    return F.concat_ws(separator, F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def by_success(results: DataFrame, error: str) -> tuple[DataFrame, DataFrame]:
    """Results without an error (null or empty), and those with one."""
    failed = F.coalesce(F.col(error) != "", F.lit(False))
    return results.where(~failed), results.where(failed)


def merged_outputs(outputs: DataFrame, resolutions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outputs of agents (task, agent, output) by task, and the conflicts among them.

    A task on whose output its agents differ is a conflict: task and number of outputs. The merged
    table (task, output, source) has the resolution (task, resolution) where there is one, else
    the output of the first agent by name.
    """
    several = outputs.groupBy("task").agg(F.count_distinct("output").alias("outputs"), F.min_by("output", "agent").alias("first"))
    conflicts = several.where("outputs > 1").select("task", "outputs")
    merged = several.join(resolutions, "task", "left")
    source = F.when(F.col("resolution").isNotNull(), "resolution").when(F.col("outputs") > 1, "conflict").otherwise("agent")
    return merged.select("task", F.coalesce("resolution", "first").alias("output"), source.alias("source")), conflicts


def retried(failed: DataFrame, again: DataFrame, key: str) -> DataFrame:
    """Failure counts (key, retries, error) after the failures in ``again`` (key, error)."""
    newest = again.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("error").alias("latest"))
    joined = failed.join(newest, key, "full_outer")
    return joined.select(key, (F.coalesce("retries", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("retries"), F.coalesce("latest", "error").alias("error"))


def without(rows: DataFrame, victims: DataFrame, key: Sequence[str]) -> DataFrame:
    return rows.join(victims.select(*key).distinct(), list(key), "left_anti")


def deleted_counts(tables: dict[str, DataFrame], condition: Column) -> DataFrame:
    """How many rows of each table the condition would delete, and the total."""
    parts = [df.where(condition).select(F.lit(name).alias("label")) for name, df in tables.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.rollup("label").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("label", F.lit("total")).alias("label"), "n")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """key and change: added, deleted or modified; unchanged rows are left out."""
    a, b = before.select(key, F.col(digest).alias("was")), after.select(key, F.col(digest).alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "modified")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change IS NOT NULL")


def checkpoint_counts(rows: DataFrame, group: str, status: str, states: Sequence[str], amount: str, finished: str) -> DataFrame:
    """Per group: rows by state, and the sum of ``amount`` of finished ones."""
    by_state = [F.count(F.when(F.col(status) == s, 1)).alias(s) for s in states]
    return rows.groupBy(group).agg(*by_state, F.coalesce(F.sum(F.when(F.col(status) == finished, F.col(amount))), F.lit(0.0)).alias("amount"))


def merged_maps(a: Column, b: Column) -> Column:
    """Keys of both; b's value where it has one."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(y, x))


def appended_unique(a: Column, b: Column) -> Column:
    return F.array_distinct(F.concat(a, b))


def capped_log(log: Column, entries: Column, most: int) -> Column:
    """The last ``most`` entries."""
    every = F.concat(log, entries)
    return F.slice(every, F.greatest(F.lit(1), F.size(every) - most + 1), F.lit(most))


def last_of(rows: DataFrame, key: str, order: Sequence[Column], most: int) -> DataFrame:
    """The last ``most`` rows of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= most).drop("place")


def promoted(nodes: DataFrame, attrs: str, fields: Sequence[str]) -> DataFrame:
    """JSON fields as columns, where the column is missing or null; running it again changes nothing."""
    out = nodes
    for f in fields:
        value = F.get_json_object(attrs, f"$.{f}")
        out = out.withColumn(f, F.coalesce(F.col(f), value) if f in nodes.columns else value)
    return out


def duplicates(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that are there more than once: what a unique constraint would reject."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def islands(rows: DataFrame, group: str, number: str) -> DataFrame:
    """Runs of consecutive numbers: group, first, last. A group with many numbers is many ranges."""
    before = running_greatest(rows.select(group, number).distinct(), group, [number], F.col(number), "before")
    begins = F.when(F.col(number) == F.col("before") + 1, 0).otherwise(1)
    runs = running_total(before.withColumn("begins", begins).drop("before"), group, [number], F.col("begins"), "run")
    return runs.groupBy(group, "run").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("run")


def patched(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Partial updates: columns of ``changes`` that are not null replace those of the row with the same key."""
    mine = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *(F.col(c).alias(f"new_{c}") for c in mine))
    joined = rows.join(renamed, key, "left")
    return joined.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in mine else F.col(c) for c in rows.columns))


def soft_deleted(rows: DataFrame, victims: DataFrame, key: str, when: Column, column: str = "deleted_at") -> DataFrame:
    """Rows of ``victims`` get ``when`` in ``column``, if they have none yet; nothing is taken away."""
    gone = victims.select(key).distinct().withColumn("gone", F.lit(True))
    return rows.join(gone, key, "left").withColumn(column, F.when(F.col("gone"), F.coalesce(column, when)).otherwise(F.col(column))).drop("gone")


def validated(repositories: DataFrame, repo_id: str, style: str = "strict") -> bool | str | None:
    """Whether a repository (repo_id, status) is there and ready.

    ``strict`` raises LookupError or ValueError; ``bool`` tells, and takes completed for ready;
    ``message`` gives a sentence, or None if all is well.
    """
    found = repositories.where(F.col("repo_id") == repo_id).select(F.lower("status")).limit(1).collect()
    status = found[0][0] if found else None
    if style == "bool":
        return status in ("ready", "completed")
    said = None if status == "ready" else f"Repository {repo_id!r} is {status}." if status else f"Repository {repo_id!r} not found."
    if style == "message" or said is None:
        return said
    raise ValueError(said) if status else LookupError(said)
