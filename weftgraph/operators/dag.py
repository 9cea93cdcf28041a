"""Dependency graphs: levels, cycles, readiness, fingerprints, budgets. Edges say task needs dep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.sources.tables import dropped, written

from .state import running_total


#: So many rounds of ``levels`` pass before chains are first contracted; each contraction doubles the wait for the next.
PATIENCE = 16


def _contracted(edges: DataFrame, left: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``edges`` (task, dep, step) and ``left`` (task, n, low) without tasks that wait for one other only, and these:
    (task, anchor, step, low), whose level is the greater of low and the anchor's level + step.

    Each of them points to what it waits for; pointers double until they lead to tasks that wait for several
    others, so a chain of n takes log n rounds. Pointers that never do are on a cycle, or lead to one; those stay.
    """
    open_edges = edges.join(left.select("task"), "task", "left_semi").join(left.select(F.col("task").alias("dep")), "dep", "left_semi")
    single = open_edges.join(left.where("n = 1").select("task", "low"), "task")
    pointers = written(single.select("task", F.col("dep").alias("anchor"), "step", "low"))
    rounds = max(1, pointers.count()).bit_length()
    for _ in range(rounds):
        ahead = pointers.select(F.col("task").alias("anchor"), F.col("anchor").alias("next"), F.col("step").alias("more"), F.col("low").alias("bar"))
        moved = pointers.join(ahead, "anchor", "left")
        low = F.greatest("low", F.col("bar") + F.col("step"))  # greatest ignores nulls
        now = written(moved.select("task", F.coalesce("next", "anchor").alias("anchor"), (F.col("step") + F.coalesce("more", F.lit(0))).alias("step"), low.alias("low"), F.col("next").isNotNull().alias("moved")))
        dropped(pointers)
        pointers = now
        if now.where("moved").isEmpty():
            break
    settled = written(pointers.join(pointers.select(F.col("task").alias("anchor")), "anchor", "left_anti").select("task", "anchor", "step", "low"))
    dropped(pointers)
    # what remains waits for the anchors of what it waited for
    rest = open_edges.join(settled.select("task"), "task", "left_anti")
    ahead = settled.select(F.col("task").alias("dep"), "anchor", F.col("step").alias("more"), F.col("low").alias("bar"))
    rest = written(rest.join(ahead, "dep", "left").select("task", F.coalesce("anchor", "dep").alias("dep"), (F.col("step") + F.coalesce("more", F.lit(0))).alias("step"), (F.col("bar") + F.col("step")).alias("bar")))
    joined = written(rest.groupBy("task", "dep").agg(F.max("step").alias("step")))
    lows = rest.groupBy("task").agg(F.max("bar").alias("bar"), F.countDistinct("dep").alias("needs"))
    fewer = written(left.join(settled.select("task"), "task", "left_anti").join(lows, "task", "left").select("task", F.coalesce("needs", F.lit(0)).alias("n"), F.greatest("low", "bar").alias("low")))
    dropped(rest)
    return joined, fewer, settled


def levels(tasks: DataFrame, needs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(task, level) by repeatedly taking the tasks whose needs are all done, and the needs
    (task, dep) that remain, which is empty exactly if there is no cycle. Needs of unknown tasks
    are left out.

    Each task keeps the number of needs that are left and the level that those done put it at
    least on; the edges are written once and only read by what was done last. Where tasks are
    left after ``PATIENCE`` rounds, chains of tasks with one need left each are contracted, so
    a long chain isn't a round for each of its tasks.
    """
    known = tasks.select("task").distinct()
    every = written(needs.select("task", "dep").distinct().join(known, "task", "left_semi").join(known.withColumnRenamed("task", "dep"), "dep", "left_semi").select("task", "dep", F.lit(1).cast("long").alias("step")))
    edges = every
    left = written(known.join(every.groupBy("task").agg(F.count(F.lit(1)).alias("n")), "task", "left").select("task", F.coalesce("n", F.lit(0)).alias("n"), F.lit(0).cast("long").alias("low")))
    done, chains, waited, wait = None, [], 0, PATIENCE
    while True:
        free = written(left.where("n = 0").select("task", F.col("low").alias("level")))
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free)
        ahead = edges.join(free.select(F.col("task").alias("dep"), "level"), "dep")
        fewer = ahead.groupBy("task").agg(F.count(F.lit(1)).alias("fewer"), F.max(F.col("level") + F.col("step")).alias("bar"))
        now = written(left.where("n > 0").join(fewer, "task", "left").select("task", (F.col("n") - F.coalesce("fewer", F.lit(0))).alias("n"), F.greatest("low", "bar").alias("low")))
        dropped(left)
        left, waited = now, waited + 1
        if waited >= wait and not left.isEmpty():
            before, old = edges, left
            edges, left, settled = _contracted(before, old)
            dropped(old, None if before is every else before)
            chains.append(settled)
            waited, wait = 0, 2 * wait
    done = free if done is None else done
    for settled in reversed(chains):
        ends = settled.join(done.select(F.col("task").alias("anchor"), "level"), "anchor")
        done = written(done.unionByName(ends.select("task", F.greatest("low", F.col("level") + F.col("step")).alias("level"))))
    undone = known.join(done.select("task"), "task", "left_anti") if chains else left
    dropped(*chains)
    remaining = every.join(undone.select(F.col("task").alias("dep")), "dep", "left_semi").select("task", "dep")
    return done.withColumn("level", F.col("level").cast("int")), remaining


def problems(tasks: DataFrame, needs: DataFrame) -> DataFrame:
    """(problem, task): needs that no task is, and tasks without any edge if there are several."""
    missing = needs.select(F.col("dep").alias("task")).distinct().join(tasks.select("task"), "task", "left_anti").select(F.lit("missing").alias("problem"), "task")
    ends = needs.select("task").unionByName(needs.select(F.col("dep").alias("task"))).distinct()
    orphans = tasks.select("task").join(ends, "task", "left_anti").select(F.lit("orphan").alias("problem"), "task")
    return missing.unionByName(orphans)


def ready(tasks: DataFrame, needs: DataFrame) -> DataFrame:
    """Unfinished tasks (task, finished) all of whose needs are finished."""
    state = tasks.select(F.col("task").alias("dep"), F.col("finished").alias("dep_done"))
    waiting = needs.join(state, "dep", "left").where(~F.coalesce("dep_done", F.lit(False))).select("task").distinct()
    return tasks.where("NOT finished").join(waiting, "task", "left_anti")


def progress_state(tasks: DataFrame, needs: DataFrame) -> DataFrame:
    """One row: tasks, finished, ready, and state done, running or stalled."""
    counts = tasks.agg(F.count(F.lit(1)).alias("tasks"), F.count(F.when(F.col("finished"), 1)).alias("finished"))
    n = ready(tasks, needs).agg(F.count(F.lit(1)).alias("ready"))
    state = F.when(F.col("tasks") == F.col("finished"), "done").when(F.col("ready") > 0, "running").otherwise("stalled")
    return counts.join(F.broadcast(n)).withColumn("state", state)


def parallel_groups(needs: DataFrame) -> DataFrame:
    """A row for each task with the same set of needs as others: deps, n (how many there are), task."""
    sets = needs.groupBy("task").agg(F.array_join(F.array_sort(F.collect_set("dep")), ",").alias("deps"))
    return sets.join(sets.groupBy("deps").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "deps").select("deps", "n", "task")


def fingerprint(phase: Column, hashes: Column) -> Column:
    """sha256 of the phase and its sorted hashes (those of one phase's artifacts): their order doesn't matter."""
    return F.sha2(F.concat(phase, F.lit(":"), F.array_join(F.array_sort(hashes), ",")), 256)


def dirty(phases: DataFrame, cascade: DataFrame, changed: DataFrame) -> DataFrame:
    """Phases present (phase) that lie downstream (phase, later) of a changed one."""
    later = cascade.join(changed, "phase", "left_semi").select(F.col("later").alias("phase")).distinct()
    return phases.join(later, "phase", "left_semi")


def within_budget(calls: DataFrame, key: str, order: str, most_calls: int, most_tokens: int) -> DataFrame:
    """``calls`` (tokens) with left_calls, left_tokens after each, and allowed. A key with many calls is many ranges."""
    used = running_total(calls, key, [order], F.lit(1), "used_calls")
    used = running_total(used, key, [order], F.col("tokens"), "used_tokens")
    left = used.withColumns({"left_calls": most_calls - F.col("used_calls"), "left_tokens": most_tokens - F.col("used_tokens")}).drop("used_calls", "used_tokens")
    return left.withColumn("allowed", (F.col("left_calls") >= 0) & (F.col("left_tokens") >= 0))
