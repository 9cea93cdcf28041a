"""Connected components of pairs of ids, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import dropped, written


def components(pairs: DataFrame) -> DataFrame:
    """(node, component) of each id in ``pairs`` (a, b); the component is its smallest id.

    In each round every node points to the one of itself and its neighbours with the
    smallest hash, and the pairs are contracted along these pointers, until none is left. As
    the order is random, a round takes away a share of the nodes of any path, so about log of
    the longest path rounds are needed. Each round is written to the shared folder. Self
    links and repeated pairs are allowed; null ids are left out.
    """
    links = written(pairs.where("a <> b").select("a", "b").distinct())
    rounds = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.xxhash64("b")).alias("least"), F.min_by("b", F.xxhash64("b")).alias("b"))
        pointers = written(best.select(F.col("a").alias("node"), F.when(F.xxhash64("a") < F.col("least"), F.col("a")).otherwise(F.col("b")).alias("to")))
        rounds.append(pointers)
        moved = links.join(pointers.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(pointers.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        left = written(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        dropped(links)
        links = left
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    dropped(links)
    labels = rounds[-1]
    for pointers in rounds[-2::-1]:
        later = labels.select(F.col("node").alias("to"), F.col("to").alias("end"))
        labels = pointers.join(later, "to", "left").select("node", F.coalesce("end", "to").alias("to"))
    labels = written(labels)
    out = written(labels.join(labels.groupBy("to").agg(F.min(F.least("node", "to")).alias("component")), "to").select("node", "component"))
    dropped(labels, *rounds)
    return out
