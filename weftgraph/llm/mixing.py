"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import WORD, written

#: Quality weights that a document can have, from poor to good.
LEVELS = (0.25, 0.5, 0.75, 1.0)
#: So many ranges a source has at most: their sums meet in one task.
MOST_RANGES = 100_000
#: So many sources at most are sent to all executors, about 150 bytes each.
BROADCAST_ROWS = 20_000


def text_quality(text: Column, size: Column) -> Column:
    """1 to 4, the place in ``LEVELS``: how usual the mean word length is."""
    mean = F.length(text) / size
    return (
        F.when(size == 0, 1)
        .when((mean >= 4) & (mean < 8), 4)
        .when((mean >= 3) & (mean < 10), 3)
        .otherwise(2)
    )


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """A row for each source with its ``target`` words.

    Sources in code point order (null last) weigh ``weights``, repeating, and split
    ``share`` times all words; none gets more than ``cap`` times its own words, and what
    is over goes to the others by weight. With sources sorted by cap / weight, a source is
    capped exactly if its cap is not above what it would get once all before it are capped.
    """
    everywhere = Window.partitionBy()
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(in_order) - 1) % len(weights) + 1)
    left = F.lit(share) * F.sum("source_size").over(everywhere) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    return (
        sizes.withColumn("weight", weight)
        .withColumn("most", F.lit(cap) * F.col("source_size"))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("level", left / (F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("capped", F.col("ratio") <= F.col("level"))
        .withColumn("level", F.max(F.when(~F.col("capped"), F.col("level"))).over(everywhere))
        .withColumn("target", F.when(F.col("capped"), F.col("most")).otherwise(F.col("level") * F.col("weight")))
        .drop("weight", "most", "ratio", "level", "capped")
    )


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 0,
    bucket_rows: int = 512,
    keep: Sequence[str] = (),
) -> DataFrame:
    """How many words of each document the mix takes.

    Columns used: doc_id, text, source. Returns ``keep`` columns, doc_id, source, size,
    source_size, target, epochs and taken. A source takes as many complete epochs as fit
    into its target; the rest is filled in the order of exponential keys -ln(u) / quality
    (u is a hash of the row, so reruns agree) until the budget is used up, the last
    document in part. The prefix sums run in two steps, over equally likely key ranges of
    about ``bucket_rows`` rows (more in sources of many millions) and inside each, so that
    one hot source is many groups.

    Null text: size 0. Null source: a source of its own, last. Repeated rows count each
    time; equal keys only come from equal rows. An empty table gives an empty result.
    """
    text, extra = F.coalesce(F.col("text"), F.lit("")), {f"keep_{k}": F.col(c) for k, c in enumerate(keep)}
    rows = docs.select(*(c.alias(k) for k, c in extra.items()), "doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), text.alias("text"))
    unit = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rows = rows.withColumn("grade", text_quality(F.col("text"), F.col("size"))).withColumn("unit", unit).drop("text")
    rows = written(rows.withColumn("key", -F.log("unit") / F.element_at(F.array(*map(F.lit, LEVELS)), F.col("grade"))).drop("unit"))

    graded = [F.count(F.when(F.col("grade") == k, 1)).alias(f"graded_{k}") for k in range(1, len(LEVELS) + 1)]
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"), *graded)
    targets = source_targets(sizes, weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("budget", F.floor("target") - F.col("epochs") * F.col("source_size"))
    targets = targets.withColumn("ranges", F.least(F.ceil(F.col("rows") / bucket_rows), F.lit(MOST_RANGES))).withColumnRenamed("source", "of_source")

    below = sum((F.col(f"graded_{k}") * (1 - F.exp(-q * F.col("key"))) for k, q in enumerate(LEVELS, 1)), F.lit(0.0)) / F.col("rows")
    targets = written(targets)
    if targets.count() <= BROADCAST_ROWS:
        targets = F.broadcast(targets)  # beyond that, adaptive execution splits the hot sources of the join
    placed = rows.join(targets, rows.source.eqNullSafe(targets.of_source))
    placed = placed.withColumn("range", F.least(F.floor(below * F.col("ranges")), F.col("ranges") - 1))
    placed = placed.select(*extra, "doc_id", "source", "size", "key", "source_size", "target", "epochs", "budget", "range", F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("unnamed"))

    sums = placed.groupBy("name", "unnamed", "range").agg(F.sum("size").alias("held"))
    earlier = Window.partitionBy("name", "unnamed").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("offset", F.coalesce(F.sum("held").over(earlier), F.lit(0))).drop("held")
    inside = Window.partitionBy("name", "unnamed", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(sums, ["name", "unnamed", "range"]).withColumn("reached", F.col("offset") + F.sum("size").over(inside) - F.col("size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("reached")))
    return out.select(*(F.col(k).alias(c) for k, c in zip(extra, keep, strict=True)), "doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + part).alias("taken"))
