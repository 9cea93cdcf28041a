"""Neighbours, traversals, paths and degrees on edges (src, dst[, edge_type]).

Iterations run on the driver, one level at a time, and write each level to the shared folder;
what a level needs are joins on ids, so the graph may be of any size. Truncations have a
total order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.sources.tables import dropped, written


def of_types(edges: DataFrame, types: Sequence[str] | None) -> DataFrame:
    return edges.where(F.col("edge_type").isin(*types)) if types else edges


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as they are walked: ``outgoing``, ``incoming`` (turned round) or ``both``."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)
    if direction == "outgoing":
        return edges.select("src", "dst", *rest)
    if direction == "incoming":
        return turned
    if direction == "both":
        return edges.select("src", "dst", *rest).unionByName(turned)
    raise ValueError(f"unknown direction {direction!r}")


def neighbours(nodes: DataFrame, edges: DataFrame, starts: DataFrame, direction: str = "outgoing", types: Sequence[str] | None = None) -> DataFrame:
    """start, and the columns of each neighbour; distinct if walked in both directions."""
    walked = oriented(of_types(edges, types), direction).join(starts.select(F.col("id").alias("src")), "src", "left_semi")
    pairs = walked.select(F.col("src").alias("start"), F.col("dst").alias("id"))
    return (pairs.distinct() if direction == "both" else pairs).join(nodes, "id")


def traverse(edges: DataFrame, starts: DataFrame, max_depth: int, direction: str = "outgoing", types: Sequence[str] | None = None, row_cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Breadth-first search from all ``starts`` (id): nodes (id, depth), edges (src, dst, depth).

    The edges are those that discover a node at its depth. ``row_cap`` keeps the smallest ids
    of a level. Starts that no edge touches are nodes of depth 0; null ids are left out.
    """
    walked = written(oriented(of_types(edges, types), direction).select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    levels = [written(starts.where("id IS NOT NULL").select("id").distinct().withColumn("depth", F.lit(0)))]
    found = []
    for depth in range(1, max_depth + 1):
        seen = levels[0]
        for level in levels[1:]:
            seen = seen.unionByName(level)
        step = walked.join(levels[-1].select(F.col("id").alias("src")), "src").join(seen.select(F.col("id").alias("dst")), "dst", "left_anti")
        fresh = step.select(F.col("dst").alias("id")).distinct()
        if row_cap is not None:
            fresh = fresh.orderBy("id").limit(row_cap)
        fresh = written(fresh.withColumn("depth", F.lit(depth)))
        if fresh.isEmpty():
            break
        found.append(step.join(fresh.select(F.col("id").alias("dst"), "depth"), "dst").select("src", "dst", "depth"))
        levels.append(fresh)
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.unionByName(level)
    discovered = walked.where("false").withColumn("depth", F.lit(0))
    for level in found:
        discovered = discovered.unionByName(level)
    return nodes, discovered


def neighbourhood(edges: DataFrame, starts: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """Outgoing and incoming search together: nodes (id, smallest depth), and (depth, nodes) summed
    over both searches, so that the starts count in each."""
    both = [traverse(edges, starts, max_depth, d)[0] for d in ("outgoing", "incoming")]
    every = both[0].unionByName(both[1])
    return every.groupBy("id").agg(F.min("depth").alias("depth")), every.groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"))


def shortest_paths(edges: DataFrame, starts: DataFrame, max_depth: int = 10, directed: bool = False) -> DataFrame:
    """start, id, length and path (array of ids) of the shortest path from each start to all it
    reaches; among equally short ones that whose ids are smallest, read from the end."""
    walked = written(oriented(edges, "outgoing" if directed else "both").select("src", "dst").distinct())
    level = written(starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("length"), F.array("id").alias("path")).distinct())
    seen = level
    for depth in range(1, max_depth + 1):
        step = level.join(walked, F.col("id") == F.col("src")).select("start", F.col("dst").alias("id"), "path", F.col("src").alias("parent"))
        step = step.join(seen.select("start", "id"), ["start", "id"], "left_anti")
        level = step.groupBy("start", "id").agg(F.min_by("path", "parent").alias("path"))
        level = written(level.select("start", "id", F.lit(depth).alias("length"), F.concat("path", F.array("id")).alias("path")))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def trails(edges: DataFrame, starts: DataFrame, min_length: int, max_length: int) -> DataFrame:
    """start, end, length, path of all walks of so many edges that use no edge twice.

    Their number can grow with the power of the length: meant for a few starts or short walks.
    """
    walked = written(edges.select("src", "dst").distinct())
    now = starts.select(F.col("id").alias("start"), F.col("id").alias("end"), F.array("id").alias("path")).distinct()
    out = None
    for length in range(1, max_length + 1):
        used = F.exists(F.sequence(F.lit(1), F.size("path") - 1), lambda i: (F.get("path", i - 1) == F.col("end")) & (F.get("path", i) == F.col("dst"))) if length > 1 else F.lit(False)
        now = now.join(walked, F.col("end") == F.col("src")).where(~used)
        now = written(now.select("start", F.col("dst").alias("end"), F.concat("path", F.array("dst")).alias("path")))
        if length >= min_length:
            part = now.withColumn("length", F.lit(length))
            out = part if out is None else out.unionByName(part)
    return out


def shortest_path(edges: DataFrame, start: DataFrame, end: DataFrame, max_depth: int = 10, directed: bool = False) -> DataFrame:
    """start, id, length and path of the shortest path from one node (id) to another, as ``shortest_paths`` gives it; no row, if there is none.

    Searches from both ends, each time on from the end with fewer nodes at its rim, until the
    rims meet; so two balls of half the radius are seen, and not one of the whole.
    """
    walked = written(oriented(edges, "outgoing" if directed else "both").select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    ahead = [written(start.select("id", F.array("id").alias("path")).limit(1))]
    behind = [written(end.select("id").limit(1))]
    sizes = [1, 1]

    def unseen(step: DataFrame, levels: list[DataFrame]) -> DataFrame:
        for level in levels[-2:] if not directed else levels:  # undirected: a neighbour is at most one level nearer
            step = step.join(level.select("id"), "id", "left_anti")
        return step

    def onwards(rows: DataFrame) -> DataFrame:
        """The ends of edges from ``rows``, each with the path by its smallest parent."""
        step = rows.join(walked, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), "path", F.col("src").alias("parent"))
        return step.groupBy("id").agg(F.min_by("path", "parent").alias("path"))

    def joined(rows: DataFrame) -> DataFrame:
        return rows.select("id", F.concat("path", F.array("id")).alias("path"))

    met = ahead[-1].join(behind[-1], "id", "left_semi")
    while met.isEmpty():
        if len(ahead) + len(behind) - 2 >= max_depth or 0 in sizes:
            return ahead[0].where("false").select(F.col("id").alias("start"), "id", F.lit(0).alias("length"), "path")
        if sizes[0] <= sizes[1]:
            ahead.append(written(joined(unseen(onwards(ahead[-1]), ahead))))
            sizes[0] = ahead[-1].count()
        else:
            back = behind[-1].join(walked, F.col("id") == F.col("dst")).select(F.col("src").alias("id")).distinct()
            behind.append(written(unseen(back, behind)))
            sizes[1] = behind[-1].count()
        met = ahead[-1].join(behind[-1], "id", "left_semi")
    for level in behind[-2::-1]:
        met = joined(onwards(met).join(level, "id", "left_semi"))
    out = written(met)
    dropped(walked, *ahead, *behind)
    return out.select(F.get("path", F.lit(0)).alias("start"), "id", (F.size("path") - 1).alias("length"), "path")


def paths_to_leaves(edges: DataFrame, starts: DataFrame, max_length: int, most: int = 100) -> DataFrame:
    """start, path, length of the first ``most`` simple paths of each start, of up to ``max_length`` edges, that end
    in a node without outgoing edges, in the order of their ids.

    A search from the leaves tells how many edges each node is away from one, so a path that
    can't end in time is dropped at once. Of each start the paths that come first go on; the
    others wait, until as many finished ones come before them as are wanted. So nothing is
    lost, with cycles or without; how many rounds that takes depends on how many paths run
    into themselves.
    """
    walked = written(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    ids = starts.where("id IS NOT NULL").select("id").distinct()
    leaves = written(walked.select(F.col("dst").alias("id")).unionByName(ids).distinct().join(walked.select(F.col("src").alias("id")).distinct(), "id", "left_anti"))
    left = written(traverse(walked, leaves, max_length, "incoming")[0].select(F.col("id").alias("end"), F.col("depth").alias("left")))
    now = written(ids.select(F.col("id").alias("start"), F.col("id").alias("end"), F.array("id").alias("path")).join(left, "end").select("start", "end", "path", (F.col("left") == 0).alias("done")))
    place = F.row_number().over(Window.partitionBy("start").orderBy("path"))
    while True:
        finished = now.where("done").withColumn("place", place).where(F.col("place") <= most).drop("place")
        bars = finished.groupBy("start").agg(F.when(F.count(F.lit(1)) >= most, F.max("path")).alias("bar"))
        waiting = now.where("NOT done").join(bars, "start", "left").where("bar IS NULL OR path < bar").drop("bar")
        first = written(waiting.withColumn("place", place).where(F.col("place") <= 4 * most).drop("place"))
        if first.isEmpty():
            out = written(finished.select("start", "path", (F.size("path") - 1).alias("length")))
            dropped(walked, leaves, left, now, first)
            return out
        cuts = first.groupBy("start").agg(F.max("path").alias("cut"))
        rest = waiting.join(cuts, "start").where("path > cut").drop("cut")
        step = first.join(walked, F.col("end") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        step = step.select("start", F.col("dst").alias("end"), F.concat("path", F.array("dst")).alias("path")).join(left, "end").where(F.size("path") - 1 + F.col("left") <= max_length)
        again = written(finished.unionByName(rest).unionByName(step.select("start", "end", "path", (F.col("left") == 0).alias("done"))))
        dropped(now, first)
        now = again


def longest_trail(edges: DataFrame, most: int) -> tuple[int, bool]:
    """The largest length up to ``most`` of which a walk without repeated nodes exists, and
    whether the cap was reached. Only for acyclic edges are these all walks; there, the longest
    walk that ends in a node tells, so nothing is enumerated."""
    walked = written(edges.select("src", "dst").distinct())
    ends = walked.select(F.col("src").alias("id")).distinct()
    for length in range(most + 1):
        if ends.isEmpty():
            return length - 1, False
        ends = written(walked.join(ends, F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id")).distinct())
    return most, True


def degrees(edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree, total; each side is aggregated before they meet."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("in_degree"))
    zero = F.lit(0).cast("long")
    both = out.join(into, "id", "full_outer").select("id", F.coalesce("out_degree", zero).alias("out_degree"), F.coalesce("in_degree", zero).alias("in_degree"))
    return both.withColumn("total", F.col("out_degree") + F.col("in_degree"))


def hotspots(nodes: DataFrame, edges: DataFrame, top: int, least: int = 5, keep: Column | None = None) -> DataFrame:
    """The ``top`` nodes by total degree of at least ``least``, ties by id; ``keep`` filters nodes first."""
    ranked = degrees(edges).where(F.col("total") >= least).join(nodes if keep is None else nodes.where(keep), "id")
    return ranked.orderBy(F.desc("total"), "id").limit(top)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def union_graphs(*graphs: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes by id and edges by (src, dst, edge_type); of equal ones the first graph's stays."""

    def first(parts: list[DataFrame], key: list[str]) -> DataFrame:
        every = None
        for k, part in enumerate(parts):
            part = part.withColumn("graph", F.lit(k))
            every = part if every is None else every.unionByName(part)
        rest = [c for c in every.columns if c not in (*key, "graph")]
        if not rest:
            return every.select(*key).distinct()
        return every.groupBy(*key).agg(F.min(F.struct("graph", *rest)).alias("first")).select(*key, *(F.col(f"first.{c}").alias(c) for c in rest))

    return first([n for n, _ in graphs], ["id"]), first([e for _, e in graphs], ["src", "dst", "edge_type"])


def next_in_order(df: DataFrame, partition: str, order: Sequence[str], id_col: str) -> DataFrame:
    """(src, dst) of rows that follow each other within a partition."""
    following = F.lead(id_col).over(Window.partitionBy(partition).orderBy(*order))
    return df.select(F.col(id_col).alias("src"), following.alias("dst")).where("dst IS NOT NULL")


def traced(nodes: DataFrame, edges: DataFrame, name: str, direction: str = "outgoing", max_depth: int = 25, most: int = 100) -> DataFrame:
    """start, path and length of call chains from a symbol: ``edges`` of type CALLS, depth at most 50.

    The symbol is the first by id with that very name; if there is none, the first whose name
    holds it in any case. Chains end where nothing more is called (or calls).
    """
    if direction not in ("outgoing", "incoming"):
        raise ValueError(f"unknown direction {direction!r}")
    exact, partly = F.col("name") == name, F.lower("name").contains(name.lower())
    start = nodes.where(exact | partly).select("id", F.when(exact, 0).otherwise(1).alias("rank")).orderBy("rank", "id").limit(1).select("id")
    start = written(start)
    depth = min(max_depth, 50)
    walked = oriented(of_types(edges, ["CALLS"]), direction).select("src", "dst")
    reached, _ = traverse(walked, start, depth)
    return paths_to_leaves(induced(walked, reached), start, depth, most)


def typed_trails(edges: DataFrame, starts: DataFrame, depth: int, types: Sequence[str]) -> DataFrame:
    """start, end, length and relations (the types of the edges in order) of all walks of up to ``depth``
    edges of these types, held to 1 to 3, that use no edge twice."""
    walked = written(of_types(edges, types).select("src", "dst", "edge_type").distinct())
    step = F.struct("src", "dst", "edge_type")
    now = starts.select(F.col("id").alias("start"), F.col("id").alias("end"), F.array().cast(walked.select(F.array(step).alias("x")).schema["x"].dataType).alias("used"))
    out = None
    for length in range(1, min(max(depth, 1), 3) + 1):
        now = written(now.join(walked, F.col("end") == F.col("src")).where(~F.array_contains("used", step)).select("start", F.col("dst").alias("end"), F.concat("used", F.array(step)).alias("used")))
        part = now.select("start", "end", F.lit(length).alias("length"), F.col("used.edge_type").alias("relations"))
        out = part if out is None else out.unionByName(part)
    return out
