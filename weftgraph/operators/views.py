"""Graph views: nodes and edges with caps by layer, diagrams, trees, packets of context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.scalars import safe_id, shortened

from . import graph

#: Shapes of nodes and lines of edges in a diagram.
SHAPES = {"file": ("[", "]"), "class": ("[[", "]]"), "function": ("(", ")"), "method": ("(", ")")}
LINES = {"CALLS": "-->", "IMPORTS": "-.->", "EXTENDS": "==>", "CONTAINS": "---"}


def capped_layers(nodes: DataFrame, limits: dict[str, int], order: str = "id") -> DataFrame:
    """The first of each ``node_type`` up to its limit; types without one are kept whole.

    Each limit is a literal of a search of its own, so every task keeps no more than that of its rows before they meet.
    """
    known = F.col("node_type").isin(*limits)
    out = nodes.where(~known | F.col("node_type").isNull())
    for kind, most in sorted(limits.items()):
        out = out.unionByName(nodes.where(F.col("node_type") == kind).orderBy(order).limit(most))
    return out


def collapsed(nodes: DataFrame, edges: DataFrame, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """The ``most`` nodes with most incident edges (ties by id), and the edges among them."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    ranked = nodes.join(ends.groupBy("id").agg(F.count(F.lit(1)).alias("edges")), "id", "left")
    kept = ranked.orderBy(F.coalesce("edges", F.lit(0)).desc(), "id").limit(most).drop("edges")
    return kept, graph.induced(edges, kept)


def call_view(edges: DataFrame, entries: DataFrame, max_depth: int, direction: str = "outgoing") -> DataFrame:
    """Edges among what the entries reach."""
    nodes, _ = graph.traverse(edges, entries, max_depth, direction)
    return graph.induced(edges, nodes)


def mermaid_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a flow chart with their order: nodes by id, then edges; labels are shortened."""
    label = F.replace(shortened(F.col("label"), 30), F.lit('"'), F.lit("'"))

    def ends(side: int) -> Column:
        return F.coalesce(F.create_map(*(F.lit(x) for k, v in SHAPES.items() for x in (k, v[side])))[F.col("node_type")], F.lit("[]"[side]))

    node = F.concat(F.lit("    "), safe_id(F.col("id")), ends(0), F.lit('"'), label, F.lit('"'), ends(1))
    line = F.coalesce(F.create_map(*(F.lit(x) for kv in LINES.items() for x in kv))[F.col("edge_type")], F.lit("-->"))
    edge = F.concat(F.lit("    "), safe_id(F.col("src")), F.lit(" "), line, F.lit(" "), safe_id(F.col("dst")))
    return nodes.select(F.lit(1).alias("part"), F.col("id").alias("at"), node.alias("line")).unionByName(edges.select(F.lit(2).alias("part"), F.concat_ws(">", "src", "dst").alias("at"), edge.alias("line")))


def tree_lines(files: DataFrame, path: str) -> DataFrame:
    """Paths and their folders, sorted, with the text of a tree: depth and name."""
    from .resolve import prefixes

    every = files.select(F.explode(F.concat(prefixes(F.col(path)), F.array(path))).alias("node")).distinct()
    depth = F.size(F.split("node", "/")) - 1
    return every.select("node", F.concat(F.repeat(F.lit("  "), depth), F.element_at(F.split("node", "/"), -1)).alias("line"))


def context_packets(symbols: DataFrame, edges: DataFrame, roots: DataFrame, most: int = 15) -> DataFrame:
    """id, text and packet_id of each root: a header and up to ``most`` names by relation."""
    names = symbols.select(F.col("id").alias("other"), F.col("name").alias("other_name"))

    def related(side: str, other: str, kind: str, label: str) -> DataFrame:
        return edges.where(F.col("edge_type") == kind).select(F.col(side).alias("id"), F.col(other).alias("other"), F.lit(label).alias("relation"))

    rows = related("src", "dst", "CALLS", "Calls").unionByName(related("dst", "src", "CALLS", "Called by")).unionByName(related("src", "dst", "EXTENDS", "Extends"))
    rows = rows.join(roots.select("id"), "id", "left_semi").join(names, "other")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("id", "relation").orderBy("other_name", "other"))).where(F.col("n") <= most)
    by_relation = rows.groupBy("id", "relation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "other_name"))), lambda x: x["other_name"]), ", ").alias("names"), F.collect_list("other").alias("others"))
    body = by_relation.groupBy("id").agg(F.array_sort(F.collect_list(F.concat_ws(": ", "relation", "names"))).alias("lines"), F.flatten(F.collect_list("others")).alias("others"))
    out = roots.join(symbols, "id").join(body, "id", "left")
    text = F.concat_ws("\n", F.concat(F.lit("## "), "name", F.lit(" ("), "kind", F.lit(") in "), "file_path"), F.array_join(F.coalesce("lines", F.array().cast("array<string>")), "\n"))
    ids = F.array_sort(F.array_distinct(F.concat(F.array(F.col("id")), F.coalesce("others", F.array().cast("array<bigint>")))))
    packet = F.substring(F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.array_join(ids, ",")), 256), 1, 16)
    return out.select("id", text.alias("text"), packet.alias("packet_id"))


def narrative(entries: DataFrame, kind: str, name: str, most: int = 5) -> DataFrame:
    """One line by kind: how many there are, and the first few names."""
    place = F.row_number().over(Window.partitionBy(kind).orderBy(name))
    total = entries.groupBy(F.col(kind).alias("of_kind")).agg(F.count(F.lit(1)).alias("total"))
    rows = entries.withColumn("place", place).where(F.col("place") <= most).join(total, F.col(kind).eqNullSafe(F.col("of_kind"))).drop("of_kind")
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", name))), lambda x: x[name]), ", ")
    return rows.groupBy(kind, "total").agg(first.alias("names")).select(kind, F.concat(F.col("total").cast("string"), F.lit(" "), kind, F.lit(": "), "names").alias("line"))


#: Edge types of a view, and how many nodes it has at most where the caller doesn't say.
VIEWS = {
    "architecture": (("CONTAINS", "IMPORTS"), 500), "calls": (("CALLS",), 5000), "dependencies": (("IMPORTS",), 2000), "full": ((), 500),
    "comprehensive": ((), 1000), "call_chain": (("CALLS",), 500), "hotspots": (("CALLS",), 50),
}


def view(kind: str, nodes: DataFrame, edges: DataFrame, *, folder: str | None = None, symbol: str | None = None, direction: str = "outgoing", kinds: tuple[str, ...] = (), max_depth: int = 15, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one of the seven ``VIEWS``.

    Nodes are those below ``folder`` and of ``kinds``, if given; a call chain has what is
    reached from the symbols whose name begins with ``symbol``, hotspots have at least five
    connections. Beyond ``limit`` those with most edges stay (ties by id). Edges have both ends
    among the nodes. An unknown kind, a chain without a symbol and a folder without nodes are errors.
    """
    if kind not in VIEWS:
        raise ValueError(f"no view {kind!r}; there are {', '.join(VIEWS)}")
    if kind == "call_chain" and not symbol:
        raise ValueError("a call chain needs a symbol")
    if folder and nodes.where(F.col("file_path").startswith(folder)).isEmpty():
        raise ValueError(f"no path {folder!r}")
    types, most = VIEWS[kind]
    shown = graph.of_types(edges, types)
    kept = nodes.where(F.col("file_path").startswith(folder)) if folder else nodes
    kept = kept.where(F.col("kind").isin(*kinds)) if kinds else kept
    if kind == "call_chain":
        reached, _ = graph.traverse(shown, nodes.where(F.col("name").startswith(symbol)).select("id"), max_depth, direction)
        kept = kept.join(reached.select("id"), "id", "left_semi")
    elif kind == "hotspots":
        kept = graph.hotspots(kept, shown, limit or most).select(*nodes.columns)
    return collapsed(kept, graph.induced(shown, kept), limit or most)


def retrieved_view(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id, label, node_type and edges of a retrieval: both ends must be there, unknown types are CALLS."""
    known = ("CONTAINS", "CALLS", "IMPORTS", "IMPLEMENTS", "EXTENDS", "USES", "DECORATES")
    typed = F.when(F.col("edge_type").isin(*known), F.col("edge_type")).otherwise("CALLS")
    shown = nodes.select("id", F.col("name").alias("label"), F.col("kind").alias("node_type")).dropDuplicates(["id"])
    return shown, graph.induced(edges, shown).withColumn("edge_type", typed)
