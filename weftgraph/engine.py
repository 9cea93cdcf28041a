"""One access point: a graph, its chunks, and what can be asked of them."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import analysis, graph, guard, index, retrieval, vector_index, views
from weftgraph.operators.retrieval import Settings
from weftgraph.operators.text_index import TextIndex
from weftgraph.operators.vector_index import VectorIndex

MOST_ROWS = 50


def guarded(spark: SparkSession, query: str, most_rows: int = MOST_ROWS, views: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Runs one query on ``views`` (without them the session's tables and views), as ``operators.guard`` allows."""
    return guard.guarded(spark, query, most_rows, views)


@dataclass
class Engine:
    """nodes (id, name, kind, file_path), edges (src, dst, edge_type), chunks (chunk_id, content,
    embedding, and for ``retrieve`` file_path, start_line, end_line), links (chunk_id, id)."""

    nodes: DataFrame
    edges: DataFrame
    chunks: DataFrame | None = None
    settings: Settings = field(default_factory=Settings)
    tools: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)
    links: DataFrame | None = None
    #: Indexes of the chunks' vectors (key chunk_id) and texts; without them a search goes through all chunks.
    vectors: VectorIndex | None = None
    words: TextIndex | None = None

    def __post_init__(self) -> None:
        self.settings = self.settings.checked()
        for f in (
            self.node, self.find, self.related_files, self.neighbours, self.reachable, self.path, self.hotspots, self.references, self.statistics, self.search, self.fused, self.packets, self.files,
            self.snippet, self.symbol_details, self.trace, self.flow, self.unified, self.traverse_hybrid, self.retrieve, self.view, self.entry_points, self.architecture, self.analysis, self.query,
        ):
            self.register(f)

    @classmethod
    def of_files(cls, files: DataFrame, settings: Settings | None = None) -> Engine:
        """Indexes source files (file_path, language, content) and opens the result; chunks have no embedding yet."""
        made = index.index_files(files)
        return cls(made.nodes, made.edges, made.chunks.withColumn("embedding", F.lit(None).cast("array<double>")), settings or Settings(), links=made.links)

    # the register of tools

    def register(self, tool: Callable[..., DataFrame], name: str | None = None) -> None:
        self.tools[name or tool.__name__] = tool

    def unregister(self, name: str) -> bool:
        """Whether there was such a tool."""
        return self.tools.pop(name, None) is not None

    def schemas(self) -> dict[str, dict]:
        """Of each tool what it does, and its arguments with type and default."""
        out = {}
        for name, tool in sorted(self.tools.items()):
            arguments = {k: {"type": str(p.annotation), "required": p.default is p.empty} | ({} if p.default is p.empty else {"default": p.default}) for k, p in inspect.signature(tool).parameters.items()}
            out[name] = {"description": (inspect.getdoc(tool) or "").split("\n")[0], "arguments": arguments}
        return out

    def call(self, tool: str, **arguments) -> DataFrame:
        """Runs a registered tool by name."""
        if tool not in self.tools:
            raise KeyError(f"no tool {tool!r}; there are {', '.join(sorted(self.tools))}")
        return self.tools[tool](**arguments)

    # the tools

    def _ids(self, ids: Sequence) -> DataFrame:
        return self.nodes.where(F.col("id").isin(*ids)).select("id")

    def _named(self, name: str) -> DataFrame:
        return self.nodes.where(F.lower("name") == name.lower())

    def _chunks(self) -> DataFrame:
        if self.chunks is None:
            raise ValueError("this engine has no chunks")
        return self.chunks

    def _asked(self, vector: Sequence[float]) -> DataFrame:
        return self._chunks().sparkSession.range(1).select(F.array(*map(F.lit, map(float, vector))).alias("embedding"))

    def node(self, id) -> DataFrame:
        """A node by its id."""
        return self.nodes.where(F.col("id") == id)

    def find(self, name: str, kinds: Sequence[str] | None = None, folder: str | None = None, most: int = 20) -> DataFrame:
        """Symbols by name (any case), kind and folder, in the order of their ids."""
        found = self._named(name)
        found = found.where(F.col("kind").isin(*kinds)) if kinds else found
        found = found.where(F.col("file_path").startswith(folder)) if folder else found
        return found.orderBy("id").limit(most)

    def files(self, folder: str = "") -> DataFrame:
        """Paths of files, sorted."""
        return self.nodes.where(F.col("file_path").startswith(folder)).select("file_path").distinct().orderBy("file_path")

    def snippet(self, file_path: str, first: int = 1, last: int = 2**31 - 1) -> DataFrame:
        """Chunks of a file that touch some lines, in order."""
        return self._chunks().where((F.col("file_path") == file_path) & (F.col("end_line") >= first) & (F.col("start_line") <= last)).orderBy("start_line")

    def related_files(self, file_path: str, relation: str = "all", most: int = 50) -> DataFrame:
        """file_path and relation (``imports``, ``imported_by``): the first files of each that a file is related to, sorted."""
        ways = {"imports": ("src", "dst"), "imported_by": ("dst", "src")}
        if relation != "all" and relation not in ways:
            raise ValueError(f"unknown relation {relation!r}")
        files = self.nodes.where("kind = 'file'").select("id", "file_path")
        start, linked = files.where(F.col("file_path") == file_path).select("id"), self.edges.where("edge_type = 'IMPORTS'")
        found = []
        for way in ways if relation == "all" else (relation,):
            near, far = ways[way]
            ids = linked.join(start.withColumnRenamed("id", near), near, "left_semi").select(F.col(far).alias("id"))
            found.append(files.join(ids, "id", "left_semi").select("file_path", F.lit(way).alias("relation")).orderBy("file_path").limit(most))
        return found[0] if len(found) == 1 else found[0].unionByName(found[1])

    def neighbours(self, ids: Sequence, direction: str = "outgoing", types: Sequence[str] | None = None) -> DataFrame:
        """Neighbours of some nodes."""
        return graph.neighbours(self.nodes, self.edges, self._ids(ids), direction, types)

    def reachable(self, ids: Sequence, max_depth: int | None = None, direction: str = "outgoing", types: Sequence[str] | None = None) -> DataFrame:
        """What is reached from some nodes, with its depth."""
        found, _ = graph.traverse(self.edges, self._ids(ids), max_depth or self.settings.max_depth, direction, types)
        return found.join(self.nodes, "id")

    def path(self, start, end, max_depth: int = 10, directed: bool = False) -> DataFrame:
        """The shortest path between two nodes."""
        return graph.shortest_path(self.edges, self._ids([start]), self._ids([end]), max_depth, directed)

    def flow(self, start: str, end: str, max_depth: int = 5) -> DataFrame:
        """The shortest paths between symbols of two names, and the names along them."""
        ends = self._named(end).select("id")
        found = graph.shortest_paths(self.edges, self._named(start).select("id"), max_depth, True).join(ends, "id", "left_semi").where("length > 0")
        steps = found.select("start", "id", "length", F.posexplode("path").alias("place", "node")).join(self.nodes.select(F.col("id").alias("node"), "name"), "node")
        said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), " -> ")
        return steps.groupBy("start", "id", "length").agg(said.alias("flow"))

    def trace(self, name: str, direction: str = "outgoing", max_depth: int | None = None) -> DataFrame:
        """Call chains from (or to) a symbol, by its exact name, else by a part of it."""
        return graph.traced(self.nodes, self.edges, name, direction, max_depth or self.settings.max_depth)

    def hotspots(self, top: int = 20, folder: str | None = None) -> DataFrame:
        """The nodes with most connections."""
        return graph.hotspots(self.nodes, self.edges, top, keep=F.col("file_path").startswith(folder) if folder else None)

    def references(self, name: str, direction: str = "incoming") -> DataFrame:
        """Who calls or imports the symbols of a name, all of them."""
        return graph.neighbours(self.nodes, self.edges, self._named(name).select("id"), direction, ["CALLS", "IMPORTS"])

    def symbol_details(self, name: str, most: int = 5) -> DataFrame:
        """The first few symbols of a name, with how many nodes they are joined to in each direction."""
        found = self.find(name, most=most)
        return found.join(graph.degrees(self.edges.join(found.select(F.col("id").alias("src")), "src", "left_semi").unionByName(self.edges.join(found.select(F.col("id").alias("dst")), "dst", "left_semi"))), "id", "left").fillna(0, ["out_degree", "in_degree", "total"])

    def statistics(self, probe: int = 20) -> DataFrame:
        """metric, key, value: nodes by kind, edges by type, the depth of calls up to ``probe`` and whether that was reached."""
        kinds = self.nodes.groupBy(F.col("kind").alias("key")).agg(F.count(F.lit(1)).alias("value")).select(F.lit("nodes").alias("metric"), "key", "value")
        types = self.edges.groupBy(F.col("edge_type").alias("key")).agg(F.count(F.lit(1)).alias("value")).select(F.lit("edges").alias("metric"), "key", "value")
        depth, capped = graph.longest_trail(self.edges.where("edge_type = 'CALLS'"), probe)
        told = self.nodes.sparkSession.range(1).select(F.lit("depth").alias("metric"), F.lit("capped" if capped else "exact").alias("key"), F.lit(depth).cast("long").alias("value"))
        return kinds.unionByName(types).unionByName(told)

    def architecture(self) -> DataFrame:
        """Folders with their numbers of files and symbols, and imports into other folders."""
        folder = F.regexp_replace("file_path", "/?[^/]*$", "")
        held = self.nodes.groupBy(folder.alias("folder")).agg(F.count_distinct("file_path").alias("files"), F.count(F.lit(1)).alias("nodes"))
        of = self.nodes.select("id", folder.alias("folder"))
        out = self.edges.where("edge_type = 'IMPORTS'").join(of.select(F.col("id").alias("src"), F.col("folder").alias("a")), "src").join(of.select(F.col("id").alias("dst"), F.col("folder").alias("b")), "dst").where("a <> b")
        return held.join(out.groupBy(F.col("a").alias("folder")).agg(F.count_distinct("b").alias("imports")), "folder", "left").fillna(0, ["imports"]).orderBy("folder")

    def entry_points(self, folder: str = "") -> DataFrame:
        """Symbols at which something begins, with their kind of entry."""
        rows = self.nodes.where(F.col("file_path").startswith(folder)).withColumn("entry", analysis.entry_type(F.col("name"), F.element_at(F.split("file_path", "/"), -1)))
        return rows.where("entry IS NOT NULL")

    def analysis(self, folder: str = "", max_depth: int = 5, most: int | None = None) -> DataFrame:
        """section, id, name, detail: entry points, domain concepts, and what the first entry points reach."""
        entries = self.entry_points(folder)
        rows = self.nodes.where(F.col("file_path").startswith(folder))
        concepts = rows.withColumn("category", analysis.domain_category(F.col("name"), F.col("file_path"), F.array().cast("array<string>"))).where("category IS NOT NULL")
        first = entries.orderBy("id").limit(most or self.settings.max_entry_points_traced).select("id")
        reached, _ = graph.traverse(self.edges, first, max_depth, "outgoing", ["CALLS"])
        flows = reached.where("depth > 0").join(self.nodes, "id")
        parts = [(entries, "entry", F.col("entry")), (concepts, "concept", F.col("category")), (flows, "flow", F.col("depth").cast("string"))]
        out = [df.select(F.lit(section).alias("section"), "id", "name", detail.alias("detail")) for df, section, detail in parts]
        return out[0].unionByName(out[1]).unionByName(out[2])

    def search(self, vector: Sequence[float], top: int | None = None) -> DataFrame:
        """The chunks most like a vector; with an index, among its nearest cells."""
        if self.vectors is not None:
            asked = self._asked(vector).withColumn("query_id", F.lit(0).cast("long"))
            found = self.vectors.search(asked, top or self.settings.top_k_vector).select("chunk_id", "score")
            return self._chunks().join(found, "chunk_id").orderBy(F.desc("score"), "chunk_id")
        return retrieval.similar(self._chunks(), self._asked(vector), top or self.settings.top_k_vector)

    def fused(self, question: str, vector: Sequence[float], top: int = 10) -> DataFrame:
        """The best chunks by vector and by the words of a question, each list in shares of its best."""
        near = self.search(vector, top).select("chunk_id", "score")
        terms = self._chunks().sparkSession.range(1).select(retrieval.search_terms(F.lit(question), 20)).first()[0]
        if self.words is not None:
            said = self.words.search(terms).withColumnRenamed(self.words.key, "chunk_id")
        else:
            said = retrieval.lexical_scores(self._chunks(), terms, "content", "chunk_id")
        return vector_index.fused(top, near, said.orderBy(F.desc("score"), "chunk_id").limit(top))

    def unified(self, vector: Sequence[float], top: int = 10, related: bool = True, documentation: bool = True) -> DataFrame:
        """Code chunks with their symbol and relations, and documentation chunks."""
        return retrieval.unified(self._chunks(), self._asked(vector), self.nodes, self.edges, top, related=related, documentation=documentation)

    def traverse_hybrid(self, vector: Sequence[float], top: int = 10, depth: int = 2, types: Sequence[str] | None = None, terms: Sequence[str] = ()) -> DataFrame:
        """What is around the chunks most like a vector, or with most of some terms."""
        return retrieval.hybrid_traversal(self._chunks(), self._asked(vector), self.edges, top, depth, types, terms)

    def retrieve(self, question: str, vector: Sequence[float], anchors: Sequence[str] = (), current_file: str | None = None, stack: str | None = None, progress: retrieval.Progress | None = None) -> DataFrame:
        """Ranked chunks for a question, within the token budget; ``progress`` is told of each step."""
        if self.links is None:
            raise ValueError("this engine has no links from chunks to nodes")
        return retrieval.retrieve(question, self._asked(vector), self._chunks(), self.links, self.nodes, self.edges, self.settings, anchors=anchors, current_file=current_file, stack=stack, progress=progress)

    def packets(self, ids: Sequence) -> DataFrame:
        """Texts of context of some symbols."""
        return views.context_packets(self.nodes, self.edges, self._ids(ids))

    def view(self, kind: str, folder: str | None = None, symbol: str | None = None, direction: str = "outgoing", limit: int | None = None) -> DataFrame:
        """Lines of a diagram of one of the seven views."""
        nodes, edges = views.view(kind, self.nodes, self.edges, folder=folder, symbol=symbol, direction=direction, limit=limit)
        return views.mermaid_lines(nodes.select(F.col("id").cast("string").alias("id"), F.col("name").alias("label"), F.col("kind").alias("node_type")), edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "edge_type"))

    def query(self, sql: str, most_rows: int = MOST_ROWS) -> DataFrame:
        """One reading SQL statement on nodes, edges and chunks."""
        tables = {"nodes": self.nodes, "edges": self.edges} | ({} if self.chunks is None else {"chunks": self.chunks})
        return guarded(self.nodes.sparkSession, sql, most_rows, tables)
