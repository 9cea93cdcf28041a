"""Vector search, candidate scoring, ranking and token budgets."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass, fields, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions import vectors
from weftgraph.operators import graph
from weftgraph.operators.state import running_total
from weftgraph.sources.tables import written

#: Words that are no search terms.
STOP_WORDS = ("the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "function", "class", "method", "module", "file", "code")
#: Names in a question, by how they are written.
NAME_PATTERNS = (
    r"\b([A-Z][a-zA-Z0-9]*(?:[A-Z][a-zA-Z0-9]*)+)\b",
    r"\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\b",
    r"[\"']([a-zA-Z_][a-zA-Z0-9_]*)[\"']",
    r"\b([A-Z][a-z][a-zA-Z0-9]*)\b",
)
#: Questions about a domain, on lower-cased text; and frames of an error stack.
DOMAIN_PATTERNS = (
    r"how does (?:the )?(\w+) (?:domain|module|package|folder|directory) work",
    r"what is (?:the )?(\w+) (?:domain|module|package|folder|directory)",
    r"explain (?:the )?(\w+) (?:domain|module|package|folder|directory)",
    r"overview of (?:the )?(\w+)",
    r"architecture of (?:the )?(\w+)",
)
FRAME_PATTERNS = (r'File "([^"]+)", line (\d+)', r"at\s+(?:\S+\s+\()?([^:]+):(\d+)", r"([^\s:]+):(\d+)")


#: The range that a knob is held to.
RANGES = {
    "max_context_tokens": (1000, 200_000), "top_k_vector": (5, 5000), "graph_expansion_hops": (1, 10), "max_expansion_nodes": (100, 2000), "max_depth": (1, 100),
    "similarity_threshold": (0.0, 1.0), "same_file_bonus": (0.0, 1.0), "same_directory_bonus": (0.0, 1.0), "tokens_per_line": (1.0, 500.0),
}


@dataclass(frozen=True)
class Settings:
    """Knobs of retrieval. ``checked`` holds each to its range; ``to_json`` and ``of_json`` go there and back."""

    max_context_tokens: int = 100_000
    top_k_vector: int = 200
    graph_expansion_hops: int = 5
    max_expansion_nodes: int = 500
    max_symbols_per_chunk: int = 3
    max_resolved_ids_per_symbol: int = 3
    max_entry_points_traced: int = 5
    max_context_items_for_flow: int = 10
    same_file_bonus: float = 0.1
    same_directory_bonus: float = 0.05
    tokens_per_line: float = 10.0
    max_depth: int = 25
    similarity_threshold: float = 0.7
    similarity_function: str = "cosine"
    include_visualization: bool = True
    include_related_symbols: bool = True
    enable_ranking: bool = True
    #: Weights of the final score; not among the knobs that a user turns.
    graph_weight: float = 0.3
    anchor_bonus: float = 0.2

    def checked(self) -> Settings:
        held = {k: type(getattr(self, k))(min(max(getattr(self, k), low), high)) for k, (low, high) in RANGES.items()}
        return replace(self, **held, similarity_function=self.similarity_function if self.similarity_function in MEASURES else "cosine")

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def of_json(cls, text: str) -> Settings:
        """Unknown names are passed over, missing ones have their defaults."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in json.loads(text).items() if k in known})


MEASURES = {"cosine": vectors.cosine, "euclidean": vectors.euclidean}


def similar(chunks: DataFrame, query: DataFrame, k: int, measure: str = "cosine", prefilter: Column | None = None, postfilter: Column | None = None) -> DataFrame:
    """The k chunks most like the one vector of ``query`` (embedding), with ``score``.

    ``prefilter`` applies before, ``postfilter`` after the cut, which may leave fewer than k.
    Ties go to the smaller chunk_id. ``query`` is one row, so that side is broadcast.
    """
    of = MEASURES[measure]
    pool = chunks if prefilter is None else chunks.where(prefilter)
    scored = pool.join(F.broadcast(query.select(F.col("embedding").alias("asked")).limit(1)), F.size("embedding") == F.size("asked"))
    best = scored.withColumn("score", of(F.col("embedding"), F.col("asked"))).where("score IS NOT NULL").drop("asked").orderBy(F.desc("score"), "chunk_id").limit(k)
    return best if postfilter is None else best.where(postfilter)


def merged(*candidates: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Union in which the first table that has a key keeps it."""
    every = None
    for k, part in enumerate(candidates):
        part = part.withColumn("priority", F.lit(k))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy(key).orderBy("priority"))
    return every.withColumn("place", rank).where("place = 1").drop("place", "priority")


def final_score(settings: Settings, score: Column, distance: Column, is_anchor: Column) -> Column:
    near = F.when(distance >= 0, settings.graph_weight / (distance + 1)).otherwise(F.lit(0.0))
    return score + near + F.when(is_anchor, settings.anchor_bonus).otherwise(F.lit(0.0))


def location_bonus(settings: Settings, file_path: Column, current: str) -> Column:
    folder = current.rpartition("/")[0]
    return F.when(file_path == current, settings.same_file_bonus).when(F.regexp_replace(file_path, "/?[^/]*$", "") == folder, settings.same_directory_bonus).otherwise(F.lit(0.0))


def frames(text: Column) -> Column:
    """(file, line) of an error stack in order; of a file only the first."""

    def found(pattern: str) -> Column:
        files, lines = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        return F.zip_with(files, lines, lambda f, n: F.struct(f.alias("file"), n.try_cast("int").alias("line")))

    every = F.concat(*map(found, FRAME_PATTERNS))
    placed = F.array_sort(F.transform(every, lambda x, k: F.struct(x["file"].alias("file"), k.alias("place"), x["line"].alias("line"))))
    # sorted by file, the first of each is the one after another file; the outer transform works the array out once
    firsts = F.get(F.transform(F.array(placed), lambda a: F.filter(a, lambda x, k: (k == 0) | (F.get(a, k - 1)["file"] != x["file"]))), F.lit(0))
    in_order = F.array_sort(F.transform(firsts, lambda x: F.struct(x["place"].alias("place"), x["file"].alias("file"), x["line"].alias("line"))))
    return F.transform(in_order, lambda x: F.struct(x["file"].alias("file"), x["line"].alias("line")))


def chunks_of_frames(chunks: DataFrame, stack: DataFrame, otherwise: int = 3) -> DataFrame:
    """Chunks (file_path, start_line, end_line) that hold a frame (file_path, line); for a file
    without such a chunk, its first few."""
    inside = chunks.join(stack, "file_path").where("line BETWEEN start_line AND end_line")
    rest = chunks.join(stack.select("file_path").distinct(), "file_path").join(inside.select("file_path").distinct(), "file_path", "left_anti")
    place = F.row_number().over(Window.partitionBy("file_path").orderBy("start_line", "chunk_id"))
    first = rest.withColumn("place", place).where(F.col("place") <= otherwise).drop("place")
    return inside.drop("line").distinct().unionByName(first)


def fitting(ranked: DataFrame, budget: int, order: Sequence[Column]) -> DataFrame:
    """First fit: in order, a row stays if its ``tokens`` still fit; the first always stays.

    Of rows with t tokens only the first budget / t can stay, whatever comes between, and
    rows without tokens all stay. So one task goes through at most budget * (1 + ln budget)
    rows, however many there are. ``order`` must be total.
    """
    rows = ranked.withColumn("cost", F.coalesce(F.col("tokens").cast("long"), F.lit(0)))
    first = rows.orderBy(*order).limit(1)
    place = F.row_number().over(Window.partitionBy("cost").orderBy(*order))
    # no more than the budget of any cost, which lets the window drop rows before the shuffle
    able = rows.where(F.col("cost").between(1, budget)).withColumn("place", place).where(F.col("place") <= budget).where(F.col("place") * F.col("cost") <= budget).drop("place")
    listed = able.unionByName(first.where(F.col("cost") > budget))

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, begun = 0, False
        for batch in batches:
            kept = []
            for cost in batch.column("cost").to_pylist():
                fits = not begun or total + cost <= budget
                total, begun = total + cost * fits, True
                kept.append(fits)
            yield batch.filter(pa.array(kept, pa.bool_()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listed.schema.fields)
    folded = listed.repartition(1).sortWithinPartitions(*order).mapInArrow(fold, kinds)
    return folded.unionByName(rows.where("cost = 0")).drop("cost")


def prefix_fitting(ranked: DataFrame, budget: int, order: Sequence[str], group: str) -> DataFrame:
    """Rows of each group in order until the running sum of ``tokens`` passes the budget."""
    return running_total(ranked, group, order, F.col("tokens"), "running").where(F.col("running") <= budget)


def truncated_fitting(docs: DataFrame, budget: int, order: Sequence[str], group: str, least: int = 100) -> DataFrame:
    """As ``prefix_fitting``, but the first that overflows is cut (4 characters a token) if more
    than ``least`` tokens are left."""
    rows = running_total(docs, group, order, F.col("tokens"), "running").withColumn("before", F.col("running") - F.col("tokens")).drop("running")
    left = budget - F.col("before")
    fits, cut = F.col("tokens") <= left, (F.col("before") < budget) & (left > least)
    rows = rows.where(fits | cut).withColumn("content", F.when(fits, F.col("content")).otherwise(F.substring("content", F.lit(1), (4 * left).cast("int"))))
    return rows.withColumn("tokens", F.when(fits, F.col("tokens")).otherwise(left)).drop("before")


def names_in(text: Column) -> Column:
    """Distinct names in a question, by pattern, then place."""
    return F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in NAME_PATTERNS)))


def search_terms(text: Column, most: int) -> Column:
    """The first ``most`` words of more than two letters that are no stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?<![a-z0-9_])([a-z_][a-z0-9_]*)(?![a-z0-9_])"), F.lit(1))
    return F.slice(F.filter(found, lambda w: ~w.isin(*STOP_WORDS) & (F.length(w) > 2)), 1, most)


def asked_domain(text: Column) -> Column:
    """The domain that a question is about, or null."""
    low = F.lower(text)
    return F.coalesce(*(F.nullif(F.regexp_extract(low, p, 1), F.lit("")) for p in DOMAIN_PATTERNS))


def lexical_scores(docs: DataFrame, terms: Sequence[str], text: str, key: str) -> DataFrame:
    """Sum over terms of count * ln(1 + documents / documents with the term), as ``score``."""
    words = F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("([a-z0-9_]+)"), F.lit(1))).alias("term")
    counts = docs.select(key, words).where(F.col("term").isin(*terms)).groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))
    having = counts.groupBy("term").agg(F.count(F.lit(1)).alias("having"))
    total = docs.agg(F.count(F.lit(1)).alias("docs"))
    weight = F.log(1 + F.col("docs") / F.col("having"))
    return counts.join(F.broadcast(having.join(total)), "term").groupBy(key).agg(F.sum(F.col("n") * weight).alias("score"))


#: Where a question names a repository, in the order in which they are tried.
REPOSITORY_PATTERNS = (
    r"^([a-zA-Z0-9_\-]+)\s+",
    r"\bin\s+([a-zA-Z0-9_\-]+)",
    r"\bfrom\s+([a-zA-Z0-9_\-]+)",
    r"\bfor\s+([a-zA-Z0-9_\-]+)",
    r"\b([a-zA-Z0-9_\-]+)\s+repository",
    r"\b([a-zA-Z0-9_\-]+)\s+repo\b",
)


def asked_repository(questions: DataFrame, text: str, repositories: DataFrame, key: str) -> DataFrame:
    """key and repo_id: the first name by pattern that is a known repository (any case); the only
    repository if there is just one; null otherwise."""
    names = F.array(*(F.lower(F.regexp_extract(text, p, 1)) for p in REPOSITORY_PATTERNS))
    known = repositories.select("repo_id", F.lower("repo_id").alias("name")).distinct()
    tried = questions.select(key, F.posexplode(names).alias("rank", "name")).where("name <> ''").join(known, "name")
    found = tried.groupBy(key).agg(F.min_by("repo_id", "rank").alias("found"))
    only = repositories.select("repo_id").distinct().agg(F.when(F.count(F.lit(1)) == 1, F.min("repo_id")).alias("only"))
    return questions.select(key).join(found, key, "left").join(F.broadcast(only)).select(key, F.coalesce("found", "only").alias("repo_id"))


def start_symbols(*ranked: DataFrame) -> DataFrame:
    """id and rank: of several lists of ids, those of earlier lists first, each id once."""
    every = None
    for k, part in enumerate(ranked):
        part = part.select("id", F.lit(k).alias("rank"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("id").agg(F.min("rank").alias("rank"))


def unified(chunks: DataFrame, query: DataFrame, symbols: DataFrame, edges: DataFrame, k: int, *, least_score: float = 0.0, related: bool = True, documentation: bool = True, most_documents: int = 100) -> DataFrame:
    """Code chunks with their symbol and what that is related to, and documentation chunks, in one table.

    ``chunks``: chunk_id, file_path, embedding; ``symbols``: id (that of the chunk), name. Code are the
    files that don't end in ``.md``, of which the best k stay; of the others the best
    ``most_documents`` (none without ``documentation``), which have no symbol. related: distinct
    ``name:type`` over CALLS, IMPORTS and USES; empty without ``related``.
    """
    is_text = F.col("file_path").endswith(".md")
    best = similar(chunks, query, k, prefilter=~is_text).where(F.col("score") >= least_score)
    out = best.select("chunk_id", "file_path", "score", F.lit(False).alias("is_documentation"))
    out = out.join(symbols.select(F.col("id").alias("chunk_id"), F.col("name").alias("symbol")), "chunk_id", "left")
    if related:
        near = edges.where(F.col("edge_type").isin("CALLS", "IMPORTS", "USES")).join(symbols.select(F.col("id").alias("dst"), F.col("name").alias("other")), "dst")
        near = near.join(out.select(F.col("chunk_id").alias("src")), "src", "left_semi").groupBy(F.col("src").alias("chunk_id")).agg(F.array_sort(F.collect_set(F.concat_ws(":", "other", "edge_type"))).alias("related"))
        out = out.join(near, "chunk_id", "left")
    else:
        out = out.withColumn("related", F.lit(None).cast("array<string>"))
    if documentation:
        texts = similar(chunks, query, most_documents, prefilter=is_text).where(F.col("score") >= least_score)
        out = out.unionByName(texts.select("chunk_id", "file_path", "score", F.lit(True).alias("is_documentation"), F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("array<string>").alias("related")))
    return out.withColumn("related", F.coalesce("related", F.array().cast("array<string>")))


def hybrid_traversal(chunks: DataFrame, query: DataFrame, edges: DataFrame, k: int, depth: int = 2, types: Sequence[str] | None = None, terms: Sequence[str] = ()) -> DataFrame:
    """chunk_id, id and depth: what is reached from the best chunks in up to ``depth`` steps, held to 1 to 3.

    A chunk's node has its id. With ``terms`` (words to look for in ``content``) the lexically
    best k chunks count as well: the mode is hybrid then, by vectors only otherwise.
    """
    best = similar(chunks, query, k).select(F.col("chunk_id").alias("id"))
    if terms:
        lexical = lexical_scores(chunks, terms, "content", "chunk_id").orderBy(F.desc("score"), "chunk_id").limit(k)
        best = best.unionByName(lexical.select(F.col("chunk_id").alias("id"))).distinct()
    found, _ = graph.traverse(edges, best, min(max(depth, 1), 3), "both", types)
    return found


def search_packets(chunks: DataFrame, query: DataFrame, symbols: DataFrame, edges: DataFrame, k: int, hops: int = 2, preview: int = 500) -> DataFrame:
    """chunk_id, score, preview and related of the k nearest chunks: the beginning of the text, and the names (sorted, distinct) of all
    symbols up to ``hops`` edges away from the chunk's own in either direction."""
    best = written(similar(chunks, query, k).select("chunk_id", "score", F.substring("content", 1, preview).alias("preview")))
    starts = best.select(F.col("chunk_id").alias("id")).join(symbols, "id", "left_semi")
    near = graph.shortest_paths(edges, starts, hops).where("length > 0").select(F.col("start").alias("chunk_id"), "id")
    names = near.join(symbols.select("id", "name"), "id").groupBy("chunk_id").agg(F.array_sort(F.collect_set("name")).alias("related"))
    return best.join(names, "chunk_id", "left").withColumn("related", F.coalesce("related", F.array().cast("array<string>")))


def hits_with_neighbours(chunks: DataFrame, query: DataFrame, symbols: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """chunk_id, first and second: for each of the k nearest chunks the ids one edge and two edges away, sorted."""
    best = written(similar(chunks, query, k).select("chunk_id"))
    starts = best.select(F.col("chunk_id").alias("id")).join(symbols, "id", "left_semi")
    near = graph.shortest_paths(edges, starts, 2)
    lists = [F.array_sort(F.collect_list(F.when(F.col("length") == n, F.col("id")))).alias(name) for n, name in ((1, "first"), (2, "second"))]
    found = near.groupBy(F.col("start").alias("chunk_id")).agg(*lists)
    none = F.array().cast(found.schema["first"].dataType)
    return best.join(found, "chunk_id", "left").select("chunk_id", F.coalesce("first", none).alias("first"), F.coalesce("second", none).alias("second"))


def context_graph(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """The edges among all that the start symbols (id) reach in up to ``hops`` edges."""
    reached, _ = graph.traverse(edges, starts, hops)
    return graph.induced(edges, reached)


#: The steps of a retrieval, in order, and the one step of a question about a domain.
RETRIEVAL_STEPS = ("vector_search", "anchor_expansion", "graph_expansion", "location_scoring", "ranking_results", "building_context")
DOMAIN_STEP = "domain_retrieval"


class Progress:
    """Runs each step of a retrieval, counts its rows while they are written, and tells ``report`` (step, number, of, rows)."""

    def __init__(self, report: Callable[[str, int, int, int], None] | None = None) -> None:
        self.report, self.steps = report, []

    def step(self, name: str, df: DataFrame, number: int | None = None, of: int = len(RETRIEVAL_STEPS)) -> DataFrame:
        number = RETRIEVAL_STEPS.index(name) + 1 if number is None else number
        seen = Observation(name)
        out = written(df.observe(seen, F.count(F.lit(1)).alias("rows")))
        self.steps.append((name, number, of, seen.get["rows"]))
        if self.report:
            self.report(*self.steps[-1])
        return out

    def rows(self, spark: SparkSession) -> DataFrame:
        """step, number, of, percent, rows: what was done so far."""
        told = spark.createDataFrame(self.steps, "step string, number int, of int, rows long")
        return told.select("step", "number", "of", (100.0 * F.col("number") / F.col("of")).alias("percent"), "rows")


def retrieve(question: str, query: DataFrame, chunks: DataFrame, links: DataFrame, nodes: DataFrame, edges: DataFrame, settings: Settings, *, anchors: Sequence[str] = (), current_file: str | None = None, stack: str | None = None, progress: Progress | None = None) -> DataFrame:
    """From a question to ranked chunks within the token budget: chunk_id, file_path, tokens, final, distance, anchor.

    ``query`` holds the question's vector (embedding). A question about a domain takes the
    chunks below the folder of that name. Otherwise: the nearest chunks; chunks of anchored
    files, of frames of an error ``stack`` and of symbols that the question names; chunks of
    symbols around theirs; a bonus for the current file and folder; and the first fit of
    the ranked ones. ``chunks``: chunk_id, file_path, start_line, end_line, content,
    embedding; ``links``: chunk_id, id. With ``progress`` each step is run and told as it is
    done; without, nothing runs but the search of the graph until the result is used.
    """
    settings = settings.checked()
    told = progress.step if progress else lambda name, df: df
    spark = chunks.sparkSession
    asked = spark.range(1).select(F.lit(question).alias("q"))
    domain, names = asked.select(asked_domain(F.col("q")), names_in(F.col("q"))).first()  # one row
    plain = chunks.select("chunk_id", "file_path", "start_line", "end_line", F.floor(F.length("content") / 4).cast("long").alias("tokens"))
    if domain and not (inside := plain.where(F.concat(F.lit("/"), F.lower("file_path")).contains(f"/{domain}/"))).isEmpty():
        rows = inside.withColumns({"final": F.lit(1.0), "distance": F.lit(-1), "anchor": F.lit(False)})
        fit = fitting(rows.select("chunk_id", "file_path", "tokens", "final", "distance", "anchor"), settings.max_context_tokens, [F.col("file_path"), F.col("chunk_id")])
        return progress.step(DOMAIN_STEP, fit, 1, 1) if progress else fit

    best = similar(chunks, query, settings.top_k_vector, settings.similarity_function).select("chunk_id", "score", F.lit(False).alias("anchor"))
    parts = [best := told(RETRIEVAL_STEPS[0], best)]
    wanted = nodes.where(F.col("name").isin(*names)) if names else nodes.where("false")
    by_name = links.join(wanted.select("id"), "id", "left_semi").select("chunk_id")
    pinned = by_name.unionByName(plain.where(F.col("file_path").isin(*anchors)).select("chunk_id")) if anchors else by_name
    if stack:
        at = spark.range(1).select(F.inline(frames(F.lit(stack)))).select(F.col("file").alias("file_path"), "line")
        pinned = pinned.unionByName(chunks_of_frames(plain.drop("tokens"), at).select("chunk_id"))
    parts.append(pinned.distinct().withColumns({"score": F.lit(0.5), "anchor": F.lit(True)}))
    rows = told(RETRIEVAL_STEPS[1], merged(*parts))

    starts = links.join(rows.select("chunk_id"), "chunk_id", "left_semi").select("id").distinct()
    near, _ = graph.traverse(edges, starts, settings.graph_expansion_hops, "both", row_cap=settings.max_expansion_nodes)
    distance = near.join(links, "id").groupBy("chunk_id").agg(F.min("depth").alias("distance"))
    rows = rows.join(distance, "chunk_id", "full_outer").withColumns({"score": F.coalesce("score", F.lit(0.0)), "anchor": F.coalesce("anchor", F.lit(False)), "distance": F.coalesce("distance", F.lit(-1))})
    rows = told(RETRIEVAL_STEPS[2], rows.join(plain, "chunk_id"))
    final = final_score(settings, F.col("score"), F.col("distance"), F.col("anchor"))
    if current_file:
        final = final + location_bonus(settings, F.col("file_path"), current_file)
    rows = told(RETRIEVAL_STEPS[3], rows.withColumn("final", final if settings.enable_ranking else F.col("score")))
    rows = told(RETRIEVAL_STEPS[4], rows.select("chunk_id", "file_path", "tokens", "final", "distance", "anchor").orderBy(F.desc("final"), "chunk_id") if progress else rows.select("chunk_id", "file_path", "tokens", "final", "distance", "anchor"))
    return told(RETRIEVAL_STEPS[5], fitting(rows, settings.max_context_tokens, [F.desc("final"), F.col("chunk_id")]))
