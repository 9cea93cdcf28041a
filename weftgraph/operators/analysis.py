"""Rule chains: entry points, domain concepts, data flow steps, questions, tasks, confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators import graph
from weftgraph.sources.tables import written

#: Patterns of entry points, on lower-cased file paths and names.
HTTP_FILES = r"(routes?|views?|api|endpoints?|handlers?|controllers?)\.py$"
CLI_FILES = r"(cli|__main__|main|commands?)\.py$"
HTTP_NAMES = "^(get|post|put|patch|delete|create|update|list|retrieve)_"
CLI_NAMES = "^(main|cli|run|execute)$|^command_|_command$"
EVENT_NAMES = "^(on|handle|process)_|_(handler|callback|listener)$"
SCHEDULED_NAMES = "^(task|job|schedule|cron)_|_(task|job)$"
#: Class names by domain category, in the order in which they are tried.
DOMAIN_NAMES = (
    ("repository", "(Repository|Repo|DAO|Store|Gateway)$"),
    ("service", "(Service|Manager|Handler|Controller|Processor|Provider)$"),
    ("value_object", "(DTO|Request|Response|Schema|Params?|Config|Settings|Options)$"),
    ("utility", "(Utils?|Helpers?|Mixin)$"),
    ("entity", "(Model|Entity)$|^Base[A-Z]"),
)
#: Base classes (lower case) by category, and folders of entities.
DOMAIN_BASES = (
    ("entity", ("model", "basemodel", "entity", "base", "dbmodel", "sqlalchemybase", "declarativebase", "pydanticmodel")),
    ("service", ("service", "baseservice", "abstractservice")),
    ("repository", ("repository", "baserepository", "abstractrepository")),
)
ENTITY_FOLDERS = "/(models?|entities?|domain)/"
#: Words that tell what a step of a data flow does.
PERSIST = ("save", "store", "persist", "write", "insert", "update", "delete", "create", "put", "commit", "flush", "add", "remove", "set", "repository", "dao", "db", "database", "cache", "redis", "mongo")
RETURN = ("return", "response", "result", "output", "serialize", "format", "render", "json", "to_dict", "to_json", "encode", "transform")
#: Words by kind of agent, in the order that settles ties.
AGENT_WORDS = {
    "code_analyst": ("analyze", "pattern", "dependency", "structure", "tracing"),
    "code_generator": ("write", "create", "generate", "refactor", "implement"),
    "researcher": ("document", "explain", "research", "understand", "investigate"),
    "architect": ("design", "architecture", "structure", "evaluate"),
    "security": ("security", "vulnerability", "safe", "audit"),
}
#: What makes a question specific, vague, generic or architectural.
SPECIFIC = (".py", ".js", ".java", ".ts", ".go", ".rb", "def ", "import ", "from ", "authenticate", "calculate", "process", "validate", "service", "controller", "model", "handler", "manager")
SPECIFIC_WORDS = "(^|[^a-z0-9_])(function|class|method|file|module)([^a-z0-9_]|$)"
VAGUE = ("how", "what", "why", "explain", "tell me about", "show me")
GENERIC = ("this", "that", "it", "the code", "the system", "here", "there")
ARCHITECTURAL = ("architecture", "overview", "core functionality", "data flow", "data flows", "end-to-end", "end to end", "how does the", "how do the", "how it works", "explain the", "describe the", "communicate", "integrate", "platform", "pipeline", "workflow", "infrastructure")


def any_of(text: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def entry_type(name: Column, file_path: Column) -> Column:
    """``main``, ``http``, ``cli``, ``event`` or ``scheduled``, the first that fits; else null."""
    name, path = F.lower(name), F.lower(file_path)
    main = (name == "main") | (path.contains("__main__.py") & name.isin("main", "run", "cli", "execute"))
    return (
        F.when(main, "main")
        .when(path.rlike(HTTP_FILES) & name.rlike(HTTP_NAMES), "http")
        .when((path.rlike(CLI_FILES) | path.contains("/commands/")) & name.rlike(CLI_NAMES), "cli")
        .when(name.rlike(EVENT_NAMES), "event")
        .when(name.rlike(SCHEDULED_NAMES), "scheduled")
    )


def domain_category(name: Column, file_path: Column, bases: Column) -> Column:
    """By the first base class that is known, else by name, else by folder; else null."""
    by_base = F.lit(None).cast("string")
    for category, names in reversed(DOMAIN_BASES):
        by_base = F.when(F.element_at(F.filter(F.transform(bases, F.lower), lambda b: b.isin(*(n for _, every in DOMAIN_BASES for n in every))), 1).isin(*names), category).otherwise(by_base)
    by_name = F.lit(None).cast("string")
    for category, pattern in reversed(DOMAIN_NAMES):
        by_name = F.when(name.rlike(pattern), category).otherwise(by_name)
    return F.coalesce(F.when(F.size(bases) > 0, by_base), by_name, F.when(F.lower(file_path).rlike(ENTITY_FOLDERS), "entity"))


def concept_relations(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst, relation between concepts (id, name, category): the edge type EXTENDS first, one for
    each pair; uses among others, but between entities belongs_to if the target's name is in the
    source's, else has_many."""
    rank = F.when(F.col("edge_type") == "EXTENDS", 0).otherwise(1)
    pairs = edges.where(F.col("edge_type").isin("EXTENDS", "CALLS", "IMPORTS") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.min(rank).alias("rank"))
    a = concepts.select(F.col("id").alias("src"), F.lower("name").alias("src_name"), F.col("category").alias("src_category"))
    b = concepts.select(F.col("id").alias("dst"), F.lower("name").alias("dst_name"), F.col("category").alias("dst_category"))
    both = (F.col("src_category") == "entity") & (F.col("dst_category") == "entity")
    relation = F.when(F.col("rank") == 0, "extends").when(both & F.col("src_name").contains(F.col("dst_name")), "belongs_to").when(both, "has_many").otherwise("uses")
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", relation.alias("relation"))


def step_type(name: Column, file_path: Column, doc: Column) -> Column:
    name, path, doc = F.lower(name), F.lower(F.coalesce(file_path, F.lit(""))), F.lower(F.coalesce(doc, F.lit("")))
    return F.when(any_of(name, PERSIST) | any_of(path, PERSIST) | any_of(doc, PERSIST), "persist").when(any_of(name, RETURN) | any_of(doc, RETURN), "return").otherwise("process")


def data_flow(nodes: DataFrame, edges: DataFrame, entries: DataFrame, max_depth: int) -> DataFrame:
    """entry, position, id, name, depth, step, truncated: what each entry (id) calls, in the order of discovery.

    Each symbol is a step once, at its depth of search, and those of a depth go by id; the entry
    itself is step 0 of type entry, others are told by ``step_type`` of name, file_path and doc. A
    flow is truncated if it reaches ``max_depth`` (at least 1), as more may follow.
    """
    most = max(1, max_depth)
    found = graph.shortest_paths(edges, entries.select("id").distinct(), most, directed=True).select(F.col("start").alias("entry"), "id", F.col("length").alias("depth"))
    deep = Window.partitionBy("entry")
    placed = found.withColumns({"position": (F.row_number().over(deep.orderBy("depth", "id")) - 1).cast("long"), "truncated": F.max("depth").over(deep) >= most})
    known = nodes.select("id", "name", step_type(F.col("name"), F.col("file_path"), F.col("doc")).alias("kind"))
    return placed.join(known, "id").select("entry", "position", "id", "name", "depth", F.when(F.col("depth") == 0, "entry").otherwise(F.col("kind")).alias("step"), "truncated")


def question_class(text: Column) -> tuple[Column, Column]:
    """(clarity, type) of a question."""
    low = F.lower(text)
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    identifier = text.rlike("[A-Z][a-z]+[A-Z]") | low.rlike("[a-z]+_[a-z]+")
    specific = low.rlike(SPECIFIC_WORDS) | any_of(low, SPECIFIC)
    named = specific | identifier
    broad = any_of(low, ARCHITECTURAL) & (words >= 6) & ~named
    clear = named | ((words >= 5) & ~any_of(low, VAGUE) & ~any_of(low, GENERIC)) | broad
    kind = F.when(broad, "architectural").when(named, "specific").otherwise("general")
    return F.when(clear, "clear").otherwise("vague"), kind


def agent_for(text: Column) -> Column:
    """The kind of agent with most of its words in the text; the first on a tie, and for none."""
    low = F.lower(text)
    hits = [F.struct(sum((low.contains(w).cast("int") for w in words), F.lit(0)).alias("n"), F.lit(-k).alias("rank"), F.lit(agent).alias("agent")) for k, (agent, words) in enumerate(AGENT_WORDS.items())]
    return F.array_max(F.array(*hits))["agent"]


def mention(text: Column) -> tuple[Column, Column, Column]:
    """(name, command, arguments) of ``@name ...`` and ``/command arguments``; null where there is none."""
    name = F.nullif(F.regexp_extract(text, r"^\s*@([A-Za-z0-9_\-]+)", 1), F.lit(""))
    command = F.nullif(F.regexp_extract(text, r"^\s*/([A-Za-z0-9_\-]+)", 1), F.lit(""))
    return name, command, F.when(command.isNotNull(), F.trim(F.regexp_replace(text, r"^\s*/[A-Za-z0-9_\-]+", "")))


def research_confidence(similar: Column, modules: Column, specs: Column, contracts: Column, high_gaps: Column, critical_risks: Column) -> Column:
    score = 0.5 + 0.1 * similar.cast("int") + 0.1 * modules.cast("int") + 0.1 * specs.cast("int") + 0.05 * contracts.cast("int") - 0.1 * high_gaps - 0.05 * critical_risks
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), score))


def agent_confidence(has_context: Column, results: Column, summaries: Column, nested: Column) -> Column:
    score = 0.7 + 0.1 * results.cast("int") + 0.1 * summaries.cast("int") + 0.05 * nested.cast("int")
    return F.when(has_context, F.least(F.lit(1.0), score)).otherwise(F.lit(0.5))


def related_pairs(items: DataFrame, evidence: DataFrame, least: int = 1) -> DataFrame:
    """Pairs a < b of items that share at least ``least`` terms of evidence (item, term): a, b, n and confidence min(0.7 + 0.1 n, 1).

    Pairs come from shared terms, so items without a common term never meet. With ``least``
    over 1 each item is looked up by its rarest terms alone, all but ``least`` - 1 of them:
    two items that share ``least`` terms share one of these. So a term that most items have
    makes no pairs by itself, and is only counted for the pairs that rarer terms have found.
    """
    terms = evidence.where("item IS NOT NULL AND term IS NOT NULL").select("item", "term").distinct()
    known = items.select(F.col("item").alias("a"))
    confidence = F.least(F.lit(1.0), 0.7 + 0.1 * F.col("n"))
    if least <= 1:
        found = terms.select(F.col("item").alias("a"), "term").join(terms.select(F.col("item").alias("b"), "term"), "term").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
        return found.join(known, "a", "left_semi").withColumn("confidence", confidence)

    often = terms.groupBy("term").agg(F.count(F.lit(1)).alias("often"))
    ranked = terms.join(often, "term").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("often", "term"))).alias("by_rarity"))
    sets = written(ranked.select("item", F.col("by_rarity.term").alias("terms")).where(F.size("terms") >= least))
    rare = sets.select("item", F.explode(F.slice("terms", F.lit(1), F.size("terms") - (least - 1))).alias("term"))
    met = rare.select(F.col("item").alias("a"), "term").join(rare.select(F.col("item").alias("b"), "term"), "term").where("a < b").select("a", "b").distinct()
    both = met.join(sets.select(F.col("item").alias("a"), F.col("terms").alias("of_a")), "a").join(sets.select(F.col("item").alias("b"), F.col("terms").alias("of_b")), "b")
    found = both.select("a", "b", F.size(F.array_intersect("of_a", "of_b")).cast("long").alias("n")).where(F.col("n") >= least)
    return found.join(known, "a", "left_semi").withColumn("confidence", confidence)


#: Words of evidence that tell how two repositories are joined; the first kind with one counts.
RELATION_WORDS = {"grpc": ("proto", "grpc"), "rest": ("openapi", "swagger", "http", "rest", "api")}


def relation_kind(evidence: Column) -> Column:
    """grpc, rest or dependency, by the words in an array of evidence."""
    text = F.lower(F.array_join(evidence, " "))
    kind = F.lit("dependency")
    for name, words in reversed(RELATION_WORDS.items()):
        hit = F.lit(False)
        for word in words:
            hit = hit | text.contains(word)
        kind = F.when(hit, name).otherwise(kind)
    return kind


def contract_gaps(relations: DataFrame, contracts: DataFrame) -> DataFrame:
    """source, target, kind, gap and severity of rest and grpc relations (source, target, kind) of which only one side has contracts (repo, title).

    A source with contracts whose target has none lacks ``no_consumer_contracts`` (medium), the
    other way round ``no_provider_contracts`` (high).
    """
    having = contracts.where("title IS NOT NULL").select("repo").distinct()
    rows = relations.where(F.col("kind").isin("rest", "grpc"))
    for side in ("source", "target"):
        rows = rows.join(having.select(F.col("repo").alias(side), F.lit(True).alias(f"{side}_has")), side, "left")
    source, target = F.coalesce("source_has", F.lit(False)), F.coalesce("target_has", F.lit(False))
    gap = F.when(source & ~target, "no_consumer_contracts").when(target & ~source, "no_provider_contracts")
    severity = F.when(source, "medium").otherwise("high")
    return rows.where(source != target).select("source", "target", "kind", gap.alias("gap"), severity.alias("severity"))


def dependency_issues(relations: DataFrame, risks: DataFrame, most: int = 3) -> DataFrame:
    """upstream, downstream, risk_id, severity: of each relation (source, target) the first ``most`` critical or high risks (repo, risk_id, severity) of its source."""
    place = F.row_number().over(Window.partitionBy("repo").orderBy("risk_id", "severity"))
    worst = risks.where(F.lower("severity").isin("critical", "high")).withColumn("place", place).where(F.col("place") <= most).drop("place")
    pairs = relations.select(F.col("source").alias("upstream"), F.col("target").alias("downstream")).distinct()
    return pairs.join(worst.withColumnRenamed("repo", "upstream"), "upstream").select("upstream", "downstream", "risk_id", "severity")


def top_of_type(entries: DataFrame, kind: str, order: Sequence[str], most: int = 10) -> DataFrame:
    """The first ``most`` of each type, and how many more there are, as ``more``."""
    place = F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    # a window with nothing but the place keeps only the first of each partition before the shuffle
    first = entries.withColumn("place", place).where(F.col("place") <= most)
    total = entries.groupBy(F.col(kind).alias("of_kind")).agg(F.greatest(F.lit(0), F.count(F.lit(1)) - most).alias("more"))
    return first.join(total, F.col(kind).eqNullSafe(F.col("of_kind"))).drop("of_kind")
