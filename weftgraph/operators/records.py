"""Records of documents, files, progress, preferences and sessions in a store, and the small decisions that are made on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.sources.store import Store

from . import state


def patch(store: Store, changes: DataFrame, *, batch: tuple[str, int] | None = None) -> int:
    """Changes columns of rows that are there: what is not null in ``changes`` (with the store's key) replaces the old value. Other keys make no row."""
    key = store.key
    now = store.read()
    mine = [c for c in changes.columns if c not in key]
    renamed = changes.select(*key, *(F.col(c).alias(f"new_{c}") for c in mine))
    both = now.join(renamed, key)
    return store.upsert(both.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in mine else F.col(c) for c in now.columns)), batch=batch)


def page(rows: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 0) of so many rows; ``order`` must be total."""
    return rows.orderBy(*order).offset(number * size).limit(size)


def mark_files(store: Store, files: DataFrame, status: str, error: Column | None = None) -> int:
    """Files (with the store's key) become ``status``, new ones too; an earlier error goes."""
    return store.upsert(files.select(*store.key).withColumns({"status": F.lit(status), "error": F.lit(None).cast("string") if error is None else error}))


def repository_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """repo_id, files, symbols, relations: of nodes (id, repo_id, file_path) and the edges that begin in them."""
    held = nodes.groupBy("repo_id").agg(F.count_distinct("file_path").alias("files"), F.count(F.lit(1)).alias("symbols"))
    out = edges.join(nodes.select(F.col("id").alias("src"), "repo_id"), "src").groupBy("repo_id").agg(F.count(F.lit(1)).alias("relations"))
    return held.join(out, "repo_id", "left").fillna(0, ["relations"])


def failure_statistics(failed: DataFrame, top: int = 5) -> DataFrame:
    """what, value, n: failed rows (retry_count, error) by number of retries, and the ``top`` most frequent errors (ties by text)."""
    retries = failed.groupBy("retry_count").agg(F.count(F.lit(1)).alias("n")).select(F.lit("retries").alias("what"), F.col("retry_count").cast("string").alias("value"), "n")
    errors = failed.where("error IS NOT NULL").groupBy("error").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "error").limit(top)
    return retries.unionByName(errors.select(F.lit("error").alias("what"), F.col("error").alias("value"), "n"))


#: Fixed value: an endpoint in a text.
ENDPOINT = r"\b(GET|POST|PUT|PATCH|DELETE)\s+(/[A-Za-z0-9_\-/{}:.]*)"


def duplicate_endpoints(sections: DataFrame, key: str, text: str) -> DataFrame:
    """endpoint (``METHOD /path``) and sections: those that more than one section tells of."""
    both = F.zip_with(F.regexp_extract_all(text, F.lit(ENDPOINT), F.lit(1)), F.regexp_extract_all(text, F.lit(ENDPOINT), F.lit(2)), lambda a, b: F.concat_ws(" ", a, b))
    return sections.select(key, F.explode(F.array_distinct(both)).alias("endpoint")).groupBy("endpoint").agg(F.count_distinct(key).alias("sections")).where("sections > 1")


def dispatched(ready: DataFrame, agents: DataFrame) -> DataFrame:
    """task, agent_type, agent: ready tasks (task, agent_type) with the agent of their type (agent_type, agent); unknown types are passed over."""
    return ready.join(agents.groupBy("agent_type").agg(F.min("agent").alias("agent")), "agent_type").select("task", "agent_type", "agent")


def aggregates_now(done: Column, total: Column, every: int) -> Column:
    """Whether sections are put together now: after each ``every`` done ones, and after the last."""
    return (done > 0) & ((done % every == 0) | (done >= total))


def passes_gate(confidence: Column, iterations: Column, least: float = 0.7, most: int = 3) -> Column:
    """Whether a finding is good enough, or has been tried often enough; no confidence is none."""
    return (F.coalesce(confidence, F.lit(0.0)) >= least) | (F.coalesce(iterations, F.lit(0)) >= most)


def upstream_context(sections: DataFrame, group: str, order: Sequence[str], budget: int, fallback: int = 2000) -> DataFrame:
    """group and text: sections (content, tokens) in order while they fit the budget, joined by blank lines; if not even
    the first fits, its first ``fallback`` characters."""
    fits = state.running_total(sections, group, order, F.col("tokens"), "running").where(F.col("running") <= budget)
    place = F.struct(*order, "content")
    kept = fits.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["content"]), "\n\n").alias("kept"))
    first = sections.groupBy(group).agg(F.min_by("content", F.struct(*order)).alias("first"))
    return first.join(kept, group, "left").select(group, F.coalesce("kept", F.substring("first", 1, fallback)).alias("text"))


def rendered(items: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """group and text: items (file_path, start_line, end_line, symbol, content) as Markdown, numbered in order."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    lead = F.format_string("### %d. %s (lines %d-%d)", F.col("n"), F.col("file_path"), F.col("start_line"), F.col("end_line"))
    symbol = F.when(F.col("symbol").isNotNull(), F.concat(F.lit("\nSymbol: "), "symbol")).otherwise(F.lit(""))
    part = F.concat(lead, symbol, F.lit("\n```\n"), F.coalesce("content", F.lit("")), F.lit("\n```"))
    rows = items.withColumn("n", n).select(group, "n", part.alias("part"))
    return rows.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), "\n\n").alias("text"))


def story_totals(stories: DataFrame, must: str = "must_have") -> DataFrame:
    """phase, stories, points and must of ``stories`` (phase, points, priority): how many there are, their points, and how
    many have the priority ``must``; null points are none, and stories without a phase are a row of their own."""
    needed = F.count(F.when(F.col("priority") == must, 1))
    return stories.groupBy("phase").agg(F.count(F.lit(1)).alias("stories"), F.coalesce(F.sum("points"), F.lit(0)).alias("points"), needed.alias("must"))


def classes(nodes: DataFrame, folder: str = "") -> DataFrame:
    """Nodes of kind class below a folder."""
    return nodes.where((F.col("kind") == "class") & F.col("file_path").startswith(folder))


def chunk_ids(chunks: DataFrame, repo_id: str) -> DataFrame:
    """The ids of a repository's chunks."""
    return chunks.where(F.col("repo_id") == repo_id).select("chunk_id")


def matching(rows: DataFrame, **equal) -> DataFrame:
    """Rows whose columns have these values; None asks for null, a list for one of several."""
    for column, value in equal.items():
        of = F.col(column)
        rows = rows.where(of.isNull() if value is None else of.isin(*value) if isinstance(value, (list, tuple, set)) else of == value)
    return rows


def not_in_states(rows: DataFrame, column: str, states: Sequence[str]) -> DataFrame:
    """Rows in none of these states; a null state is none of them."""
    return rows.where(F.col(column).isNull() | ~F.col(column).isin(*states))


def chunks_of_file(chunks: DataFrame, file: Column, path: str, order: Sequence[str]) -> DataFrame:
    """A file's chunks in order."""
    return chunks.where(file == path).orderBy(*order)


def lines_between(text: Column, first: int, last: int) -> Column:
    """Lines first to last (from 1, both included) of a text, as many of them as it has."""
    return F.array_join(F.slice(F.split(text, "\n"), first, last - first + 1), "\n")


def first_of_hash(rows: DataFrame, content: str, key: str) -> DataFrame:
    """content_hash, ``key`` and copies: of rows with the same content the first key, and how many there are."""
    return rows.groupBy(F.sha2(content, 256).alias("content_hash")).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))


def symbol_links(symbols: DataFrame) -> DataFrame:
    """file_path, name, target (the first id) and n: what a chunk that names a file and a symbol is linked with."""
    return symbols.groupBy("file_path", "name").agg(F.min("id").alias("target"), F.count(F.lit(1)).alias("n"))


def average_confidence(rows: DataFrame, group: str, value: str, otherwise: float = 0.5) -> DataFrame:
    """group and confidence: the mean to three places, ``otherwise`` where nothing has a value."""
    return rows.groupBy(group).agg(F.round(F.coalesce(F.avg(value), F.lit(otherwise)), 3).alias("confidence"))


def cross_cutting(rows: DataFrame, category: str, repo: str, least: int = 2) -> DataFrame:
    """category, n and sources of those that are found in at least ``least`` repositories."""
    return rows.groupBy(category).agg(F.count_distinct(repo).alias("n"), F.array_join(F.array_sort(F.collect_set(repo)), ",").alias("sources")).where(F.col("n") >= least)


def edge_groups(edges: DataFrame) -> DataFrame:
    """edge_type with its numbers of sources, targets and edges."""
    return edges.groupBy("edge_type").agg(F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"), F.count(F.lit(1)).alias("edges"))


def first_of_each(rows: DataFrame, group: str, order: Sequence[str], most: int) -> DataFrame:
    """The first ``most`` rows of each group."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("place_in_group", place).where(F.col("place_in_group") <= most).drop("place_in_group")


def undefined_references(references: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """Distinct references to what isn't known."""
    return state.without(references.select(key).distinct(), known, [key])


def sufficiency(found: Column, enough: int = 5) -> Column:
    """Whether there is enough context: sufficient, sparse or none."""
    return F.when(found >= enough, "sufficient").when(found > 0, "sparse").otherwise("none")


def by_link(rows: DataFrame, sources: DataFrame, link: Column, groups: Sequence[Column], name: str) -> DataFrame:
    """How many rows each source is linked with, by groups."""
    return rows.join(sources, link).groupBy(*groups).agg(F.count(F.lit(1)).alias(name))
