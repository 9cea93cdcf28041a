"""Records that are changed in part, deleted or merged, and what is read out of reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import state, text
from weftgraph.sources import derived
from weftgraph.sources.tables import table

from .registry import query


@query("SELECT event_id, greatest(coalesce(a, b), coalesce(b, a)) AS most, CASE WHEN coalesce(x, '') = '' THEN coalesce(nullif(y, ''), '') WHEN coalesce(y, '') = '' THEN x ELSE x || chr(10) || y END AS said FROM (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS a, CASE WHEN event_id % 5 <> 0 THEN 50.0 END AS b, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE event_type END AS x, CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE props END AS y FROM events)")
def i9_reducers(spark, sf_dir):
    """The larger value and both texts, where either may be missing."""
    n = F.col("event_id")
    a, b = F.when(n % 3 != 0, F.col("value")), F.when(n % 5 != 0, F.lit(50.0))
    x = F.when(n % 4 == 0, "").when(n % 4 != 1, F.col("event_type"))
    y = F.when(n % 7 == 0, "").when(n % 7 != 1, F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", state.larger(a, b).alias("most"), state.joined_texts(x, y).alias("said"))


@query("SELECT event_type, error IS NOT NULL AND error <> '' AS failed, count(*) AS n FROM (SELECT event_type, CASE WHEN event_type = 'error' THEN props WHEN event_id % 2 = 0 THEN '' END AS error FROM events) GROUP BY 1, 2")
def i11_by_success(spark, sf_dir):
    """Results without an error, whether it is null or empty, and those with one."""
    rows = table(spark, sf_dir, "events").withColumn("error", F.when(F.col("event_type") == "error", F.col("props")).when(F.col("event_id") % 2 == 0, ""))
    good, bad = (part.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("failed", F.lit(k == 1)) for k, part in enumerate(state.by_success(rows, "error")))
    return good.unionByName(bad)


@query("WITH o AS (SELECT o_custkey AS task, o_orderpriority AS agent, min(o_orderstatus) AS output FROM orders GROUP BY 1, 2), s AS (SELECT task, count(DISTINCT output) AS outputs, arg_min(output, agent) AS first FROM o GROUP BY task) SELECT task, outputs > 1 AS conflict, CASE WHEN task % 5 = 0 THEN 'settled' ELSE first END AS output, CASE WHEN task % 5 = 0 THEN 'resolution' WHEN outputs > 1 THEN 'conflict' ELSE 'agent' END AS source FROM s")
def i12_merged_outputs(spark, sf_dir):
    """Outputs of agents by task; resolutions win over outputs, and conflicts are told."""
    outputs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("task"), F.col("o_orderpriority").alias("agent")).agg(F.min("o_orderstatus").alias("output"))
    settled = outputs.where("task % 5 = 0").select("task", F.lit("settled").alias("resolution")).distinct()
    merged, conflicts = state.merged_outputs(outputs, settled)
    return merged.join(conflicts, "task", "left").select("task", F.col("outputs").isNotNull().alias("conflict"), "output", "source")


@query("WITH x AS (SELECT min(file_path) AS file_path FROM g_files), c AS (SELECT 'chunk' AS label, count(*) AS n FROM g_chunks k JOIN g_symbols s ON s.id = k.chunk_id, x WHERE s.file_path = x.file_path UNION ALL SELECT 'symbol', count(*) FROM g_symbols s, x WHERE s.file_path = x.file_path UNION ALL SELECT 'file', count(*) FROM g_files f, x WHERE f.file_path = x.file_path) SELECT * FROM c WHERE n > 0 UNION ALL SELECT 'total', CAST(sum(n) AS BIGINT) FROM c")
def w9_delete_by_file(spark, sf_dir):
    """What deleting a file takes away: its chunks, symbols and node."""
    symbols, files = derived.symbols(spark, sf_dir), derived.files(spark, sf_dir)
    path = files.agg(F.min("file_path")).first()[0]
    chunks = derived.chunks(spark, sf_dir).select(F.col("chunk_id").alias("id")).join(symbols.select("id", "file_path"), "id")
    return state.deleted_counts({"chunk": chunks, "symbol": symbols, "file": files}, F.col("file_path") == path)


@query("SELECT repo_id, count(*) FILTER (chunk_id % 10 = 0) AS by_id, count(*) FILTER (language = 'de') AS by_language, count(*) FILTER (chunk_id % 10 <> 0 AND language <> 'de') AS left_over FROM g_chunks GROUP BY repo_id")
def w12_delete_vectors(spark, sf_dir):
    """Vectors deleted by ids, then by an attribute; counts of each, and what is left."""
    rows = derived.chunks(spark, sf_dir).select("chunk_id", "repo_id", "language")
    by_id, by_language = rows.where("chunk_id % 10 = 0"), rows.where("language = 'de'")
    left = state.without(state.without(rows, by_id, ["chunk_id"]), by_language, ["chunk_id"])
    parts = [(by_id, "by_id"), (by_language, "by_language"), (left, "left_over")]
    every = rows.select("repo_id").distinct()
    for part, name in parts:
        every = every.join(part.groupBy("repo_id").agg(F.count(F.lit(1)).alias(name)), "repo_id", "left").fillna(0, [name])
    return every


@query("SELECT c_custkey AS repo_id, CASE WHEN c_custkey % 4 = 0 THEN 'ready' WHEN c_custkey % 4 = 1 THEN 'error' ELSE c_mktsegment END AS status, CASE WHEN c_custkey % 4 = 1 THEN 'broken ' || c_custkey END AS error_message, c_name AS git_url, round(CASE WHEN c_custkey % 4 = 0 THEN 100.0 ELSE c_acctbal END, 2) AS progress FROM customer")
def w21_partial_updates(spark, sf_dir):
    """Changes by key that say nothing of other columns: status, error, progress."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repo_id"), F.col("c_mktsegment").alias("status"), F.lit(None).cast("string").alias("error_message"), F.col("c_name").alias("git_url"), F.col("c_acctbal").alias("progress"))
    ready = rows.where("repo_id % 4 = 0").select("repo_id", F.lit("ready").alias("status"), F.lit(100.0).alias("progress"))
    failed = rows.where("repo_id % 4 = 1").select("repo_id", F.lit("error").alias("status"), F.concat(F.lit("broken "), F.col("repo_id").cast("string")).alias("error_message"), F.lit(None).cast("double").alias("progress"))
    out = state.patched(state.patched(rows, ready, "repo_id"), failed, "repo_id")
    return out.withColumn("progress", F.round("progress", 2))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '2024-01-01' WHEN n_chars > 5000 THEN '2024-02-02' END AS deleted_at, min(doc_id) FILTER (doc_id % 7 <> 0 AND n_chars <= 5000) OVER (PARTITION BY sha256(text)) AS by_hash FROM documents")
def w28_soft_deletes(spark, sf_dir):
    """Rows get a time of deletion once; a look-up by hash passes over deleted rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("hash"), F.when(F.col("doc_id") % 7 == 0, "2024-01-01").alias("deleted_at"))
    gone = state.soft_deleted(docs, docs.where("n_chars > 5000"), "doc_id", F.lit("2024-02-02"))
    by_hash = gone.where("deleted_at IS NULL").groupBy("hash").agg(F.min("doc_id").alias("by_hash"))
    return gone.join(by_hash, "hash", "left").select("doc_id", "deleted_at", "by_hash")


@query("SELECT id, CASE WHEN id % 3 = 0 THEN '' ELSE 'about ' || name END AS summary, CASE WHEN id % 3 = 0 THEN '' ELSE 'first ' || id || '|second' END AS insights, CASE WHEN id % 2 = 0 THEN 0.5 ELSE (id % 100) / 100.0 END AS confidence, 's' || id || '|t' AS sources, 'graph ' || id || '|pie' AS diagrams, 'see [Data Flow](#data-flow), {{ref:nope}} and [Api](#api)' AS linked FROM g_symbols")
def x20_report_parts(spark, sf_dir):
    """Sections, lists and confidence of reports, diagrams in fences, references to sections."""
    n = F.col("id").cast("string")
    head = F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("## Summary\n\n about "), "name", F.lit(" \n## Key Insight\n1. first "), n, F.lit("\nno\n12. second")))
    tail = F.concat(F.lit("\n## Sources\n- s"), n, F.lit("\n* t\nx - y\n## End\n"), F.when(F.col("id") % 2 == 0, "no confidence").otherwise(F.concat(F.lit("**Confidence: "), (F.col("id") % 100).cast("string"), F.lit("%**"))))
    drawn = F.concat(F.lit("```mermaid\ngraph "), n, F.lit("\n```\n```python\nx\n```\n```mermaid  \n\npie\n\n```"))
    found = text.findings(F.concat(head, tail))
    linked = text.cross_references(F.lit("see {{ref:data_flow}}, {{ref:nope}} and {{ref:api}}"), ["api", "data_flow"])
    return derived.symbols(spark, sf_dir).select("id", found["summary"].alias("summary"), F.array_join(found["insights"], "|").alias("insights"), found["confidence"].alias("confidence"), F.array_join(found["sources"], "|").alias("sources"), F.array_join(text.diagrams(drawn), "|").alias("diagrams"), linked.alias("linked"))
