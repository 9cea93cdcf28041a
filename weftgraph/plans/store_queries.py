"""Records in stores, by what is done with them, and the decisions on them: one query for each row that others shared."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import dag, records, retrieval
from weftgraph.sources import derived
from weftgraph.sources.store import Store
from weftgraph.sources.tables import fresh_path, table

from .registry import query


def store(spark, rows, key):
    """A store that holds these rows."""
    made = Store.create(spark, fresh_path(spark), rows.schema, key, buckets=16)
    made.upsert(rows)
    return made


@query("SELECT doc_id AS chunk_id FROM documents WHERE source = 'src1'")
def s15_chunk_ids(spark, sf_dir):
    """The ids of one repository's chunks."""
    return records.chunk_ids(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("repo_id")), "src1")


CHUNK = "doc_id AS chunk_id, source AS repo_id, lang AS language, 'f' || doc_id % 9 AS file_path, doc_id AS start_line, doc_id + 5 AS end_line, length(text) AS size, sha256(text) AS digest"


@query(f"SELECT {CHUNK}, CASE WHEN doc_id % 4 = 1 THEN 'again' ELSE 'chunk' END AS kind, CASE WHEN doc_id % 4 = 1 THEN NULL ELSE 'v1' END AS version FROM documents WHERE doc_id % 2 = 0 OR doc_id % 4 = 1")
def w2_chunk_nodes(spark, sf_dir):
    """Chunk nodes with all their properties; a later one takes the earlier one's place, with its nulls."""
    n = F.col("doc_id")
    path = F.concat(F.lit("f"), (n % 9).cast("string"))
    rows = table(spark, sf_dir, "documents").select(n.alias("chunk_id"), F.col("source").alias("repo_id"), F.col("lang").alias("language"), path.alias("file_path"), n.alias("start_line"), (n + 5).alias("end_line"), F.length("text").cast("long").alias("size"), F.sha2("text", 256).alias("digest"), F.lit("chunk").alias("kind"), F.lit("v1").alias("version"))
    made = store(spark, rows.where("chunk_id % 2 = 0 OR chunk_id % 4 = 1"), ["chunk_id"])
    made.upsert(rows.where("chunk_id % 4 = 1").withColumns({"kind": F.lit("again"), "version": F.lit(None).cast("string")}))
    return made.read()


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN list_transform(embedding, lambda x: CAST(0 AS FLOAT))[1] ELSE embedding[1] END AS first, len(embedding) AS dim FROM embeddings WHERE vec_id % 5 <> 2")
def w11_vector_batches(spark, sf_dir):
    """Vectors come in batches by id; those of a later batch overwrite; then some are deleted."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    made = Store.create(spark, fresh_path(spark), rows.schema, ["vec_id"], buckets=16)
    land = made.sink("vectors")
    land(rows, 0)
    land(rows.where("vec_id % 3 = 0").withColumn("embedding", F.transform("embedding", lambda x: F.lit(0.0).cast("float"))), 1)
    made.delete(rows.where("vec_id % 5 = 2").select("vec_id"))
    return made.read().select("vec_id", F.element_at("embedding", 1).alias("first"), F.size("embedding").cast("long").alias("dim"))


@query("SELECT source AS repo_id, lang AS file, CASE WHEN max(doc_id) % 2 = 0 THEN 2 ELSE 1 END AS version, count(*) AS chunks FROM documents GROUP BY source, lang")
def w15_file_index(spark, sf_dir):
    """The index of files by repository and file."""
    rows = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("repo_id"), F.col("lang").alias("file")).agg(F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("chunks"))
    made = store(spark, rows.select("repo_id", "file", F.lit(1).alias("version"), "chunks"), ["repo_id", "file"])
    made.upsert(rows.where("last % 2 = 0").select("repo_id", "file", F.lit(2).alias("version"), "chunks"))
    return made.read()


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'completed' ELSE 'pending' END AS status, o_orderpriority AS title FROM orders WHERE o_orderkey % 7 <> 0")
def w22_document_rows(spark, sf_dir):
    """Documents are made, change their status alone, and are deleted; a change of an unknown one makes none."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("pending").alias("status"), F.col("o_orderpriority").alias("title"))
    made = store(spark, rows, ["doc_id"])
    change = rows.where("doc_id % 3 = 0").select("doc_id", F.lit("completed").alias("status"))
    records.patch(made, change.unionByName(change.limit(5).withColumn("doc_id", -F.col("doc_id") - 1)))
    made.delete(rows.where("doc_id % 7 = 0").select("doc_id"))
    return made.read()


@query("SELECT o_custkey % 20 AS repo_id, o_orderkey AS file, CASE WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 'no ' || o_orderkey END AS error FROM orders WHERE o_custkey % 20 <> 3")
def w23_marked_files(spark, sf_dir):
    """Files are marked as failed, then most as completed; one repository is cleared."""
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("repo_id"), F.col("o_orderkey").alias("file"))
    made = Store.create(spark, fresh_path(spark), "repo_id bigint, file bigint, status string, error string", ["repo_id", "file"], buckets=16)
    records.mark_files(made, rows, "failed", F.concat(F.lit("no "), F.col("file").cast("string")))
    records.mark_files(made, rows.where("file % 5 <> 0"), "completed")
    made.delete_where(F.col("repo_id") == 3)
    return made.read()


PROGRESS = "p AS (SELECT o_custkey AS repo_id, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders GROUP BY 1)"


def progress(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("repo_id")).agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("done"))


@query(f"WITH {PROGRESS} SELECT repo_id, total, CASE WHEN repo_id % 2 = 0 THEN done ELSE 0 END AS done FROM p WHERE repo_id % 4 <> 1")
def w24_embedding_progress(spark, sf_dir):
    """One row for each repository: begun at nothing, changed in part, cleared."""
    rows = progress(spark, sf_dir)
    made = store(spark, rows.withColumn("done", F.lit(0).cast("long")), ["repo_id"])
    records.patch(made, rows.where("repo_id % 2 = 0").select("repo_id", "done"))
    made.delete(rows.where("repo_id % 4 = 1").select("repo_id"))
    return made.read()


@query(f"WITH {PROGRESS} SELECT repo_id, 'indexing' AS phase, total, done, round(100.0 * done / total, 4) AS percent FROM p WHERE repo_id % 6 = 0")
def w25_indexing_progress(spark, sf_dir):
    """Saved whole, saved again, read for some."""
    rows = progress(spark, sf_dir).withColumns({"phase": F.lit("indexing"), "percent": F.round(100.0 * F.col("done") / F.col("total"), 4)})
    made = store(spark, rows.withColumn("phase", F.lit("scanning")), ["repo_id"])
    made.upsert(rows)
    return made.read().where("repo_id % 6 = 0").select("repo_id", "phase", "total", "done", "percent")


@query("SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN 'dark' ELSE 'light' END AS theme, c_nationkey AS page_size FROM customer WHERE c_custkey % 9 <> 4")
def w26_preferences(spark, sf_dir):
    """Preferences are JSON by user: saved, saved again, deleted, loaded."""
    users = table(spark, sf_dir, "customer")

    def said(theme):
        return users.select(F.col("c_custkey").alias("user_id"), F.to_json(F.struct(F.lit(theme).alias("theme"), F.col("c_nationkey").alias("page_size"))).alias("settings"))

    made = store(spark, said("light"), ["user_id"])
    made.upsert(said("dark").where("user_id % 2 = 0"))
    made.delete_where(F.col("user_id") % 9 == 4)
    found = F.from_json("settings", "theme string, page_size bigint")
    return made.read().select("user_id", found.alias("s")).select("user_id", "s.theme", F.col("s.page_size").cast(users.schema["c_nationkey"].dataType).alias("page_size"))


@query("SELECT o_orderkey AS session_id, o_orderdate AS updated_at, CASE WHEN o_orderkey % 4 = 0 THEN 'done' ELSE 'open' END AS status FROM orders WHERE o_orderkey % 8 <> 1 ORDER BY updated_at DESC, session_id LIMIT 25 OFFSET 50")
def w27_sessions(spark, sf_dir):
    """Sessions are made, change, are deleted, and are listed by page, the newest first."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("updated_at"), F.lit("open").alias("status"))
    made = store(spark, rows, ["session_id"])
    records.patch(made, rows.where("session_id % 4 = 0").select("session_id", F.lit("done").alias("status")))
    made.delete(rows.where("session_id % 8 = 1").select("session_id"))
    return records.page(made.read(), [F.desc("updated_at"), F.col("session_id")], 2, 25)


@query("SELECT id FROM g_symbols WHERE kind = 'promo' AND starts_with(file_path, 'Brand#1')")
def f8_classes(spark, sf_dir):
    """F8: classes below a folder; promo stands for class."""
    nodes = derived.symbols(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == "promo", "class").otherwise(F.col("kind")))
    return records.classes(nodes, "Brand#1").select("id")


@query("WITH n AS (SELECT id, split_part(file_path, '/', 1) AS repo_id, file_path FROM g_symbols) SELECT n.repo_id, count(DISTINCT n.file_path) AS files, count(DISTINCT n.id) AS symbols, coalesce((SELECT count(*) FROM g_edges e JOIN n m ON m.id = e.src WHERE m.repo_id = n.repo_id), 0) AS relations FROM n GROUP BY n.repo_id")
def a5_repository_statistics(spark, sf_dir):
    """A5: files, symbols and relations of each repository."""
    nodes = derived.symbols(spark, sf_dir).select("id", F.split("file_path", "/")[0].alias("repo_id"), "file_path")
    return records.repository_statistics(nodes, derived.edges(spark, sf_dir))


@query("WITH f AS (SELECT event_id % 4 AS retry_count, CASE WHEN event_id % 6 > 0 THEN event_type || event_id % 11 END AS error FROM events), e AS (SELECT error, count(*) AS n FROM f WHERE error IS NOT NULL GROUP BY error ORDER BY n DESC, error LIMIT 5) SELECT 'retries' AS what, CAST(retry_count AS VARCHAR) AS value, count(*) AS n FROM f GROUP BY retry_count UNION ALL SELECT 'error', error, n FROM e")
def a11_failure_statistics(spark, sf_dir):
    """Failures by retries, and the most frequent messages."""
    n = F.col("event_id")
    failed = table(spark, sf_dir, "events").select((n % 4).alias("retry_count"), F.when(n % 6 > 0, F.concat("event_type", (n % 11).cast("string"))).alias("error"))
    return records.failure_statistics(failed)


@query(r"WITH s AS (SELECT p_partkey AS id, 'see GET /v1/' || p_size || ' and POST /v' || p_partkey || '. Or ' || ['PUT', 'put', 'DELETE'][p_partkey % 3 + 1] || '  /x/' || p_size % 4 AS t FROM part), z AS (SELECT id, unnest(list_distinct(list_transform(list_zip(regexp_extract_all(t, '\b(GET|POST|PUT|PATCH|DELETE)\s+(/[-A-Za-z0-9_/{}:.]*)', 1), regexp_extract_all(t, '\b(GET|POST|PUT|PATCH|DELETE)\s+(/[-A-Za-z0-9_/{}:.]*)', 2)), lambda x: x[1] || ' ' || x[2]))) AS endpoint FROM s) SELECT endpoint, count(DISTINCT id) AS sections FROM z GROUP BY endpoint HAVING count(DISTINCT id) > 1")
def a20_endpoints_of_sections(spark, sf_dir):
    """Methods with paths that several sections tell of."""
    n, size = F.col("p_partkey"), F.col("p_size")
    method = F.get(F.array(*map(F.lit, ("PUT", "put", "DELETE"))), (n % 3).cast("int"))
    text = F.concat(F.lit("see GET /v1/"), size.cast("string"), F.lit(" and POST /v"), n.cast("string"), F.lit(". Or "), method, F.lit("  /x/"), (size % 4).cast("string"))
    return records.duplicate_endpoints(table(spark, sf_dir, "part").select(n.alias("id"), text.alias("text")), "id", "text")


@query("SELECT p_partkey AS task, lower(p_type) AS agent_type, 'agent of ' || lower(p_type) AS agent FROM part WHERE p_size > 40 AND p_type = 'PROMO' AND p_partkey NOT IN (SELECT e.src FROM g_calls_dag e JOIN part d ON d.p_partkey = e.dst WHERE d.p_size > 40)")
def d7_dispatched_tasks(spark, sf_dir):
    """Ready tasks go to the agent of their type; types without one are passed over."""
    from .state_queries import needs, tasks

    kinds = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("task"), F.lower("p_type").alias("agent_type"))
    ready = dag.ready(tasks(spark, sf_dir), needs(spark, sf_dir)).select("task").join(kinds, "task")
    agents = kinds.where("agent_type = 'promo'").select("agent_type", F.concat(F.lit("agent of "), "agent_type").alias("agent"))
    return records.dispatched(ready, agents)


@query("SELECT o_orderkey AS id, o_orderkey % 13 AS done, o_orderkey % 13 > 0 AND (o_orderkey % 13 % 5 = 0 OR o_orderkey % 13 >= 11) AS now FROM orders")
def d12_aggregate_trigger(spark, sf_dir):
    """Sections are put together after each five, and after the last."""
    done = F.col("o_orderkey") % 13
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), done.alias("done"), records.aggregates_now(done, F.lit(11), 5).alias("now"))


@query("SELECT event_id, coalesce(value, 0) >= 70 OR event_id % 5 >= 3 AS passes FROM events")
def d14_confidence_gate(spark, sf_dir):
    """Good enough, or tried often enough."""
    return table(spark, sf_dir, "events").select("event_id", records.passes_gate(F.col("value") / 100, F.col("event_id") % 5).alias("passes"))


@query("WITH s AS (SELECT source, doc_id, left(text, 900) AS content, CASE WHEN doc_id % 40 = 0 THEN 9000 ELSE floor(length(left(text, 900)) / 4) END AS tokens FROM documents WHERE doc_id % 4 = 0), r AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS running FROM s) SELECT source, sha256(coalesce(string_agg(content, chr(10) || chr(10) ORDER BY doc_id) FILTER (running <= 1500), substring(arg_min(content, doc_id), 1, 100))) AS digest FROM r GROUP BY source")
def r14_upstream_context(spark, sf_dir):
    """Sections while they fit; else the beginning of the first."""
    content = F.substring("text", 1, 900)
    tokens = F.when(F.col("doc_id") % 40 == 0, F.lit(9000)).otherwise(F.floor(F.length(content) / 4)).cast("long")
    sections = table(spark, sf_dir, "documents").where("doc_id % 4 = 0").select("source", "doc_id", content.alias("content"), tokens.alias("tokens"))
    return records.upstream_context(sections, "source", ["doc_id"], 1500, 100).select("source", F.sha2("text", 256).alias("digest"))


@query("WITH i AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, lang, CASE WHEN doc_id % 3 > 0 THEN 's' || doc_id END AS symbol, left(text, 40) AS content FROM documents) SELECT source, sha256(string_agg('### ' || n || '. ' || lang || ' (lines ' || doc_id || '-' || doc_id + 2 || ')' || coalesce(chr(10) || 'Symbol: ' || symbol, '') || chr(10) || '```' || chr(10) || content || chr(10) || '```', chr(10) || chr(10) ORDER BY n)) AS digest FROM i GROUP BY source")
def c17_rendered_context(spark, sf_dir):
    """C17: items as numbered Markdown."""
    n = F.col("doc_id")
    items = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("lang").alias("file_path"), n.alias("start_line"), (n + 2).alias("end_line"), F.when(n % 3 > 0, F.concat(F.lit("s"), n.cast("string"))).alias("symbol"), F.substring("text", 1, 40).alias("content"))
    return records.rendered(items, "source", ["doc_id"]).select("source", F.sha2("text", 256).alias("digest"))


@query("SELECT c.chunk_id, s.name AS symbol, 0 AS related FROM (SELECT c.*, list_inner_product(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_inner_product(CAST(c.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))) AS score FROM g_chunks c JOIN embeddings q ON q.vec_id = 0 WHERE language <> 'en' ORDER BY score DESC, chunk_id LIMIT 15) c LEFT JOIN g_symbols s ON s.id = c.chunk_id")
def j5_without_related(spark, sf_dir):
    """The nearest code with its symbol, and nothing of what that is related to."""
    asked = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding")
    path = F.when(F.col("language") == "en", "a.md").otherwise("a.py")
    found = retrieval.unified(derived.chunks(spark, sf_dir).withColumn("file_path", path), asked, derived.symbols(spark, sf_dir), derived.edges(spark, sf_dir), 15, least_score=-1.0, related=False, documentation=False)
    return found.select("chunk_id", "symbol", F.size("related").alias("related"))


@query("SELECT doc_id, n_chars FROM documents WHERE source = 'src2' AND lang IN ('de', 'fr')")
def s16_metadata_scan(spark, sf_dir):
    """Documents by their attributes."""
    return records.matching(table(spark, sf_dir, "documents"), source="src2", lang=["de", "fr"]).select("doc_id", "n_chars")
