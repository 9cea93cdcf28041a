"""Upserts, deletions, snapshots, dependency graphs, and batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import dag, graph, records, resolve, state
from weftgraph.sources import derived
from weftgraph.sources.tables import table

from .registry import query


def nodes(spark, sf_dir):
    return derived.symbols(spark, sf_dir).select("id", "name", "kind")


@query("SELECT id, CASE WHEN kind = 'promo' THEN 'new ' || name ELSE name END AS name, kind FROM g_symbols UNION ALL SELECT -1 - id, name, 'added' FROM g_symbols WHERE kind = 'small'")
def w1_upsert_nodes(spark, sf_dir):
    """New rows replace old ones by key."""
    old = nodes(spark, sf_dir)
    new = old.where("kind = 'promo'").withColumn("name", F.concat(F.lit("new "), "name")).unionByName(old.where("kind = 'small'").select((F.lit(-1) - F.col("id")).alias("id"), "name", F.lit("added").alias("kind")))
    return state.upserted(old, new, ["id"])


@query("SELECT DISTINCT l_orderkey % (SELECT count(*) + 100 FROM part) AS src, l_partkey AS dst FROM lineitem WHERE l_orderkey % (SELECT count(*) + 100 FROM part) IN (SELECT id FROM g_symbols) AND l_partkey IN (SELECT id FROM g_symbols WHERE kind = 'promo')")
def w3_create_edges(spark, sf_dir):
    """Edges whose two ends exist, once each."""
    parts = table(spark, sf_dir, "part").agg((F.count(F.lit(1)) + 100).alias("parts"))
    wanted = table(spark, sf_dir, "lineitem").join(F.broadcast(parts)).select((F.col("l_orderkey") % F.col("parts")).alias("src"), F.col("l_partkey").alias("dst"))
    ids = nodes(spark, sf_dir)
    return wanted.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.where("kind = 'promo'").select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()


@query("SELECT src, dst FROM (SELECT doc_id AS src, lead(doc_id) OVER (PARTITION BY source, doc_id // 100 ORDER BY doc_id) AS dst FROM documents) WHERE dst IS NOT NULL")
def w7_next_chunk_edges(spark, sf_dir):
    """Neighbours within a file; a hundred consecutive ids of a source stand for one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", F.floor(F.col("doc_id") / 100).cast("string")).alias("file"))
    return graph.next_in_order(docs, "file", ["doc_id"], "doc_id")


@query("WITH d AS (SELECT 'chunk' AS label, count(*) AS n FROM g_chunks WHERE repo_id = 'src1' UNION ALL SELECT 'document', count(*) FROM documents WHERE source = 'src1') SELECT * FROM d WHERE n > 0 UNION ALL SELECT 'total', CAST(sum(n) AS BIGINT) FROM d")
def w8_delete_counts(spark, sf_dir):
    """What deleting a repository would take away."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("repo_id"))
    return state.deleted_counts({"chunk": derived.chunks(spark, sf_dir).select("repo_id"), "document": docs}, F.col("repo_id") == "src1")


@query("SELECT id, name, kind FROM g_symbols WHERE kind <> 'promo'")
def w10_delete_nodes(spark, sf_dir):
    """What is left after a deletion."""
    all_nodes = nodes(spark, sf_dir)
    return state.without(all_nodes, all_nodes.where("kind = 'promo'"), ["id"])


@query("SELECT src, dst FROM g_calls WHERE src NOT IN (SELECT id FROM g_symbols WHERE kind = 'promo') AND dst NOT IN (SELECT id FROM g_symbols WHERE kind = 'promo')")
def w10_delete_incident_edges(spark, sf_dir):
    victims = nodes(spark, sf_dir).where("kind = 'promo'")
    left = state.without(derived.calls(spark, sf_dir), victims.select(F.col("id").alias("src")), ["src"])
    return state.without(left, victims.select(F.col("id").alias("dst")), ["dst"])


@query("SELECT user_id, count(*) AS retries, max(event_type) AS error FROM events WHERE event_type IN ('error', 'click') GROUP BY user_id")
def w14_failed_retries(spark, sf_dir):
    """Failure counts grow with each failure."""
    events = table(spark, sf_dir, "events")
    old = events.where("event_type = 'click'").groupBy("user_id").agg(F.count(F.lit(1)).alias("retries"), F.lit("click").alias("error"))
    return state.retried(old, events.where("event_type = 'error'").select("user_id", F.col("event_type").alias("error")), "user_id")


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text)")
def i3_w13_w17_first_of_hash(spark, sf_dir):
    """By content hash the first row stays."""
    return records.first_of_hash(table(spark, sf_dir, "documents"), "text", "doc_id")


@query("SELECT l_orderkey AS a, l_linenumber AS b, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def w18_unique_violations(spark, sf_dir):
    return state.duplicates(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b")), ["a", "b"])


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS other FROM events")
def w19_promote_fields(spark, sf_dir):
    """JSON fields become columns."""
    return state.promoted(table(spark, sf_dir, "events").select("event_id", "props"), "props", ["k", "other"]).drop("props")


@query("WITH a AS (SELECT source || lang AS k, max(doc_id) AS v FROM documents WHERE n_chars < 4000 GROUP BY 1), b AS (SELECT source || lang AS k, max(doc_id) AS v FROM documents WHERE n_chars > 1000 GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def i6_snapshot_diff(spark, sf_dir):
    """Two snapshots compared by key and digest."""
    docs = table(spark, sf_dir, "documents").select(F.concat("source", "lang").alias("k"), "doc_id", "n_chars")
    before, after = (docs.where(c).groupBy("k").agg(F.max("doc_id").alias("digest")) for c in ("n_chars < 4000", "n_chars > 1000"))
    return state.snapshot_diff(before, after, "k", "digest")


@query("SELECT user_id, CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS n_purchase, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS n_error FROM events GROUP BY user_id")
def i7_merged_maps(spark, sf_dir):
    """Two maps merged, the second wins."""
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.when(F.col("event_type") == "purchase", 1)).alias("p"), F.count(F.when(F.col("event_type") == "error", 1)).alias("e"))
    m = state.merged_maps(F.create_map(F.lit("p"), F.lit(0).cast("long"), F.lit("e"), F.col("e")), F.create_map(F.lit("p"), F.col("p")))
    return counts.select("user_id", m["p"].alias("n_purchase"), m["e"].alias("n_error"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events), k AS (SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id), l AS (SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY n DESC) AS logged FROM r WHERE n <= 50 GROUP BY user_id) SELECT user_id, kinds, logged FROM k JOIN l USING (user_id)")
def i8_i10_logs(spark, sf_dir):
    """Appended without repeats; a log of the last fifty."""
    events = table(spark, sf_dir, "events")
    kinds = events.groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("kinds"))
    last = state.last_of(events, "user_id", [F.desc("ts"), F.desc("event_id")], 50)
    log = last.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"]).alias("log"))
    none = F.array().cast("array<bigint>")
    return kinds.join(log, "user_id").select("user_id", F.array_join(state.appended_unique(F.array().cast("array<string>"), F.col("kinds")), ",").alias("kinds"), F.array_join(state.capped_log(none, F.col("log"), 50), ",").alias("logged"))


@query("SELECT id FROM g_symbols EXCEPT SELECT src FROM g_calls")
def i5_set_difference(spark, sf_dir):
    return nodes(spark, sf_dir).select("id").exceptAll(derived.calls(spark, sf_dir).select(F.col("src").alias("id")).distinct())


@query("SELECT user_id, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'error') AS error, round(sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END), 4) AS amount FROM events GROUP BY user_id")
def a9_checkpoint_counts(spark, sf_dir):
    """Rows by state and sums of the finished ones."""
    out = state.checkpoint_counts(table(spark, sf_dir, "events"), "user_id", "event_type", ["signup", "view", "error"], "value", "view")
    return out.withColumn("amount", F.round("amount", 4))


@query("SELECT source, round(coalesce(avg(quality), 0.5), 3) AS confidence FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def a13_average_confidence(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return records.average_confidence(rows, "source", "quality")


@query("SELECT lang, count(DISTINCT source) AS n, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents WHERE length(text) > 5000 GROUP BY lang HAVING count(DISTINCT source) >= 2")
def a14_cross_cutting(spark, sf_dir):
    """Categories found in at least two repositories."""
    rows = table(spark, sf_dir, "documents").where(F.length("text") > 5000)
    return records.cross_cutting(rows, "lang", "source")


@query("SELECT edge_type, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets, count(*) AS edges FROM g_edges GROUP BY edge_type")
def a16_a17_edge_groups(spark, sf_dir):
    return records.edge_groups(derived.edges(spark, sf_dir))


@query("SELECT DISTINCT l_partkey + 500 AS id FROM lineitem WHERE l_partkey + 500 NOT IN (SELECT p_partkey FROM part)")
def a21_undefined_references(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") + 500).alias("id")).distinct()
    return records.undefined_references(refs, nodes(spark, sf_dir))


@query("SELECT source, lang, min(doc_id) AS first FROM (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source ORDER BY lang, doc_id) AS n FROM documents) WHERE n <= 3 GROUP BY source, lang")
def i13_first_of_each(spark, sf_dir):
    """The first three of each repository."""
    rows = records.first_of_each(table(spark, sf_dir, "documents").select("source", "lang", "doc_id"), "source", ["lang", "doc_id"], 3)
    return rows.groupBy("source", "lang").agg(F.min("doc_id").alias("first"))


@query("WITH d AS (SELECT DISTINCT source, lang, doc_id // 20 AS n FROM documents), r AS (SELECT source, lang, n, n - row_number() OVER (PARTITION BY source || '/' || lang ORDER BY n) AS run FROM d) SELECT source || '/' || lang AS k, min(n) AS first, max(n) AS last FROM r GROUP BY source, lang, run")
def n6_islands(spark, sf_dir):
    """Runs of consecutive numbers."""
    rows = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("k"), F.floor(F.col("doc_id") / 20).alias("n"))
    return state.islands(rows, "k", "n")


@query("SELECT name || '@' || split_part(file_path, '/', 1) || kind AS name, min(id) AS target FROM g_symbols GROUP BY 1 HAVING count(*) = 1")
def p7_unique_names(spark, sf_dir):
    """Names resolve if exactly one symbol has them; here those of a brand and kind."""
    name = F.concat("name", F.lit("@"), F.split("file_path", "/")[0], "kind")
    return resolve.unique_names(derived.symbols(spark, sf_dir).withColumn("name", name))


@query("WITH f AS (SELECT file_path, split_part(file_path, '/', 1) AS a, split_part(file_path, '/', 2) AS b, split_part(split_part(file_path, '/', 3), '.', 1) AS c FROM g_files), i AS (SELECT file_path AS importer, '.' || c AS module, a || '/' || b || '/' || c || '.py' AS target FROM f UNION ALL SELECT file_path, '..PROMO.' || c, a || '/PROMO/' || c || '.py' FROM f UNION ALL SELECT file_path, a || '.SMALL.' || c, a || '/SMALL/' || c || '.py' FROM f) SELECT importer, module, CASE WHEN t.file_path IS NOT NULL THEN i.target END AS target, t.file_path IS NULL AS is_external FROM i LEFT JOIN g_files t ON t.file_path = i.target")
def p8_p10_resolve_modules(spark, sf_dir):
    """Relative and absolute modules to files; others are external."""
    files = derived.files(spark, sf_dir)
    parts = F.split("file_path", "/")
    stem = F.split(parts[2], r"\.")[0]
    modules = F.array(F.concat(F.lit("."), stem), F.concat(F.lit("..PROMO."), stem), F.concat(parts[0], F.lit(".SMALL."), stem))
    wanted = files.select(F.col("file_path").alias("importer"), F.explode(modules).alias("module"), F.lit("python").alias("language"))
    return resolve.resolve_modules(wanted, files).select("importer", "module", "target", "is_external")


@query("WITH r AS (SELECT s.id AS src, s.name AS target_name, CASE WHEN s.kind = 'promo' THEN s.file_path WHEN s.kind = 'small' THEN 'nowhere.py' END AS target_file FROM g_symbols s), f AS (SELECT file_path, name FROM g_symbols GROUP BY file_path, name HAVING count(DISTINCT id) = 1), u AS (SELECT name FROM g_symbols GROUP BY name HAVING count(*) = 1) SELECT CASE WHEN f.name IS NOT NULL OR u.name IS NOT NULL THEN 'created' WHEN target_file IS NULL THEN 'external' ELSE 'unresolved' END AS outcome, count(*) AS n FROM r LEFT JOIN f ON f.file_path = r.target_file AND f.name = r.target_name LEFT JOIN u ON u.name = r.target_name GROUP BY 1")
def p11_a22_resolution_outcomes(spark, sf_dir):
    """References by outcome."""
    symbols = derived.symbols(spark, sf_dir)
    file = F.when(F.col("kind") == "promo", F.col("file_path")).when(F.col("kind") == "small", "nowhere.py")
    refs = symbols.select(F.col("id").alias("src"), F.lit(None).cast("long").alias("target_id"), F.col("name").alias("target_name"), file.alias("target_file"))
    return resolve.resolve_targets(refs, symbols).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def tasks(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("task"), (F.col("p_size") <= 40).alias("finished"))


def needs(spark, sf_dir):
    return derived.calls_dag(spark, sf_dir).select(F.col("src").alias("task"), F.col("dst").alias("dep"))


@query("WITH RECURSIVE r AS (SELECT id AS task, 0 AS level FROM g_symbols WHERE id NOT IN (SELECT src FROM g_calls_dag) UNION SELECT e.src, r.level + 1 FROM r JOIN g_calls_dag e ON e.dst = r.task) SELECT task, CAST(max(level) AS INTEGER) AS level FROM r GROUP BY task")
def d2_topological_levels(spark, sf_dir):
    return dag.levels(tasks(spark, sf_dir), needs(spark, sf_dir))[0]


@query("WITH RECURSIVE p AS (SELECT src, dst FROM g_calls UNION SELECT p.src, e.dst FROM p JOIN g_calls e ON e.src = p.dst), c AS (SELECT DISTINCT src FROM p WHERE src = dst), k AS (SELECT DISTINCT src AS task FROM p WHERE dst IN (SELECT src FROM c)) SELECT count(*) > 0 AS cyclic, (SELECT count(*) FROM g_calls WHERE src IN (SELECT task FROM k) AND dst IN (SELECT task FROM k)) AS edges_left FROM c")
def d1_cycle_check(spark, sf_dir):
    """What peeling leaves is on a cycle or leads to one."""
    left = dag.levels(tasks(spark, sf_dir), derived.calls(spark, sf_dir).select(F.col("src").alias("task"), F.col("dst").alias("dep")))[1]
    return left.agg((F.count(F.lit(1)) > 0).alias("cyclic"), F.count(F.lit(1)).alias("edges_left"))


@query("WITH e AS (SELECT src, dst + 100 AS dst FROM g_calls_dag) SELECT 'missing' AS problem, dst AS task FROM (SELECT DISTINCT dst FROM e) WHERE dst NOT IN (SELECT id FROM g_symbols) UNION ALL SELECT 'orphan', id FROM g_symbols WHERE id NOT IN (SELECT src FROM e UNION SELECT dst FROM e)")
def d3_dag_problems(spark, sf_dir):
    return dag.problems(tasks(spark, sf_dir), needs(spark, sf_dir).select("task", (F.col("dep") + 100).alias("dep")))


@query("SELECT p_partkey AS task FROM part WHERE p_size > 40 AND p_partkey NOT IN (SELECT e.src FROM g_calls_dag e JOIN part d ON d.p_partkey = e.dst WHERE d.p_size > 40)")
def d4_ready_tasks(spark, sf_dir):
    """Unfinished tasks with all needs finished."""
    return dag.ready(tasks(spark, sf_dir), needs(spark, sf_dir)).select("task")


@query("SELECT count(*) AS tasks, count(*) FILTER (p_size <= 40) AS finished, count(*) FILTER (p_size > 40 AND p_partkey NOT IN (SELECT e.src FROM g_calls_dag e JOIN part d ON d.p_partkey = e.dst WHERE d.p_size > 40)) AS ready, 'running' AS state FROM part")
def d5_progress_state(spark, sf_dir):
    return dag.progress_state(tasks(spark, sf_dir), needs(spark, sf_dir))


@query("WITH s AS (SELECT src, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS deps FROM g_calls_dag GROUP BY src) SELECT deps, n, src AS task FROM (SELECT *, count(*) OVER (PARTITION BY deps) AS n FROM s) WHERE n > 1")
def d8_a15_parallel_groups(spark, sf_dir):
    return dag.parallel_groups(needs(spark, sf_dir))


@query("SELECT conv_id, sha256(CAST(conv_id AS VARCHAR) || ':' || string_agg(DISTINCT sha256(text), ',' ORDER BY sha256(text))) AS print FROM conversations GROUP BY conv_id")
def d9_fingerprints(spark, sf_dir):
    """A conversation stands for a phase, its texts for the few artifacts of it."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set(F.sha2("text", 256)).alias("hashes"))
    return rows.select("conv_id", dag.fingerprint(F.col("conv_id").cast("string"), F.col("hashes")).alias("print"))


@query("WITH p AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS priority FROM orders), c AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'F') SELECT DISTINCT p.k || '/' || p.priority AS phase FROM p JOIN c ON c.k = p.k AND c.priority < p.priority")
def d10_dirty_phases(spark, sf_dir):
    """A customer's later priorities are dirty once an earlier one has changed."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("priority"), "o_orderstatus")
    phase = F.concat_ws("/", F.col("k").cast("string"), "priority")
    rows = orders.select("k", "priority", phase.alias("phase")).distinct()
    after = rows.select("k", F.col("priority").alias("later_priority"), F.col("phase").alias("later"))
    cascade = rows.join(after, "k").where("priority < later_priority").select("phase", "later")
    return dag.dirty(rows.select("phase"), cascade, orders.where("o_orderstatus = 'F'").select(phase.alias("phase")).distinct())


@query("SELECT o_custkey, o_orderkey, 20 - row_number() OVER w >= 0 AND 2000000 - CAST(floor(sum(floor(o_totalprice)) OVER w) AS BIGINT) >= 0 AS allowed FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)")
def d11_budgets(spark, sf_dir):
    calls = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").alias("tokens"))
    return dag.within_budget(calls, "o_custkey", "o_orderkey", 20, 2_000_000).select("o_custkey", "o_orderkey", "allowed")


@query("SELECT o_orderstatus AS phase, count(*) AS stories, CAST(sum(o_custkey) AS BIGINT) AS points, count(*) FILTER (o_orderpriority = '1-URGENT') AS must FROM orders GROUP BY o_orderstatus")
def d15_story_totals(spark, sf_dir):
    """Totals by phase."""
    stories = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("phase"), F.col("o_custkey").alias("points"), F.col("o_orderpriority").alias("priority"))
    return records.story_totals(stories, "1-URGENT")


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events")
def m6_n7_sequences(spark, sf_dir):
    """Each workflow's events, numbered."""
    numbered = state.running_total(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"], F.lit(1).cast("long"), "sequence")
    return numbered.select("event_id", "user_id", "sequence")


@query("SELECT user_id, round(least(100.0, 100.0 * count(DISTINCT event_type) / 5), 4) AS percent FROM events GROUP BY user_id")
def m5_workflow_progress(spark, sf_dir):
    from weftgraph.streaming import progress

    return progress.workflow_percent(table(spark, sf_dir, "events"), "user_id", "event_type", 5).withColumn("percent", F.round("percent", 4))


@query("SELECT event_type, CAST(CASE event_type WHEN 'signup' THEN 12.5 WHEN 'view' THEN 25.0 WHEN 'click' THEN 37.5 WHEN 'purchase' THEN 50.0 ELSE 0.0 END AS DOUBLE) AS percent, count(*) AS n FROM events GROUP BY 1, 2")
def m7_step_percent(spark, sf_dir):
    from weftgraph.streaming import progress

    steps = {"signup": "initializing", "view": "question_analyzed", "click": "embedding_generation", "purchase": "vector_search"}
    step = F.create_map(*(F.lit(x) for kv in steps.items() for x in kv))[F.col("event_type")]
    return table(spark, sf_dir, "events").groupBy("event_type", progress.step_percent(step).alias("percent")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id FROM events WHERE event_type <> '' AND props <> '' AND (value = -1 OR value BETWEEN 0 AND 100)")
def m1_valid_events(spark, sf_dir):
    from weftgraph.streaming import progress

    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("phase"), F.col("props").alias("message"), F.col("value").alias("percent"))
    return progress.valid(rows).select("event_id")
