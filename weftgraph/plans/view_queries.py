"""Graph views, diagrams, packets, pages of results, and progress formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import scalars
from weftgraph.operators import analysis, graph, records, state, views
from weftgraph.sources import derived
from weftgraph.sources.tables import table
from weftgraph.streaming import progress

from .graph_queries import BFS, starts
from .registry import query


def typed(spark, sf_dir):
    """id (text), label, node_type, and edges by those ids, of files and symbols."""
    symbols = derived.symbols(spark, sf_dir)
    nodes = symbols.select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"), F.col("name").alias("label"), F.lit("function").alias("node_type"))
    nodes = nodes.unionByName(derived.files(spark, sf_dir).select(F.concat(F.lit("f:"), "file_path").alias("id"), F.col("file_path").alias("label"), F.lit("file").alias("node_type")))
    edges = derived.edges(spark, sf_dir).select(F.concat(F.lit("s"), F.col("src").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("dst").cast("string")).alias("dst"), "edge_type")
    held = symbols.select(F.concat(F.lit("f:"), "file_path").alias("src"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("dst"), F.lit("CONTAINS").alias("edge_type"))
    return nodes, edges.unionByName(held)


TYPED = "n AS (SELECT 's' || id AS id, name AS label, 'function' AS node_type FROM g_symbols UNION ALL SELECT 'f:' || file_path, file_path, 'file' FROM g_files), e AS (SELECT 's' || src AS src, 's' || dst AS dst, edge_type FROM g_edges UNION ALL SELECT 'f:' || file_path, 's' || id, 'CONTAINS' FROM g_symbols)"


@query("SELECT doc_id, lang FROM documents WHERE source = 'src1' ORDER BY doc_id")
def f3_chunks_of_file(spark, sf_dir):
    """Chunks of one file in order."""
    return records.chunks_of_file(table(spark, sf_dir, "documents"), F.col("source"), "src1", ["doc_id"]).select("doc_id", "lang")


@query("SELECT c.chunk_id FROM g_chunks c LEFT JOIN g_symbols s ON s.id = c.chunk_id WHERE s.name = 'red plate' OR c.chunk_id IN (SELECT e.src FROM g_calls e JOIN g_symbols t ON t.id = e.dst WHERE t.name = 'red plate')")
def f4_chunks_of_symbol(spark, sf_dir):
    """chunks that define or reference a symbol, from two name arrays."""
    symbols, calls = derived.symbols(spark, sf_dir).select("id", "name"), derived.calls(spark, sf_dir)
    referenced = calls.join(symbols.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("chunk_id")).agg(F.collect_set("name").alias("referenced"))
    defined = symbols.select(F.col("id").alias("chunk_id"), F.array("name").alias("defined"))
    rows = derived.chunks(spark, sf_dir).select("chunk_id").join(defined, "chunk_id", "left").join(referenced, "chunk_id", "left")
    return rows.where(F.coalesce(F.array_contains("defined", "red plate"), F.lit(False)) | F.coalesce(F.array_contains("referenced", "red plate"), F.lit(False))).select("chunk_id")


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS snippet FROM documents WHERE len(string_split(text, chr(10))) >= 2")
def f18_snippets(spark, sf_dir):
    """lines 2 to 4, clamped to the file."""
    lines = F.split("text", "\n")
    rows = table(spark, sf_dir, "documents").where(F.size(lines) >= 2)
    return rows.select("doc_id", records.lines_between(F.col("text"), 2, 4).alias("snippet"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def f21_f22_pages_of_rows(spark, sf_dir):
    """Optional filters, order, and one page."""
    rows = records.matching(table(spark, sf_dir, "orders"), o_orderstatus="F", o_orderpriority=["1-URGENT"])
    return records.page(rows, [F.desc("o_orderdate"), F.col("o_orderkey")], 2, 25).select("o_orderkey", "o_orderdate")


@query("SELECT doc_id FROM documents WHERE (lang = 'en' AND source <> 'src0') OR (lang = 'de' AND n_chars > 4000)")
def f23_f27_combined_filters(spark, sf_dir):
    """combinations of equality and presence."""
    lang = F.col("lang")
    return table(spark, sf_dir, "documents").where(((lang == "en") & (F.col("source") != "src0")) | ((lang == "de") & (F.col("n_chars") > 4000))).select("doc_id")


@query("SELECT file_path, name, min(id) AS target, count(*) AS n FROM g_symbols GROUP BY file_path, name")
def j16_symbol_chunk_links(spark, sf_dir):
    """By file and name the first symbol."""
    return records.symbol_links(derived.symbols(spark, sf_dir))


@query("WITH u AS (SELECT src, dst FROM g_calls UNION SELECT dst, src FROM g_calls), s AS (SELECT min(id) AS id FROM g_symbols WHERE name = 'red plate') SELECT u.dst AS target, CAST(p.place AS INTEGER) AS place, n.name FROM u JOIN s ON s.id = u.src, LATERAL (SELECT unnest([0, 1]) AS place, unnest([u.src, u.dst]) AS id) p JOIN g_symbols n ON n.id = p.id")
def j19_path_details(spark, sf_dir):
    """The nodes of each shortest path of one step, in order."""
    start = starts(spark, sf_dir).agg(F.min("id").alias("id"))
    paths = graph.shortest_paths(derived.calls(spark, sf_dir), start, 1).where("length = 1")
    rows = paths.select(F.col("id").alias("target"), F.posexplode("path").alias("place", "node"))
    return rows.join(derived.symbols(spark, sf_dir).select(F.col("id").alias("node"), "name"), "node").select("target", "place", "name")


@query(BFS.format(edges="g_calls", depth=3) + "SELECT e.src, e.dst FROM g_calls e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst")
def t15_g2_call_view(spark, sf_dir):
    """The calls among what an entry reaches."""
    return views.call_view(derived.calls(spark, sf_dir), starts(spark, sf_dir), 3)


@query("WITH RECURSIVE i AS (SELECT dst AS src, src AS dst FROM g_calls)," + BFS.format(edges="i", depth=3)[14:].replace("name = 'red plate'", "starts_with(name, 'red pl')") + "SELECT id, depth FROM n")
def t16_g3_call_chain(spark, sf_dir):
    """Who calls the symbols with a name prefix, over three steps."""
    seeds = derived.symbols(spark, sf_dir).where(F.col("name").startswith("red pl")).select("id")
    return graph.traverse(derived.calls(spark, sf_dir), seeds, 3, "incoming")[0]


@query("SELECT src, dst, edge_type FROM (SELECT *, row_number() OVER (PARTITION BY edge_type ORDER BY src, dst) AS n FROM g_edges) WHERE n <= 2000")
def t18_edges_per_type(spark, sf_dir):
    return records.first_of_each(derived.edges(spark, sf_dir), "edge_type", ["src", "dst"], 2000)


@query("WITH RECURSIVE r AS (SELECT CAST(id AS VARCHAR) AS path, id AS last, 0 AS length FROM g_symbols WHERE name = 'red plate' UNION ALL SELECT r.path || '>' || d.dst, d.dst, r.length + 1 FROM r JOIN g_calls_dag d ON d.src = r.last WHERE r.length < 6) SELECT path, CAST(length AS INTEGER) AS length FROM r WHERE length >= 2 ORDER BY length DESC, path LIMIT 5")
def t20_deep_chains(spark, sf_dir):
    """The five longest chains; walks of the acyclic graph repeat no edge."""
    out = graph.trails(derived.calls_dag(spark, sf_dir), starts(spark, sf_dir), 2, 6)
    return out.select(F.array_join("path", ">").alias("path"), "length").orderBy(F.desc("length"), "path").limit(5)


@query("SELECT rank, edge_type FROM (VALUES (1, 'CONTAINS'), (2, 'CALLS'), (3, 'IMPORTS'), (4, 'IMPLEMENTS'), (5, 'EXTENDS'), (6, 'USES'), (7, 'DECORATES')) t(rank, edge_type) WHERE edge_type = 'CONTAINS' OR edge_type IN (SELECT edge_type FROM g_edges)")
def t21_available_edge_types(spark, sf_dir):
    """The semantic types that are there, in their order; CONTAINS always."""
    order = ("CONTAINS", "CALLS", "IMPORTS", "IMPLEMENTS", "EXTENDS", "USES", "DECORATES")
    known = spark.range(1).select(F.posexplode(F.array(*map(F.lit, order))).alias("rank", "edge_type")).withColumn("rank", F.col("rank") + 1)
    there = derived.edges(spark, sf_dir).select("edge_type").distinct().withColumn("there", F.lit(True))
    return known.join(there, "edge_type", "left").where("there OR edge_type = 'CONTAINS'").select("rank", "edge_type")


@query("WITH d AS (SELECT n.id, count(x.id) AS k FROM g_symbols n LEFT JOIN (SELECT src AS id FROM g_calls UNION ALL SELECT dst FROM g_calls) x ON x.id = n.id GROUP BY n.id), t AS (SELECT id FROM d ORDER BY k DESC, id LIMIT 300) SELECT src, dst FROM g_calls WHERE src IN (SELECT id FROM t) AND dst IN (SELECT id FROM t)")
def r21_collapsed_diagram(spark, sf_dir):
    """The symbols with most calls, and the calls among them."""
    return views.collapsed(derived.symbols(spark, sf_dir), derived.calls(spark, sf_dir), 300)[1]


@query(f"WITH {TYPED} SELECT id, node_type FROM (SELECT *, row_number() OVER (PARTITION BY node_type ORDER BY id) AS k FROM n) WHERE k <= CASE node_type WHEN 'file' THEN 100 ELSE 300 END")
def r22_g6_layer_caps(spark, sf_dir):
    """Each layer up to its limit."""
    return views.capped_layers(typed(spark, sf_dir)[0], {"file": 100, "function": 300}).select("id", "node_type")


@query(f"WITH {TYPED} SELECT '    ' || regexp_replace(id, '[^A-Za-z0-9_]', '_', 'g') || CASE node_type WHEN 'file' THEN '[\"' ELSE '(\"' END || CASE WHEN length(label) > 30 THEN substring(label, 1, 30) || '...' ELSE label END || CASE node_type WHEN 'file' THEN '\"]' ELSE '\")' END AS line FROM n UNION ALL SELECT '    ' || regexp_replace(src, '[^A-Za-z0-9_]', '_', 'g') || CASE edge_type WHEN 'CALLS' THEN ' --> ' WHEN 'EXTENDS' THEN ' ==> ' ELSE ' --- ' END || regexp_replace(dst, '[^A-Za-z0-9_]', '_', 'g') FROM e")
def g9_diagram_lines(spark, sf_dir):
    return views.mermaid_lines(*typed(spark, sf_dir)).select("line")


@query("SELECT node, repeat('  ', CAST(length(node) - length(replace(node, '/', '')) AS BIGINT)) || list_last(string_split(node, '/')) AS line FROM (SELECT file_path AS node FROM g_files UNION SELECT split_part(file_path, '/', 1) FROM g_files UNION SELECT split_part(file_path, '/', 1) || '/' || split_part(file_path, '/', 2) FROM g_files)")
def g12_tree(spark, sf_dir):
    return views.tree_lines(derived.files(spark, sf_dir), "file_path")


@query("WITH r AS (SELECT src AS id, dst AS other, 'Calls' AS relation FROM g_calls UNION ALL SELECT dst, src, 'Called by' FROM g_calls UNION ALL SELECT src, dst, 'Extends' FROM g_extends), k AS (SELECT r.id, r.relation, s.name, row_number() OVER (PARTITION BY r.id, r.relation ORDER BY s.name, r.other) AS n FROM r JOIN g_symbols s ON s.id = r.other), l AS (SELECT id, relation || ': ' || string_agg(name, ', ' ORDER BY n) AS line FROM k WHERE n <= 15 GROUP BY id, relation), b AS (SELECT id, string_agg(line, chr(10) ORDER BY line) AS body FROM l GROUP BY id) SELECT s.id, '## ' || s.name || ' (' || s.kind || ') in ' || s.file_path || chr(10) || coalesce(b.body, '') AS text FROM g_symbols s LEFT JOIN b ON b.id = s.id WHERE s.name = 'red plate'")
def l7_context_packets(spark, sf_dir):
    """A packet for each root."""
    edges = derived.edges(spark, sf_dir)
    return views.context_packets(derived.symbols(spark, sf_dir), edges, starts(spark, sf_dir)).select("id", "text")


@query("SELECT kind, CAST(total AS VARCHAR) || ' ' || kind || ': ' || string_agg(name, ', ' ORDER BY n) AS line FROM (SELECT kind, name, row_number() OVER (PARTITION BY kind ORDER BY name) AS n, count(*) OVER (PARTITION BY kind) AS total FROM (SELECT DISTINCT kind, name FROM g_symbols)) WHERE n <= 5 GROUP BY kind, total")
def l5_narrative(spark, sf_dir):
    return views.narrative(derived.symbols(spark, sf_dir).select("kind", "name").distinct(), "kind", "name")


@query("SELECT source, CASE WHEN count(*) FILTER (length(text) > 6000) >= 5 THEN 'sufficient' WHEN count(*) FILTER (length(text) > 6000) > 0 THEN 'sparse' ELSE 'none' END AS context FROM documents GROUP BY source")
def r23_sufficiency(spark, sf_dir):
    n = F.count(F.when(F.length("text") > 6000, 1))
    return table(spark, sf_dir, "documents").groupBy("source").agg(records.sufficiency(n).alias("context"))


@query("SELECT event_id, '{\"k\":\"' || json_extract_string(props, '$.k') || '\"}' AS json FROM events")
def x3_json_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.to_json(scalars.json_map(F.col("props"))).alias("json"))


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, ts >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 1 HOUR AS fresh, round(greatest(0.0, least(100.0, value)), 4) AS clamped FROM events")
def x14_x15_time_and_clamp(spark, sf_dir):
    """Epoch seconds, expiry after an hour, values within bounds."""
    fresh = F.col("ts") >= F.to_timestamp(F.lit("2024-01-15 00:00:00")) - F.expr("INTERVAL 1 HOUR")
    return table(spark, sf_dir, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("seconds"), fresh.alias("fresh"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("value"))), 4).alias("clamped"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS left_over FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) WHERE n > 10 GROUP BY user_id")
def d13_pruned_maps(spark, sf_dir):
    """Entries of a map that are resolved go."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    keys = F.array_sort(F.map_keys(F.map_filter("m", lambda k, n: n > 10)))
    return maps.select("user_id", F.array_join(keys, ",").alias("left_over")).where("left_over <> ''")


@query("SELECT o_orderstatus AS phase, round(CASE o_orderstatus WHEN 'F' THEN 100.0 * count(*) FILTER (o_totalprice < 100000) / count(*) ELSE 100.0 * count(*) FILTER (o_custkey < 100) / count(*) END, 6) AS percent FROM orders GROUP BY o_orderstatus")
def m8_indexing_percent(spark, sf_dir):
    """M8: which counters count depends on the phase."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("phase")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("o_totalprice") < 100000, 1)).alias("cheap"), F.count(F.when(F.col("o_custkey") < 100, 1)).alias("early"))
    percent = progress.phase_percent(F.col("phase"), {"F": (F.col("cheap"), F.col("n"))}, (F.col("early"), F.col("n")))
    return rows.select("phase", F.round(percent, 6).alias("percent"))


@query("SELECT user_id, round(least(1.0, sum(w)), 6) AS overall FROM (SELECT DISTINCT user_id, event_type, CAST(CASE event_type WHEN 'signup' THEN 0.1 WHEN 'view' THEN 0.2 WHEN 'click' THEN 0.3 WHEN 'purchase' THEN 0.4 ELSE 0 END AS DOUBLE) AS w FROM events) GROUP BY user_id")
def m9_overall_progress(spark, sf_dir):
    """M9: weights of completed phases."""
    done = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("done"))
    overall = progress.overall_progress({"signup": 0.1, "view": 0.2, "click": 0.3, "purchase": 0.4}, F.col("done"), F.lit(None).cast("string"), F.lit(None).cast("double"))
    return done.select("user_id", F.round(overall, 6).alias("overall"))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000000 AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ext_tumbling_windows(spark, sf_dir):
    """An extension: the batch twin of the windowed stream."""
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.unix_seconds(F.col("window.start").cast("timestamp")).alias("hour"), "event_type", "n")


@query("SELECT c_mktsegment AS segment, n_name AS nation, count(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY c_mktsegment, n_name")
def j21_linked_sources(spark, sf_dir):
    """Documents by their linked source."""
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return records.by_link(customers, nations, F.col("n_nationkey") == F.col("c_nationkey"), [F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation")], "customers")


@query("SELECT a.source AS source, count(DISTINCT a.lang) AS languages, count(DISTINCT a.lang) = 4 AS complete FROM documents a GROUP BY a.source")
def l12_both_sides(spark, sf_dir):
    """Which sides of a relation are there."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count_distinct("lang").alias("languages"), (F.count_distinct("lang") == 4).alias("complete"))


@query("SELECT doc_id, round(CASE WHEN toxic = 1 THEN least(1.0, 0.7 + 0.1 * quality + 0.05) ELSE 0.5 END, 6) AS confidence FROM (SELECT doc_id, CAST(quality AS DOUBLE) AS quality, toxic FROM labels)")
def l14_agent_confidence(spark, sf_dir):
    score = analysis.agent_confidence(F.col("toxic") == 1, F.col("quality") == 1, F.lit(False), F.lit(True))
    return table(spark, sf_dir, "labels").select("doc_id", F.round(score, 6).alias("confidence"))


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type NOT IN ('error', 'signup') GROUP BY user_id")
def f26_f30_active(spark, sf_dir):
    """what is in none of the closed states."""
    return records.not_in_states(table(spark, sf_dir, "events"), "event_type", ["error", "signup"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def j18_not_yet_embedded(spark, sf_dir):
    """What a restart still has to do."""
    done = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return state.without(table(spark, sf_dir, "documents").select("doc_id"), done, ["doc_id"])
