"""What the engine's compound tools give: traces, unified and hybrid searches, views, analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.engine import Engine
from weftgraph.operators import graph, retrieval, views
from weftgraph.sources import derived

from .graph_queries import starts
from .registry import query
from .retrieval_queries import COSINE, asked


def opened(spark, sf_dir) -> Engine:
    return Engine(derived.symbols(spark, sf_dir), derived.edges(spark, sf_dir))


@query("WITH RECURSIVE r AS (SELECT min(id) AS id, 0 AS depth FROM g_symbols WHERE name = 'red plate' UNION SELECT e.dst, r.depth + 1 FROM r JOIN g_calls_dag e ON e.src = r.id WHERE r.depth < 6), n AS (SELECT DISTINCT id FROM r), e AS (SELECT src, dst FROM g_calls_dag WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)), p AS (SELECT min(id) AS last, [min(id)] AS path FROM g_symbols WHERE name = 'red plate' UNION ALL SELECT e.dst, list_append(p.path, e.dst) FROM p JOIN e ON e.src = p.last WHERE len(p.path) <= 6) SELECT array_to_string(path, '>') AS path FROM p WHERE last NOT IN (SELECT src FROM e) ORDER BY path LIMIT 100")
def t22_call_chains(spark, sf_dir):
    """From an exact name to the chains of what it calls."""
    calls = derived.calls_dag(spark, sf_dir).withColumn("edge_type", F.lit("CALLS"))
    return graph.traced(derived.symbols(spark, sf_dir), calls, "red plate", "outgoing", 6).select(F.array_join("path", ">").alias("path"))


@query("WITH s AS (SELECT min(id) AS id FROM g_symbols WHERE contains(lower(name), 'd pla')), e AS (SELECT src, dst FROM g_calls_dag) SELECT array_to_string([s.id, a.src, b.src], '>') AS path FROM s JOIN e a ON a.dst = s.id JOIN e b ON b.dst = a.src UNION ALL SELECT array_to_string([s.id, a.src], '>') FROM s JOIN e a ON a.dst = s.id WHERE a.src NOT IN (SELECT dst FROM e) UNION ALL SELECT CAST(id AS VARCHAR) FROM s WHERE id NOT IN (SELECT dst FROM e)")
def t22_call_chains_by_part(spark, sf_dir):
    """No symbol has that very name, so a part of it counts; two steps of who calls it."""
    calls = derived.calls_dag(spark, sf_dir).withColumn("edge_type", F.lit("CALLS"))
    return graph.traced(derived.symbols(spark, sf_dir), calls, "D PLA", "incoming", 2).select(F.array_join("path", ">").alias("path"))


@query("WITH d AS (SELECT x, count(*) AS n FROM (SELECT src AS x FROM g_imports UNION ALL SELECT dst FROM g_imports) GROUP BY x), f AS (SELECT x FROM d ORDER BY n DESC, x LIMIT 1) SELECT * FROM (SELECT dst AS file_path, 'imports' AS relation FROM g_imports JOIN f ON src = x ORDER BY 1 LIMIT 50) UNION ALL SELECT * FROM (SELECT src, 'imported_by' FROM g_imports JOIN f ON dst = x ORDER BY 1 LIMIT 50)")
def u3_related_files(spark, sf_dir):
    """What the file with most imports both ways imports, and what imports it."""
    imports = derived.imports(spark, sf_dir)
    ends = imports.select(F.col("src").alias("x")).unionByName(imports.select(F.col("dst").alias("x")))
    first = ends.groupBy("x").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "x").first()
    nodes = derived.files(spark, sf_dir).select(F.col("file_path").alias("id"), F.col("file_path").alias("name"), F.lit("file").alias("kind"), "file_path")
    return Engine(nodes, imports.withColumn("edge_type", F.lit("IMPORTS"))).call("related_files", file_path=first[0] if first else "")


@query("WITH e AS (SELECT src, dst, edge_type FROM g_edges), s AS (SELECT id FROM g_symbols WHERE name = 'red plate'), a AS (SELECT s.id AS start, e.* FROM s JOIN e ON e.src = s.id) SELECT start, dst AS end, 1 AS length, edge_type AS relations FROM a UNION ALL SELECT a.start, e.dst, 2, a.edge_type || ',' || e.edge_type FROM a JOIN e ON e.src = a.dst WHERE NOT (e.src = a.src AND e.dst = a.dst AND e.edge_type = a.edge_type)".replace("AS end,", 'AS "end",'))
def t14_typed_trails(spark, sf_dir):
    """Walks of up to two typed edges, with their types in order."""
    out = graph.typed_trails(derived.edges(spark, sf_dir), starts(spark, sf_dir), 2, ["CALLS", "EXTENDS"])
    return out.select("start", "end", "length", F.array_join("relations", ",").alias("relations"))


@query("WITH s AS (SELECT id, name FROM g_symbols WHERE name = 'red plate' ORDER BY id LIMIT 5) SELECT s.id, s.name, (SELECT count(DISTINCT dst) FROM g_edges WHERE src = s.id) AS out_degree, (SELECT count(DISTINCT src) FROM g_edges WHERE dst = s.id) AS in_degree FROM s")
def t23_symbol_details(spark, sf_dir):
    """The first symbols of a name, with their callers and callees over all types."""
    return opened(spark, sf_dir).call("symbol_details", name="Red Plate").select("id", "name", "out_degree", "in_degree")


@query("WITH p AS (SELECT x.id AS a, y.id AS b, x.name AS n, y.name AS m FROM g_calls e JOIN g_symbols x ON x.id = e.src JOIN g_symbols y ON y.id = e.dst WHERE x.name = 'red plate') SELECT a AS start, b AS id, n || ' -> ' || m AS flow FROM p WHERE m IN (SELECT min(m) FROM p)")
def t9_flow_between(spark, sf_dir):
    """Shortest flows from symbols of one name to those of another, with the names along them."""
    symbols, calls = derived.symbols(spark, sf_dir), derived.calls(spark, sf_dir).withColumn("edge_type", F.lit("CALLS"))
    near = calls.join(symbols.where("name = 'red plate'").select(F.col("id").alias("src")), "src").join(symbols.select(F.col("id").alias("dst"), "name"), "dst")
    other = near.agg(F.min("name")).first()[0]
    return Engine(symbols, calls).call("flow", start="red plate", end=other or "", max_depth=1).select("start", "id", "flow")


def filed(spark, sf_dir):
    """Chunks whose file is documentation or code by the language of the text."""
    ending = F.when(F.col("language") == "en", ".md").otherwise(".py")
    return derived.chunks(spark, sf_dir).withColumn("file_path", F.concat("repo_id", F.lit("/"), F.col("chunk_id").cast("string"), ending))


@query(f"WITH s AS (SELECT c.*, {COSINE} AS score FROM g_chunks c JOIN embeddings q ON q.vec_id = 0), a AS (SELECT * FROM s WHERE language <> 'en' ORDER BY score DESC, chunk_id LIMIT 25), b AS (SELECT * FROM s WHERE language = 'en' ORDER BY score DESC, chunk_id LIMIT 40), r AS (SELECT e.src, string_agg(DISTINCT y.name || ':' || e.edge_type, ',' ORDER BY y.name || ':' || e.edge_type) AS related FROM g_edges e JOIN g_symbols y ON y.id = e.dst WHERE e.edge_type IN ('CALLS', 'IMPORTS', 'USES') GROUP BY e.src) SELECT chunk_id, false AS is_documentation, x.name AS symbol, coalesce(r.related, '') AS related FROM a LEFT JOIN g_symbols x ON x.id = a.chunk_id LEFT JOIN r ON r.src = a.chunk_id WHERE score >= 0.01 UNION ALL SELECT chunk_id, true, NULL, '' FROM b WHERE score >= 0.01")
def v5_j6_j7_unified_search(spark, sf_dir):
    """The nearest code with symbol and relations, and the nearest documentation."""
    out = retrieval.unified(filed(spark, sf_dir), asked(spark, sf_dir), derived.symbols(spark, sf_dir), derived.edges(spark, sf_dir), 25, least_score=0.01, most_documents=40)
    return out.select("chunk_id", "is_documentation", "symbol", F.array_join("related", ",").alias("related"))


@query(f"WITH RECURSIVE s AS (SELECT c.chunk_id, {COSINE} AS score FROM g_chunks c JOIN embeddings q ON q.vec_id = 0), v AS (SELECT chunk_id FROM s ORDER BY score DESC, chunk_id LIMIT 10), w AS (SELECT chunk_id, unnest(regexp_extract_all(lower(content), '[a-z0-9_]+')) AS term FROM g_chunks), c AS (SELECT chunk_id, term, count(*) AS n FROM w WHERE term IN ('licensed', 'token') GROUP BY 1, 2), h AS (SELECT term, count(*) AS having FROM c GROUP BY term), l AS (SELECT chunk_id, sum(n * ln(1 + (SELECT count(*) FROM g_chunks) / having)) AS score FROM c JOIN h USING (term) GROUP BY chunk_id), k AS (SELECT chunk_id FROM l ORDER BY round(score, 9) DESC, chunk_id LIMIT 10), u AS (SELECT src, dst FROM g_calls UNION SELECT dst, src FROM g_calls), r AS (SELECT chunk_id AS id, 0 AS depth FROM v UNION SELECT chunk_id, 0 FROM k UNION SELECT u.dst, r.depth + 1 FROM r JOIN u ON u.src = r.id WHERE r.depth < 3) SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY id".replace("having", "held"))
def v11_hybrid_traversal(spark, sf_dir):
    """From the nearest and the lexically best chunks along calls; a depth of 9 is held to 3."""
    return retrieval.hybrid_traversal(derived.chunks(spark, sf_dir), asked(spark, sf_dir), derived.edges(spark, sf_dir), 10, 9, ["CALLS"], ["licensed", "token"])


@query("WITH n AS (SELECT id FROM g_symbols WHERE starts_with(file_path, 'Brand#1') AND kind IN ('promo', 'small', 'large')), e AS (SELECT src, dst FROM g_calls WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)), d AS (SELECT n.id, count(x.id) AS k FROM n LEFT JOIN (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) x ON x.id = n.id GROUP BY n.id), t AS (SELECT id FROM d ORDER BY k DESC, id LIMIT 60) SELECT src, dst FROM e WHERE src IN (SELECT id FROM t) AND dst IN (SELECT id FROM t)")
def g8_dispatched_view(spark, sf_dir):
    """The calls view of a folder and some kinds, up to a limit of nodes."""
    return views.view("calls", derived.symbols(spark, sf_dir), derived.edges(spark, sf_dir), folder="Brand#1", kinds=("promo", "small", "large"), limit=60)[1].select("src", "dst")


@query("WITH n AS (SELECT id FROM g_symbols WHERE kind = 'promo') SELECT src, dst, CASE WHEN edge_type = 'CALLS' AND src % 2 = 0 THEN 'CALLS' ELSE edge_type END AS edge_type FROM g_edges WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def g11_retrieved_view(spark, sf_dir):
    """The view of a retrieval; an edge of an odd type counts as a call, and both ends must be there."""
    nodes = derived.symbols(spark, sf_dir).where("kind = 'promo'")
    odd = F.when((F.col("edge_type") == "CALLS") & (F.col("src") % 2 == 0), "MENTIONS").otherwise(F.col("edge_type"))
    return views.retrieved_view(nodes.unionByName(nodes.limit(3)), derived.edges(spark, sf_dir).withColumn("edge_type", odd))[1].select("src", "dst", "edge_type")


@query("WITH RECURSIVE w AS (SELECT src AS id, 0 AS n FROM g_calls_dag UNION SELECT e.dst, w.n + 1 FROM w JOIN g_calls_dag e ON e.src = w.id WHERE w.n < 20) SELECT 'nodes' AS metric, kind AS key, count(*) AS value FROM g_symbols GROUP BY kind UNION ALL SELECT 'edges', 'CALLS', count(*) FROM g_calls_dag UNION ALL SELECT 'depth', CASE WHEN max(n) >= 20 THEN 'capped' ELSE 'exact' END, max(n) FROM w")
def l10_graph_statistics(spark, sf_dir):
    """Nodes by kind, edges by type, and how deep the calls go."""
    return Engine(derived.symbols(spark, sf_dir), derived.calls_dag(spark, sf_dir).withColumn("edge_type", F.lit("CALLS"))).call("statistics")


NAMED = "SELECT id, CASE split_part(name, ' ', 1) WHEN 'red' THEN 'get_' || split_part(name, ' ', 2) WHEN 'blue' THEN 'on_' || split_part(name, ' ', 2) WHEN 'hot' THEN split_part(name, ' ', 2) || 'Service' ELSE split_part(name, ' ', 2) || 'Store' END AS name, 'app/' || kind || CASE kind WHEN 'promo' THEN '/views.py' ELSE '/x.py' END AS file_path FROM g_symbols"


@query(f"WITH RECURSIVE n AS ({NAMED}), e AS (SELECT id, name, CASE WHEN ends_with(file_path, '/views.py') AND starts_with(name, 'get_') THEN 'http' WHEN starts_with(name, 'on_') THEN 'event' END AS detail FROM n), c AS (SELECT id, name, CASE WHEN ends_with(name, 'Store') THEN 'repository' WHEN ends_with(name, 'Service') THEN 'service' END AS detail FROM n), f AS (SELECT id FROM e WHERE detail IS NOT NULL ORDER BY id LIMIT 40), r AS (SELECT id, 0 AS depth FROM f UNION SELECT g.dst, r.depth + 1 FROM r JOIN g_calls g ON g.src = r.id WHERE r.depth < 3), d AS (SELECT id, min(depth) AS depth FROM r GROUP BY id) SELECT 'entry' AS section, id, name, detail FROM e WHERE detail IS NOT NULL UNION ALL SELECT 'concept', id, name, detail FROM c WHERE detail IS NOT NULL UNION ALL SELECT 'flow', d.id, n.name, CAST(d.depth AS VARCHAR) FROM d JOIN n USING (id) WHERE depth > 0")
def l8_full_analysis(spark, sf_dir):
    """Entry points, concepts, and what the first entry points reach, in one table."""
    word, noun = F.split("name", " ")[0], F.split("name", " ")[1]
    name = F.when(word == "red", F.concat(F.lit("get_"), noun)).when(word == "blue", F.concat(F.lit("on_"), noun)).when(word == "hot", F.concat(noun, F.lit("Service"))).otherwise(F.concat(noun, F.lit("Store")))
    path = F.concat(F.lit("app/"), "kind", F.when(F.col("kind") == "promo", "/views.py").otherwise("/x.py"))
    nodes = derived.symbols(spark, sf_dir).select("id", name.alias("name"), "kind", path.alias("file_path"))
    return Engine(nodes, derived.edges(spark, sf_dir)).call("analysis", max_depth=3, most=40)


@query(f"WITH RECURSIVE s AS (SELECT c.*, {COSINE} AS score FROM g_chunks c JOIN embeddings q ON q.vec_id = 0), b AS (SELECT chunk_id, score, false AS anchor FROM s ORDER BY score DESC, chunk_id LIMIT 60), m AS (SELECT * FROM b UNION ALL SELECT chunk_id, 0.5, true FROM g_chunks WHERE chunk_id IN (SELECT id FROM g_symbols WHERE name = 'red plate') AND chunk_id NOT IN (SELECT chunk_id FROM b)), u AS (SELECT src, dst FROM g_calls UNION SELECT dst, src FROM g_calls), t AS (SELECT chunk_id AS id FROM m WHERE chunk_id IN (SELECT id FROM g_symbols)), d AS (SELECT id, min(depth) AS distance FROM (SELECT id, 0 AS depth FROM t UNION ALL SELECT u.dst, 1 FROM u JOIN t ON t.id = u.src) GROUP BY id), a AS (SELECT c.chunk_id, c.repo_id, CAST(floor(length(c.content) / 4) AS BIGINT) AS tokens, coalesce(m.score, 0.0) AS score, coalesce(m.anchor, false) AS anchor, coalesce(d.distance, -1) AS distance FROM g_chunks c LEFT JOIN m USING (chunk_id) LEFT JOIN d ON d.id = c.chunk_id WHERE m.chunk_id IS NOT NULL OR d.id IS NOT NULL), f AS (SELECT *, score + CASE WHEN distance >= 0 THEN 0.3 / (distance + 1) ELSE 0 END + CASE WHEN anchor THEN 0.2 ELSE 0 END + CASE WHEN repo_id = 'src1' THEN 0.05 ELSE 0 END AS final FROM a), p AS (SELECT *, row_number() OVER (ORDER BY final DESC, chunk_id) AS place FROM f), r AS (SELECT place, chunk_id, true AS kept, tokens AS total FROM p WHERE place = 1 UNION ALL SELECT p.place, p.chunk_id, p.tokens = 0 OR r.total + p.tokens <= 20000, CASE WHEN r.total + p.tokens <= 20000 THEN r.total + p.tokens ELSE r.total END FROM r JOIN p ON p.place = r.place + 1) SELECT p.chunk_id, p.tokens, round(p.final, 6) AS final, CAST(p.distance AS INTEGER) AS distance, p.anchor FROM r JOIN p USING (place) WHERE r.kept")
def r1_retrieve(spark, sf_dir):
    """From a question that names a symbol to ranked chunks within a budget of tokens."""
    nodes = derived.symbols(spark, sf_dir).withColumn("name", F.replace(F.initcap("name"), F.lit(" "), F.lit("")))
    chunks = filed(spark, sf_dir).withColumns({"start_line": F.lit(1), "end_line": F.lit(10)})
    links = chunks.select("chunk_id", F.col("chunk_id").alias("id")).join(nodes.select("id"), "id", "left_semi").select("chunk_id", "id")
    knobs = retrieval.Settings(top_k_vector=60, graph_expansion_hops=1, max_expansion_nodes=2000, max_context_tokens=20_000)
    out = retrieval.retrieve("What does RedPlate do?", asked(spark, sf_dir), chunks, links, nodes, derived.calls(spark, sf_dir).withColumn("edge_type", F.lit("CALLS")), knobs, current_file="src1/none.md")
    return out.select("chunk_id", "tokens", F.round("final", 6).alias("final"), "distance", "anchor")
