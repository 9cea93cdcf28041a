"""Graph filters, joins, traversals, degrees and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import graph
from weftgraph.sources import derived
from weftgraph.sources.tables import table

from .registry import query

#: Symbols whose name is "red plate" are the starts of the traversal queries.
START = "red plate"


def starts(spark, sf_dir):
    return derived.symbols(spark, sf_dir).where(F.col("name") == START).select("id")


@query("SELECT id, name, total, out_degree, in_degree FROM (SELECT s.id, s.name, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) + coalesce(i.n, 0) AS total FROM g_symbols s LEFT JOIN (SELECT src, count(DISTINCT dst) AS n FROM g_calls GROUP BY src) o ON o.src = s.id LEFT JOIN (SELECT dst, count(DISTINCT src) AS n FROM g_calls GROUP BY dst) i ON i.dst = s.id) WHERE total >= 5 ORDER BY total DESC, id LIMIT 50")
def r20_hotspots(spark, sf_dir):
    """Symbols by total degree."""
    return graph.hotspots(derived.symbols(spark, sf_dir), derived.calls(spark, sf_dir), 50).select("id", "name", "total", "out_degree", "in_degree")


@query("SELECT id, count(*) FILTER (side = 0) AS out_degree, count(*) FILTER (side = 1) AS in_degree, count(*) AS total FROM (SELECT src AS id, 0 AS side FROM g_calls UNION ALL SELECT dst, 1 FROM g_calls) GROUP BY id")
def a7_degrees(spark, sf_dir):
    return graph.degrees(derived.calls(spark, sf_dir))


@query("WITH hot AS (SELECT id FROM (SELECT src AS id FROM g_calls UNION ALL SELECT dst FROM g_calls) GROUP BY id HAVING count(*) >= 5) SELECT src, dst FROM g_calls WHERE src IN (SELECT id FROM hot) AND dst IN (SELECT id FROM hot)")
def j11_hotspot_edges(spark, sf_dir):
    calls = derived.calls(spark, sf_dir)
    return graph.induced(calls, graph.degrees(calls).where("total >= 5"))


@query("WITH k AS (SELECT id FROM g_symbols WHERE kind = 'promo') SELECT src, dst FROM g_calls WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def j12_induced_subgraph(spark, sf_dir):
    """Edges with both ends among the symbols of one kind."""
    return graph.induced(derived.calls(spark, sf_dir), derived.symbols(spark, sf_dir).where("kind = 'promo'"))


@query("SELECT id, name, kind, file_path FROM g_symbols WHERE id = 7")
def f1_get_node(spark, sf_dir):
    return derived.symbols(spark, sf_dir).where("id = 7")


@query("SELECT count(*) > 0 AS found FROM g_calls WHERE src = 1 AND dst = 2")
def f2_edge_exists(spark, sf_dir):
    return derived.calls(spark, sf_dir).where("src = 1 AND dst = 2").agg((F.count(F.lit(1)) > 0).alias("found"))


@query("SELECT id, name, kind FROM g_symbols WHERE kind IN ('promo', 'small')")
def f5_symbols_by_kind(spark, sf_dir):
    return derived.symbols(spark, sf_dir).where(F.col("kind").isin("promo", "small")).select("id", "name", "kind")


@query("SELECT id, name, kind FROM g_symbols WHERE kind IN ('promo', 'small') AND starts_with(file_path, 'Brand#1/')")
def f6_symbols_by_kind_in_folder(spark, sf_dir):
    return derived.symbols(spark, sf_dir).where(F.col("kind").isin("promo", "small") & F.col("file_path").startswith("Brand#1/")).select("id", "name", "kind")


@query("SELECT id, name, file_path FROM g_symbols WHERE regexp_matches(lower(name), '^(red|blue) ') AND regexp_matches(lower(file_path), 'promo/[12]') AND kind = 'promo' ORDER BY id LIMIT 100")
def f9_symbols_by_pattern(spark, sf_dir):
    """predicates first, then a total order, then the limit."""
    found = derived.symbols(spark, sf_dir).where(F.lower("name").rlike("^(red|blue) ") & F.lower("file_path").rlike("promo/[12]") & (F.col("kind") == "promo"))
    return found.select("id", "name", "file_path").orderBy("id").limit(100)


@query("SELECT id FROM g_symbols WHERE lower(name) = 'red plate' OR regexp_matches(lower(name), '(^|[^a-z0-9_])plate([^a-z0-9_]|$)') ORDER BY id LIMIT 20")
def f10_search_by_name(spark, sf_dir):
    name = F.lower("name")
    return derived.symbols(spark, sf_dir).where((name == "red plate") | name.rlike("(^|[^a-z0-9_])plate([^a-z0-9_]|$)")).select("id").orderBy("id").limit(20)


@query("SELECT min(id) AS id FROM g_symbols WHERE name = 'red plate'")
def f11_resolve_symbol(spark, sf_dir):
    return starts(spark, sf_dir).agg(F.min("id").alias("id"))


@query("SELECT e.src, e.dst FROM g_calls e JOIN g_symbols a ON a.id = e.src JOIN g_symbols b ON b.id = e.dst WHERE (starts_with(a.file_path, 'Brand#1/') OR starts_with(b.file_path, 'Brand#1/')) AND (a.kind IN ('promo') OR b.kind IN ('promo'))")
def f12_f13_edges_by_folder_and_kind(spark, sf_dir):
    """either end lies in the folder, and either end has the kind."""
    ends = {side: derived.symbols(spark, sf_dir).select(F.col("id").alias(side), F.col("file_path").alias(f"{side}_path"), F.col("kind").alias(f"{side}_kind")) for side in ("src", "dst")}
    both = derived.calls(spark, sf_dir).join(ends["src"], "src").join(ends["dst"], "dst")
    inside = F.col("src_path").startswith("Brand#1/") | F.col("dst_path").startswith("Brand#1/")
    return both.where(inside & (F.col("src_kind").isin("promo") | F.col("dst_kind").isin("promo"))).select("src", "dst")


@query("SELECT count(*) > 0 AS found FROM g_files WHERE starts_with(file_path, 'Brand#1/PROMO')")
def f14_path_exists(spark, sf_dir):
    return derived.files(spark, sf_dir).where(F.col("file_path").startswith("Brand#1/PROMO")).agg((F.count(F.lit(1)) > 0).alias("found"))


@query("SELECT file_path FROM g_files WHERE starts_with(file_path, 'Brand#2') AND length(file_path) - length(replace(file_path, '/', '')) < 3")
def f16_list_files(spark, sf_dir):
    """Files under a prefix, down to a depth."""
    path = F.col("file_path")
    return derived.files(spark, sf_dir).where(path.startswith("Brand#2") & (F.size(F.split(path, "/")) - 1 < 3))


@query("SELECT e.src AS start, s.id, s.name, s.kind FROM g_calls e JOIN g_symbols s ON s.id = e.dst WHERE e.src IN (SELECT id FROM g_symbols WHERE name = 'red plate')")
def j1_neighbours_outgoing(spark, sf_dir):
    return graph.neighbours(derived.symbols(spark, sf_dir), derived.calls(spark, sf_dir), starts(spark, sf_dir)).select("start", "id", "name", "kind")


@query("SELECT e.dst AS start, s.id, s.name, s.kind FROM g_calls e JOIN g_symbols s ON s.id = e.src WHERE e.dst IN (SELECT id FROM g_symbols WHERE name = 'red plate')")
def j1_neighbours_incoming(spark, sf_dir):
    return graph.neighbours(derived.symbols(spark, sf_dir), derived.calls(spark, sf_dir), starts(spark, sf_dir), "incoming").select("start", "id", "name", "kind")


@query("SELECT DISTINCT x.start, s.id, s.name FROM (SELECT src AS start, dst AS id FROM g_edges UNION SELECT dst, src FROM g_edges) x JOIN g_symbols s ON s.id = x.id WHERE x.start IN (SELECT id FROM g_symbols WHERE name = 'red plate')")
def j1_neighbours_both(spark, sf_dir):
    return graph.neighbours(derived.symbols(spark, sf_dir), derived.edges(spark, sf_dir), starts(spark, sf_dir), "both").select("start", "id", "name")


@query("SELECT s.name, count(DISTINCT CASE WHEN e.dst = s.id THEN e.src END) AS callers, count(DISTINCT CASE WHEN e.src = s.id THEN e.dst END) AS callees FROM g_symbols s JOIN g_edges e ON s.id IN (e.src, e.dst) AND e.edge_type = 'CALLS' GROUP BY s.name")
def j2_symbol_references(spark, sf_dir):
    """Callers and callees by symbol name."""
    calls = derived.calls(spark, sf_dir)
    sides = calls.select(F.col("dst").alias("id"), F.col("src").alias("caller"), F.lit(None).cast("long").alias("callee")).unionByName(calls.select(F.col("src").alias("id"), F.lit(None).cast("long").alias("caller"), F.col("dst").alias("callee")))
    return sides.join(derived.symbols(spark, sf_dir).select("id", "name"), "id").groupBy("name").agg(F.count_distinct("caller").alias("callers"), F.count_distinct("callee").alias("callees"))


@query("SELECT src AS file_path, dst AS target, count(*) OVER (PARTITION BY src) AS imports FROM g_imports")
def j3_file_imports(spark, sf_dir):
    """What each file imports, and how many files that are."""
    imports = derived.imports(spark, sf_dir)
    return imports.join(imports.groupBy("src").agg(F.count(F.lit(1)).alias("imports")), "src").select(F.col("src").alias("file_path"), F.col("dst").alias("target"), "imports")


@query("SELECT DISTINCT a.file_path AS from_file, b.file_path AS to_file, e.edge_type FROM g_edges e JOIN g_symbols a ON a.id = e.src JOIN g_symbols b ON b.id = e.dst WHERE a.file_path <> b.file_path ORDER BY 1, 2, 3 LIMIT 100")
def j10_inter_file_relationships(spark, sf_dir):
    of = derived.symbols(spark, sf_dir).select("id", "file_path")
    pairs = derived.edges(spark, sf_dir).join(of.select(F.col("id").alias("src"), F.col("file_path").alias("from_file")), "src").join(of.select(F.col("id").alias("dst"), F.col("file_path").alias("to_file")), "dst")
    return pairs.where("from_file <> to_file").select("from_file", "to_file", "edge_type").distinct().orderBy("from_file", "to_file", "edge_type").limit(100)


BFS = "WITH RECURSIVE r AS (SELECT id, 0 AS depth FROM g_symbols WHERE name = 'red plate' UNION SELECT e.dst, r.depth + 1 FROM r JOIN {edges} e ON e.src = r.id WHERE r.depth < {depth}), n AS (SELECT id, min(depth) AS depth FROM r GROUP BY id) "


@query(BFS.format(edges="g_calls", depth=6) + "SELECT id, depth FROM n")
def t1_reachable(spark, sf_dir):
    """Breadth-first search along calls."""
    return graph.traverse(derived.calls(spark, sf_dir), starts(spark, sf_dir), 6)[0]


@query(BFS.format(edges="g_calls", depth=6) + "SELECT e.src, e.dst, b.depth FROM g_calls e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst WHERE b.depth = a.depth + 1")
def t1_discovery_edges(spark, sf_dir):
    return graph.traverse(derived.calls(spark, sf_dir), starts(spark, sf_dir), 6)[1]


@query(BFS.format(edges="g_calls", depth=6) + "SELECT e.src, e.dst FROM g_calls e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst")
def t2_reachable_edges(spark, sf_dir):
    """All edges among the reachable nodes."""
    calls = derived.calls(spark, sf_dir)
    return graph.induced(calls, graph.traverse(calls, starts(spark, sf_dir), 6)[0])


@query("WITH RECURSIVE i AS (SELECT dst AS src, src AS dst FROM g_calls)," + BFS.format(edges="i", depth=5)[14:] + "SELECT id, depth FROM n")
def t3_reachable_incoming(spark, sf_dir):
    return graph.traverse(derived.calls(spark, sf_dir), starts(spark, sf_dir), 5, "incoming")[0]


@query("WITH RECURSIVE i AS (SELECT dst AS src, src AS dst FROM g_edges)," + BFS.format(edges="g_edges", depth=3)[14:].replace("r AS", "r1 AS", 1).replace("FROM r JOIN", "FROM r1 r JOIN").replace("FROM r GROUP", "FROM r1 GROUP").replace("n AS", "n1 AS") + "," + BFS.format(edges="i", depth=3)[14:].replace("r AS", "r2 AS", 1).replace("FROM r JOIN", "FROM r2 r JOIN").replace("FROM r GROUP", "FROM r2 GROUP").replace("n AS", "n2 AS") + "SELECT CAST(depth AS INTEGER) AS depth, count(*) AS nodes FROM (SELECT * FROM n1 UNION ALL SELECT * FROM n2) GROUP BY depth")
def t4_bidirectional_counts(spark, sf_dir):
    """T4: nodes by depth, outgoing and incoming searches added."""
    return graph.neighbourhood(derived.edges(spark, sf_dir), starts(spark, sf_dir), 3)[1]


@query("WITH RECURSIVE u AS (SELECT src, dst FROM g_calls UNION SELECT dst, src FROM g_calls)," + BFS.format(edges="u", depth=4)[14:] + "SELECT id, depth FROM n")
def t17_symbol_neighbourhood(spark, sf_dir):
    """Undirected search."""
    return graph.traverse(derived.calls(spark, sf_dir), starts(spark, sf_dir), 4, "both")[0]


@query("WITH RECURSIVE u AS (SELECT src, dst FROM g_calls UNION SELECT dst, src FROM g_calls), r AS (SELECT min(id) AS id, 0 AS length, CAST(min(id) AS VARCHAR) AS path FROM g_symbols WHERE name = 'red plate' UNION ALL SELECT id, length, path FROM (SELECT u.dst AS id, r.length + 1 AS length, r.path || '>' || u.dst AS path, row_number() OVER (PARTITION BY u.dst ORDER BY u.src, r.path) AS n FROM r JOIN u ON u.src = r.id WHERE r.length < 5) WHERE n = 1), s AS (SELECT id, min(length) AS length FROM r GROUP BY id) SELECT s.id, CAST(s.length AS INTEGER) AS length FROM s")
def t8_shortest_path_lengths(spark, sf_dir):
    """Undirected shortest paths from one symbol; lengths have one answer."""
    start = derived.symbols(spark, sf_dir).where(F.col("name") == START).agg(F.min("id").alias("id"))
    return graph.shortest_paths(derived.calls(spark, sf_dir), start, 5).select("id", "length")


@query("WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS src, -l_suppkey AS dst FROM lineitem WHERE l_orderkey % 4 = 0), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), z AS (SELECT min(src) AS a, max(src) AS b FROM e), r AS (SELECT a AS id, 0 AS depth FROM z UNION SELECT u.dst, r.depth + 1 FROM r JOIN u ON u.src = r.id WHERE r.depth < 8), d AS (SELECT id, min(depth) AS depth FROM r GROUP BY id), p AS (SELECT b AS id, CAST(b AS VARCHAR) AS path, (SELECT depth FROM d WHERE id = b) AS depth FROM z WHERE b IN (SELECT id FROM d) UNION ALL SELECT src, src || '>' || path, depth FROM (SELECT u.src, p.path, p.depth - 1 AS depth, row_number() OVER (ORDER BY u.src) AS n FROM p JOIN u ON u.dst = p.id JOIN d ON d.id = u.src AND d.depth = p.depth - 1) WHERE n = 1) SELECT (SELECT b FROM z) AS id, CAST((SELECT depth FROM d WHERE id = (SELECT b FROM z)) AS INTEGER) AS length, path FROM p WHERE depth = 0")
def t8_two_sided_path(spark, sf_dir):
    """The shortest path between two parts over their suppliers, searched from both; of equally short ones that of the smallest ids from the end."""
    edges = table(spark, sf_dir, "lineitem").where("l_orderkey % 4 = 0").select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey")).alias("dst")).distinct()
    first, last = (edges.agg(of("src").alias("id")) for of in (F.min, F.max))
    found = graph.shortest_path(edges, first, last, 8)
    return found.select("id", "length", F.array_join("path", ">").alias("path"))


@query("WITH RECURSIVE c AS (SELECT src, dst FROM g_calls WHERE src % 40 < 8 AND dst % 40 < 8 AND src % 40 <> 3), r AS (SELECT id AS start, id, [id] AS path FROM g_symbols WHERE id % 40 = 1 UNION ALL SELECT r.start, c.dst, list_append(r.path, c.dst) FROM r JOIN c ON c.src = r.id WHERE len(r.path) <= 5 AND NOT list_contains(r.path, c.dst)) SELECT start, array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INTEGER) AS length FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY path) AS n FROM r WHERE id NOT IN (SELECT src FROM c)) WHERE n <= 7")
def t10_t22_cyclic_paths(spark, sf_dir):
    """The first paths to leaves in a call graph with cycles, from many symbols."""
    calls = derived.calls(spark, sf_dir).where("src % 40 < 8 AND dst % 40 < 8 AND src % 40 <> 3")
    found = graph.paths_to_leaves(calls, derived.symbols(spark, sf_dir).where("id % 40 = 1").select("id"), 5, 7)
    return found.select("start", F.array_join("path", ">").alias("path"), "length")


@query("WITH RECURSIVE d AS (SELECT src, dst FROM g_calls_dag), r AS (SELECT id AS start, id, CAST(id AS VARCHAR) AS path, 0 AS length FROM g_symbols WHERE name = 'red plate' UNION ALL SELECT r.start, d.dst, r.path || '>' || d.dst, r.length + 1 FROM r JOIN d ON d.src = r.id WHERE r.length < 12) SELECT start, path, CAST(length AS INTEGER) AS length FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY [CAST(x AS BIGINT) FOR x IN string_split(path, '>')]) AS n FROM r WHERE id NOT IN (SELECT src FROM d)) WHERE n <= 100")
def t10_paths_to_leaves(spark, sf_dir):
    """The first hundred simple paths from each start to leaves of the acyclic call graph."""
    out = graph.paths_to_leaves(derived.calls_dag(spark, sf_dir), starts(spark, sf_dir), 12)
    return out.select("start", F.array_join("path", ">").alias("path"), "length")


@query("WITH RECURSIVE d AS (SELECT src, dst FROM g_calls_dag), r AS (SELECT id, [id] AS path, 0 AS length FROM g_symbols WHERE name = 'red plate' UNION ALL SELECT d.dst, list_append(r.path, d.dst), r.length + 1 FROM r JOIN d ON d.src = r.id WHERE r.length < 12), l AS (SELECT * FROM r WHERE id NOT IN (SELECT src FROM d)) SELECT count(*) AS total, round(avg(length), 6) AS mean, CAST(max(length) AS INTEGER) AS longest, CAST(min(length) AS INTEGER) AS shortest, (SELECT count(DISTINCT x) FROM (SELECT unnest(path) AS x FROM l)) AS nodes FROM l")
def t11_path_statistics(spark, sf_dir):
    out = graph.paths_to_leaves(derived.calls_dag(spark, sf_dir), starts(spark, sf_dir), 12)
    nodes = out.select(F.explode("path").alias("x")).agg(F.count_distinct("x").alias("nodes"))
    return out.agg(F.count(F.lit(1)).alias("total"), F.round(F.avg("length"), 6).alias("mean"), F.max("length").alias("longest"), F.min("length").alias("shortest")).join(F.broadcast(nodes))


@query("WITH t AS (SELECT a.src AS start, a.dst AS middle, b.dst AS final FROM g_calls a JOIN g_calls b ON b.src = a.dst) SELECT t.start, t.final, CAST(2 AS INTEGER) AS length, count(*) AS walks FROM t JOIN g_symbols s ON s.id = t.start AND s.name = 'red plate' GROUP BY t.start, t.final")
def t6_trails_of_two(spark, sf_dir):
    """Edge-unique walks of two calls. A walk a-b-a uses two edges."""
    out = graph.trails(derived.calls(spark, sf_dir), starts(spark, sf_dir), 2, 2)
    return out.groupBy("start", F.col("end").alias("final"), "length").agg(F.count(F.lit(1)).alias("walks"))


@query("WITH u AS (SELECT src, dst FROM g_calls UNION SELECT dst, src FROM g_calls), h AS (SELECT src AS start, dst AS id, 1 AS distance FROM u UNION ALL SELECT a.src, b.dst, 2 FROM u a JOIN u b ON b.src = a.dst WHERE b.dst <> a.src) SELECT start, id, CAST(min(distance) AS INTEGER) AS distance, count(*) AS ways FROM h WHERE start IN (SELECT id FROM g_symbols WHERE name = 'red plate') GROUP BY start, id")
def t13_two_hops(spark, sf_dir):
    """Undirected neighbours at one and two hops, with the number of ways."""
    walked = graph.oriented(derived.calls(spark, sf_dir), "both").distinct()
    one = walked.join(starts(spark, sf_dir).select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("start"), F.col("dst").alias("id"), F.lit(1).alias("distance"))
    two = one.withColumnRenamed("id", "src").join(walked, "src").where("dst <> start").select("start", F.col("dst").alias("id"), F.lit(2).alias("distance"))
    return one.unionByName(two).groupBy("start", "id").agg(F.min("distance").alias("distance"), F.count(F.lit(1)).alias("ways"))


@query("WITH RECURSIVE s AS (SELECT DISTINCT e.src AS id, 0 AS depth FROM g_calls_dag e), r AS (SELECT id, depth FROM s UNION SELECT d.dst, r.depth + 1 FROM r JOIN g_calls_dag d ON d.src = r.id) SELECT CAST(max(depth) AS INTEGER) AS longest, false AS capped FROM r")
def t19_max_depth(spark, sf_dir):
    longest, capped = graph.longest_trail(derived.calls_dag(spark, sf_dir), 200)
    return spark.range(1).select(F.lit(longest).alias("longest"), F.lit(capped).alias("capped"))


@query("SELECT edge_type, count(*) AS edges FROM g_edges GROUP BY edge_type")
def a3_edge_counts(spark, sf_dir):
    """Edges by type."""
    return derived.edges(spark, sf_dir).groupBy("edge_type").agg(F.count(F.lit(1)).alias("edges"))


@query("SELECT kind, count(*) AS symbols FROM g_symbols GROUP BY kind")
def a2_symbol_kinds(spark, sf_dir):
    return derived.symbols(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("symbols"))


@query("SELECT 'symbol' AS label, count(*) AS n FROM g_symbols UNION ALL SELECT 'file', count(*) FROM g_files UNION ALL SELECT 'chunk', count(*) FROM g_chunks UNION ALL SELECT 'total', (SELECT count(*) FROM g_symbols) + (SELECT count(*) FROM g_files) + (SELECT count(*) FROM g_chunks)")
def a1_a4_node_counts(spark, sf_dir):
    """A1, A4, A5: nodes by label, with the total."""
    parts = [of(spark, sf_dir).select(F.lit(name).alias("label")) for name, of in (("symbol", derived.symbols), ("file", derived.files), ("chunk", derived.chunks))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.rollup("label").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("label", F.lit("total")).alias("label"), "n")


@query("SELECT CASE WHEN contains(file_path, '/') THEN split_part(file_path, '/', 1) ELSE '(root)' END AS module, count(*) AS files FROM g_files GROUP BY 1")
def a6_module_counts(spark, sf_dir):
    """Files by first path segment."""
    module = F.when(F.col("file_path").contains("/"), F.split_part("file_path", F.lit("/"), F.lit(1))).otherwise("(root)")
    return derived.files(spark, sf_dir).groupBy(module.alias("module")).agg(F.count(F.lit(1)).alias("files"))


@query("WITH d AS (SELECT DISTINCT split_part(file_path, '/', 1) AS dir FROM g_files UNION SELECT DISTINCT split_part(file_path, '/', 1) || '/' || split_part(file_path, '/', 2) FROM g_files) SELECT CASE WHEN contains(dir, '/') THEN 'dir:' || split_part(dir, '/', 1) ELSE 'repo' END AS src, 'dir:' || dir AS dst FROM d UNION ALL SELECT 'dir:' || split_part(file_path, '/', 1) || '/' || split_part(file_path, '/', 2), 'file:' || file_path FROM g_files")
def g1_containment_view(spark, sf_dir):
    """Directories from path prefixes, and the edges that contain."""
    from weftgraph.operators import resolve

    return resolve.containment(derived.files(spark, sf_dir), "file_path")


@query("SELECT src, dst FROM g_imports WHERE (starts_with(src, 'Brand#1/') OR starts_with(dst, 'Brand#1/')) AND src <> dst")
def g5_dependencies_view(spark, sf_dir):
    return derived.imports(spark, sf_dir).where(F.col("src").startswith("Brand#1/") | F.col("dst").startswith("Brand#1/")).where("src <> dst")


@query("SELECT s.id, s.name, e.n AS calls FROM g_symbols s JOIN (SELECT src, count(*) AS n FROM g_calls GROUP BY src) e ON e.src = s.id WHERE starts_with(s.file_path, 'Brand#1/') ORDER BY calls DESC, s.id LIMIT 50")
def g4_hotspots_in_folder(spark, sf_dir):
    """The folder is applied before the limit."""
    out = derived.calls(spark, sf_dir).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("calls"))
    nodes = derived.symbols(spark, sf_dir).where(F.col("file_path").startswith("Brand#1/"))
    return nodes.join(out, "id").select("id", "name", "calls").orderBy(F.desc("calls"), "id").limit(50)


@query("SELECT id, CASE WHEN kind = 'promo' THEN 'first' ELSE 'second' END AS origin, name FROM g_symbols")
def i2_graph_union(spark, sf_dir):
    """Union of two graphs; of equal nodes and edges the first graph's stays."""
    symbols, edges = derived.symbols(spark, sf_dir), derived.edges(spark, sf_dir)
    first = symbols.where("kind = 'promo'").select("id", F.lit("first").alias("origin"), "name")
    second = symbols.select("id", F.lit("second").alias("origin"), "name")
    nodes, _ = graph.union_graphs((first, edges), (second, edges))
    return nodes


@query("SELECT DISTINCT src, dst, edge_type FROM g_edges")
def i1_edge_union(spark, sf_dir):
    """Edges of two graphs that overlap, once each."""
    symbols, edges = derived.symbols(spark, sf_dir).select("id"), derived.edges(spark, sf_dir)
    return graph.union_graphs((symbols, edges.where("edge_type = 'CALLS'")), (symbols, edges))[1]
