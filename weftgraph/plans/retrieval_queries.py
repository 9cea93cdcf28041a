"""Vector search, hybrid retrieval, scoring and budgets on chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import scalars, vectors
from weftgraph.operators import graph, retrieval
from weftgraph.sources import derived
from weftgraph.sources.tables import table

from .registry import query

COSINE = "list_inner_product(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_inner_product(CAST(c.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))))"
SCORED = f"s AS (SELECT c.*, {COSINE} AS score FROM g_chunks c JOIN embeddings q ON q.vec_id = 0)"


def asked(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding")


@query(f"WITH {SCORED} SELECT chunk_id, round(score, 6) AS score FROM s WHERE language = 'en' ORDER BY s.score DESC, chunk_id LIMIT 50")
def v1_vector_search(spark, sf_dir):
    """V1: filter first, then the nearest by cosine."""
    out = retrieval.similar(derived.chunks(spark, sf_dir), asked(spark, sf_dir), 50, prefilter=F.col("language") == "en")
    return out.select("chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {SCORED}, t AS (SELECT * FROM s ORDER BY score DESC, chunk_id LIMIT 50) SELECT chunk_id, round(score, 6) AS score FROM t WHERE language = 'en' AND score >= 0.1")
def v2_vector_search_postfilter(spark, sf_dir):
    """V2: the cut first, then the filter; may return fewer."""
    out = retrieval.similar(derived.chunks(spark, sf_dir), asked(spark, sf_dir), 50, postfilter=(F.col("language") == "en") & (F.col("score") >= 0.1))
    return out.select("chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {SCORED}, a AS (SELECT chunk_id, score, false AS is_documentation FROM s WHERE language <> 'en' ORDER BY score DESC, chunk_id LIMIT 30), b AS (SELECT chunk_id, score, true AS is_documentation FROM s WHERE language = 'en' ORDER BY score DESC, chunk_id LIMIT 100) SELECT chunk_id, round(score, 6) AS score, is_documentation FROM (SELECT * FROM a UNION ALL SELECT * FROM b)")
def v4_combined_search(spark, sf_dir):
    """Code and documentation searched apart, then joined."""
    parts = []
    for documentation, k in ((False, 30), (True, 100)):
        is_documentation = F.col("language") == "en"
        part = retrieval.similar(derived.chunks(spark, sf_dir), asked(spark, sf_dir), k, prefilter=is_documentation if documentation else ~is_documentation)
        parts.append(part.select("chunk_id", "score", F.lit(documentation).alias("is_documentation")))
    return parts[0].unionByName(parts[1]).select("chunk_id", F.round("score", 6).alias("score"), "is_documentation")


@query("SELECT c.chunk_id, round(1 / (1 + list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))])), 6) AS score FROM g_chunks c JOIN embeddings q ON q.vec_id = 0")
def v14_euclidean_similarity(spark, sf_dir):
    both = derived.chunks(spark, sf_dir).join(F.broadcast(asked(spark, sf_dir).select(F.col("embedding").alias("q"))))
    return both.select("chunk_id", F.round(vectors.euclidean(F.col("embedding"), F.col("q")), 6).alias("score"))


@query("SELECT count(*) AS chunks, count(*) FILTER (len(embedding) = 64) AS fitting, count(*) FILTER (len(embedding) <> 64) AS failed, count(DISTINCT sha256(content)) AS distinct_texts FROM g_chunks")
def v13_v16_v17_vector_counts(spark, sf_dir):
    """Counts, the dimension check, and how many texts an embedding cache would hold."""
    right = F.size("embedding") == 64
    return derived.chunks(spark, sf_dir).agg(F.count(F.lit(1)).alias("chunks"), F.count(F.when(right, 1)).alias("fitting"), F.count(F.when(~right, 1)).alias("failed"), F.count_distinct(F.sha2("content", 256)).alias("distinct_texts"))


@query(f"WITH {SCORED}, t AS (SELECT * FROM s ORDER BY score DESC, chunk_id LIMIT 40), r AS (SELECT t.chunk_id, y.name, x.id, e.edge_type FROM t LEFT JOIN g_symbols x ON x.id = t.chunk_id LEFT JOIN g_edges e ON e.src = x.id LEFT JOIN g_symbols y ON y.id = e.dst) SELECT t.chunk_id, round(t.score, 6) AS score, x.name AS symbol, coalesce((SELECT string_agg(DISTINCT r.name || ':' || r.edge_type, ',' ORDER BY r.name || ':' || r.edge_type) FROM r WHERE r.chunk_id = t.chunk_id), '') AS related FROM t LEFT JOIN g_symbols x ON x.id = t.chunk_id")
def j4_unified_rag(spark, sf_dir):
    """The nearest chunks with their symbol and what it is related to."""
    best = retrieval.similar(derived.chunks(spark, sf_dir), asked(spark, sf_dir), 40).select("chunk_id", "score")
    names = derived.symbols(spark, sf_dir).select("id", "name")
    related = derived.edges(spark, sf_dir).join(names.select(F.col("id").alias("dst"), F.col("name").alias("other")), "dst")
    related = best.join(related, F.col("chunk_id") == F.col("src")).groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "other", "edge_type"))), ",").alias("related"))
    out = best.join(names.select(F.col("id").alias("chunk_id"), F.col("name").alias("symbol")), "chunk_id", "left").join(related, "chunk_id", "left")
    return out.select("chunk_id", F.round("score", 6).alias("score"), "symbol", F.coalesce("related", F.lit("")).alias("related"))


@query("WITH c AS (SELECT chunk_id, repo_id, lag(chunk_id) OVER w AS previous, lead(chunk_id) OVER w AS following FROM g_chunks WINDOW w AS (PARTITION BY repo_id, chunk_id // 100 ORDER BY chunk_id)) SELECT c.chunk_id, c.previous, c.following, s.name AS symbol FROM c LEFT JOIN g_symbols s ON s.id = c.chunk_id")
def j8_chunk_with_context(spark, sf_dir):
    """A hundred consecutive ids of a repository stand for a file."""
    from pyspark.sql import Window

    place = Window.partitionBy("repo_id", F.floor(F.col("chunk_id") / 100)).orderBy("chunk_id")
    rows = derived.chunks(spark, sf_dir).select("chunk_id", "repo_id").withColumns({"previous": F.lag("chunk_id").over(place), "following": F.lead("chunk_id").over(place)})
    return rows.join(derived.symbols(spark, sf_dir).select(F.col("id").alias("chunk_id"), F.col("name").alias("symbol")), "chunk_id", "left").drop("repo_id")


@query(f"WITH RECURSIVE {SCORED}, v AS (SELECT chunk_id FROM s ORDER BY score DESC, chunk_id LIMIT 20), u AS (SELECT src, dst FROM g_edges UNION SELECT dst, src FROM g_edges), r AS (SELECT chunk_id AS id, 0 AS depth FROM v WHERE chunk_id IN (SELECT id FROM g_symbols) UNION SELECT u.dst, r.depth + 1 FROM r JOIN u ON u.src = r.id WHERE r.depth < 2), n AS (SELECT id, min(depth) AS depth FROM r GROUP BY id) SELECT c.chunk_id, CAST(coalesce(n.depth, -1) AS INTEGER) AS distance, v.chunk_id IS NOT NULL AS by_vector FROM g_chunks c LEFT JOIN n ON n.id = c.chunk_id LEFT JOIN v ON v.chunk_id = c.chunk_id WHERE n.id IS NOT NULL OR v.chunk_id IS NOT NULL")
def v6_hybrid_search(spark, sf_dir):
    """The nearest chunks, and those of symbols within two hops of theirs."""
    chunks = derived.chunks(spark, sf_dir).select("chunk_id", "embedding")
    best = retrieval.similar(chunks, asked(spark, sf_dir), 20).select("chunk_id")
    symbols = derived.symbols(spark, sf_dir).select("id")
    near, _ = graph.traverse(derived.edges(spark, sf_dir), best.select(F.col("chunk_id").alias("id")).join(symbols, "id", "left_semi"), 2, "both")
    by_graph = near.select(F.col("id").alias("chunk_id"), F.col("depth").alias("distance")).join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    out = best.withColumn("by_vector", F.lit(True)).join(by_graph, "chunk_id", "full_outer")
    return out.select("chunk_id", F.coalesce("distance", F.lit(-1)).alias("distance"), F.coalesce("by_vector", F.lit(False)).alias("by_vector"))


FINAL = f"WITH {SCORED}, t AS (SELECT chunk_id, repo_id, language, content, score, false AS anchor FROM s ORDER BY score DESC, chunk_id LIMIT 60), a AS (SELECT chunk_id, repo_id, language, content, 0.5 AS score, true AS anchor FROM s WHERE repo_id = 'src1' AND chunk_id NOT IN (SELECT chunk_id FROM t)), m AS (SELECT * FROM t UNION ALL SELECT * FROM a), d AS (SELECT m.*, CASE WHEN e.src IS NOT NULL THEN 1 ELSE -1 END AS distance FROM m LEFT JOIN (SELECT DISTINCT src FROM g_calls) e ON e.src = m.chunk_id), f AS (SELECT chunk_id, floor(length(content) / 4) AS tokens, score + CASE WHEN distance >= 0 THEN 0.3 / (distance + 1) ELSE 0 END + CASE WHEN anchor THEN 0.2 ELSE 0 END + CASE WHEN repo_id = 'src1' AND language = 'en' THEN 0.1 WHEN repo_id = 'src1' THEN 0.05 ELSE 0 END AS final FROM d) "


def candidates(spark, sf_dir):
    settings = retrieval.Settings().checked()
    chunks = derived.chunks(spark, sf_dir)
    best = retrieval.similar(chunks, asked(spark, sf_dir), 60).withColumn("anchor", F.lit(False)).drop("embedding")
    anchors = chunks.where("repo_id = 'src1'").drop("embedding").withColumns({"score": F.lit(0.5), "anchor": F.lit(True)})
    callers = derived.calls(spark, sf_dir).select(F.col("src").alias("chunk_id")).distinct().withColumn("distance", F.lit(1))
    rows = retrieval.merged(best, anchors).join(callers, "chunk_id", "left").withColumn("distance", F.coalesce("distance", F.lit(-1)))
    path = F.concat_ws("/", "repo_id", "language")
    final = retrieval.final_score(settings, F.col("score"), F.col("distance"), F.col("anchor")) + retrieval.location_bonus(settings, path, "src1/en")
    return rows.select("chunk_id", scalars.tokens_by_length(F.col("content")).alias("tokens"), final.alias("final"))


@query(FINAL + "SELECT chunk_id, CAST(tokens AS BIGINT) AS tokens, round(final, 6) AS final FROM f")
def r1_ranked_candidates(spark, sf_dir):
    """Merged candidates with their final scores."""
    return candidates(spark, sf_dir).withColumn("final", F.round("final", 6))


@query(FINAL.replace("WITH ", "WITH RECURSIVE ", 1) + ", p AS (SELECT *, row_number() OVER (ORDER BY round(final, 6) DESC, chunk_id) AS place FROM f), r AS (SELECT place, chunk_id, tokens, true AS kept, tokens AS total FROM p WHERE place = 1 UNION ALL SELECT p.place, p.chunk_id, p.tokens, r.total + p.tokens <= 8000, CASE WHEN r.total + p.tokens <= 8000 THEN r.total + p.tokens ELSE r.total END FROM r JOIN p ON p.place = r.place + 1) SELECT chunk_id, CAST(tokens AS BIGINT) AS tokens FROM r WHERE kept")
def r10_first_fit_budget(spark, sf_dir):
    """In rank order, what still fits the budget stays."""
    ranked = candidates(spark, sf_dir).select("chunk_id", "tokens", F.round("final", 6).alias("final"))
    return retrieval.fitting(ranked, 8000, [F.desc("final"), F.col("chunk_id")]).select("chunk_id", "tokens")


@query("WITH r AS (SELECT repo_id, chunk_id, floor(length(content) / 4) AS tokens, sum(floor(length(content) / 4)) OVER (PARTITION BY repo_id ORDER BY chunk_id ROWS UNBOUNDED PRECEDING) AS running FROM g_chunks) SELECT repo_id, chunk_id, CAST(tokens AS BIGINT) AS tokens FROM r WHERE running <= 4000")
def r12_prefix_budget(spark, sf_dir):
    """Rows of each repository until the budget is used."""
    rows = derived.chunks(spark, sf_dir).select("repo_id", "chunk_id", scalars.tokens_by_length(F.col("content")).alias("tokens"))
    return retrieval.prefix_fitting(rows, 4000, ["chunk_id"], "repo_id").drop("running")


@query("WITH r AS (SELECT repo_id, chunk_id, content, CAST(floor(length(content) / 4) AS BIGINT) AS tokens FROM g_chunks), s AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY repo_id ORDER BY chunk_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - tokens AS before FROM r) SELECT repo_id, chunk_id, CASE WHEN tokens <= 4000 - before THEN tokens ELSE 4000 - before END AS tokens, sha256(CASE WHEN tokens <= 4000 - before THEN content ELSE substring(content, 1, 4 * (4000 - before)) END) AS digest FROM s WHERE tokens <= 4000 - before OR (before < 4000 AND 4000 - before > 100)")
def r13_truncating_budget(spark, sf_dir):
    rows = derived.chunks(spark, sf_dir).select("repo_id", "chunk_id", "content", scalars.tokens_by_length(F.col("content")).alias("tokens"))
    out = retrieval.truncated_fitting(rows, 4000, ["chunk_id"], "repo_id")
    return out.select("repo_id", "chunk_id", "tokens", F.sha2("content", 256).alias("digest"))


@query(r"WITH p AS (SELECT id, split_part(name, ' ', 1) AS a, split_part(name, ' ', 2) AS b FROM g_symbols), q AS (SELECT id, 'Does ' || chr(39) || a || chr(39) || ' of Use' || upper(b[1]) || b[2:] || 'Now call ' || b || '_id, or ' || upper(b[1]) || b[2:] || ' of ' || a || '?' AS q FROM p) SELECT id, array_to_string(list_concat(list_concat(regexp_extract_all(q, '\b([A-Z][0-9A-Za-z]*(?:[A-Z][0-9A-Za-z]*)+)\b', 1), regexp_extract_all(q, '\b([a-z][0-9a-z]*(?:_[0-9a-z]+)+)\b', 1)), list_concat(regexp_extract_all(q, '[\x27\x22]([A-Za-z_][0-9A-Za-z_]*)[\x27\x22]', 1), list_filter(regexp_extract_all(q, '\b([A-Z][a-z][0-9A-Za-z]*)\b', 1), lambda x: NOT regexp_matches(x[2:], '[A-Z]')))), ',') AS names FROM q")
def r16_names_in_questions(spark, sf_dir):
    """Names by how they are written: with inner capitals, underscores, in quotes, capitalised."""
    a, b = F.split("name", " ")[0], F.split("name", " ")[1]
    asked_for = F.concat(F.lit("Does '"), a, F.lit("' of Use"), F.initcap(b), F.lit("Now call "), b, F.lit("_id, or "), F.initcap(b), F.lit(" of "), a, F.lit("?"))
    return derived.symbols(spark, sf_dir).select("id", F.array_join(retrieval.names_in(asked_for), ",").alias("names"))


@query("SELECT conv_id, turn, array_to_string(list_slice(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda w: length(w) > 2 AND regexp_matches(w, '^[a-z_]') AND NOT list_contains(['the','a','an','is','are','was','were','be','been','being','have','has','had','do','does','did','will','would','could','should','function','class','method','module','file','code'], w)), 1, 5), ',') AS terms FROM conversations")
def r17_search_terms(spark, sf_dir):
    """The first five terms of each text."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(retrieval.search_terms(F.col("text"), 5), ",").alias("terms"))


@query("SELECT doc_id, round(sum(n * ln(1 + docs / h)), 6) AS score FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM documents) WHERE term IN ('licensed', 'version', 'token') GROUP BY doc_id, term) JOIN (SELECT term AS t2, count(DISTINCT doc_id) AS h FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM documents) GROUP BY term) ON t2 = term, (SELECT count(*) AS docs FROM documents) GROUP BY doc_id")
def v10_lexical_scores(spark, sf_dir):
    """The lexical side of hybrid retrieval."""
    docs = table(spark, sf_dir, "documents")
    return retrieval.lexical_scores(docs, ["licensed", "version", "token"], "text", "doc_id").withColumn("score", F.round("score", 6))


@query("WITH c AS (SELECT chunk_id, repo_id AS file_path, chunk_id AS start_line, chunk_id + 30 AS end_line FROM g_chunks), f AS (SELECT DISTINCT source AS file_path, doc_id + 5 AS line FROM documents WHERE lang = 'de'), i AS (SELECT DISTINCT c.chunk_id FROM c JOIN f ON f.file_path = c.file_path AND f.line BETWEEN c.start_line AND c.end_line), x AS (SELECT DISTINCT c.file_path FROM c JOIN i USING (chunk_id)), r AS (SELECT chunk_id, row_number() OVER (PARTITION BY file_path ORDER BY start_line, chunk_id) AS n FROM c WHERE file_path IN (SELECT file_path FROM f) AND file_path NOT IN (SELECT file_path FROM x)) SELECT chunk_id FROM i UNION ALL SELECT chunk_id FROM r WHERE n <= 3")
def j14_chunks_of_frames(spark, sf_dir):
    """A range join on one file, with a fallback."""
    chunks = derived.chunks(spark, sf_dir).select("chunk_id", F.col("repo_id").alias("file_path"), F.col("chunk_id").alias("start_line"), (F.col("chunk_id") + 30).alias("end_line"))
    stack = table(spark, sf_dir, "documents").where("lang = 'de'").select(F.col("source").alias("file_path"), (F.col("doc_id") + 5).alias("line")).distinct()
    return retrieval.chunks_of_frames(chunks, stack).select("chunk_id")


@query(f"WITH {SCORED}, t AS (SELECT chunk_id FROM s ORDER BY score DESC, chunk_id LIMIT 30), e AS (SELECT t.chunk_id, e.edge_type, y.name, row_number() OVER (PARTITION BY t.chunk_id, e.edge_type ORDER BY y.name, y.id) AS n FROM t JOIN g_edges e ON e.src = t.chunk_id JOIN g_symbols y ON y.id = e.dst) SELECT chunk_id, edge_type, string_agg(name, ',' ORDER BY n) AS names FROM e WHERE n <= 5 GROUP BY chunk_id, edge_type")
def v12_packets(spark, sf_dir):
    """For each hit and relation up to five related names."""
    from pyspark.sql import Window

    best = retrieval.similar(derived.chunks(spark, sf_dir), asked(spark, sf_dir), 30).select("chunk_id")
    names = derived.symbols(spark, sf_dir).select(F.col("id").alias("dst"), "name")
    rows = best.join(derived.edges(spark, sf_dir), F.col("chunk_id") == F.col("src")).join(names, "dst")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("chunk_id", "edge_type").orderBy("name", "dst"))).where("n <= 5")
    listed = F.array_sort(F.collect_list(F.struct("n", "name")))
    return rows.groupBy("chunk_id", "edge_type").agg(F.array_join(F.transform(listed, lambda x: x["name"]), ",").alias("names"))


@query(r"WITH d AS (SELECT doc_id, lower(source) AS s, CASE WHEN doc_id % 3 = 0 THEN 'elsewhere' WHEN doc_id % 3 = 1 THEN upper(source) ELSE source END AS n, doc_id % 7 AS k FROM documents), q AS (SELECT doc_id, [n || ' starts how?', 'What happens in ' || n || ' when it starts?', 'Is it from ' || n || '?', 'A fix for ' || n, 'See the ' || n || ' repository', 'Which ' || n || ' repo is it', 'Nothing of ' || n][k + 1] AS q FROM d), t AS (SELECT doc_id, unnest([1, 2, 3, 4, 5, 6]) AS rank, lower(unnest([regexp_extract(q, '^([-_a-zA-Z0-9]+)\s', 1), regexp_extract(q, '\bin\s+([-_a-zA-Z0-9]+)', 1), regexp_extract(q, '\bfrom\s+([-_a-zA-Z0-9]+)', 1), regexp_extract(q, '\bfor\s+([-_a-zA-Z0-9]+)', 1), regexp_extract(q, '\b([-_a-zA-Z0-9]+)\s+repository', 1), regexp_extract(q, '\b([-_a-zA-Z0-9]+)\s+repo\b', 1)])) AS name FROM q), f AS (SELECT doc_id, arg_min(name, rank) AS name FROM t WHERE name IN (SELECT lower(source) FROM documents) GROUP BY doc_id) SELECT q.doc_id, r.source AS repo_id FROM q LEFT JOIN f USING (doc_id) LEFT JOIN (SELECT DISTINCT source FROM documents) r ON lower(r.source) = f.name")
def l19_asked_repository(spark, sf_dir):
    """Questions of all forms, some about a repository that isn't there."""
    docs = table(spark, sf_dir, "documents")
    n = F.when(F.col("doc_id") % 3 == 0, "elsewhere").when(F.col("doc_id") % 3 == 1, F.upper("source")).otherwise(F.col("source"))
    forms = F.array(*(F.format_string(x, n) for x in ("%s starts how?", "What happens in %s when it starts?", "Is it from %s?", "A fix for %s", "See the %s repository", "Which %s repo is it", "Nothing of %s")))
    asked_for = docs.select("doc_id", F.get(forms, (F.col("doc_id") % 7).cast("int")).alias("question"))
    return retrieval.asked_repository(asked_for, "question", docs.select(F.col("source").alias("repo_id")), "doc_id")


@query(f"WITH {SCORED}, v AS (SELECT chunk_id AS id FROM s ORDER BY score DESC, chunk_id LIMIT 20) SELECT id, CAST(min(rank) AS INTEGER) AS rank FROM (SELECT v.id, 0 AS rank FROM v JOIN g_symbols y ON y.id = v.id UNION ALL SELECT id, 1 FROM g_symbols WHERE name = 'red plate' UNION ALL SELECT id, 2 FROM g_symbols WHERE regexp_matches(name, '(^| )ring( |$)')) GROUP BY id")
def r15_start_symbols(spark, sf_dir):
    """From the nearest chunks, then from names, then from terms."""
    symbols = derived.symbols(spark, sf_dir).select("id", "name")
    near = retrieval.similar(derived.chunks(spark, sf_dir), asked(spark, sf_dir), 20).select(F.col("chunk_id").alias("id"))
    return retrieval.start_symbols(near.join(symbols, "id", "left_semi"), symbols.where("name = 'red plate'"), symbols.where(F.array_contains(F.split("name", " "), "ring")))
