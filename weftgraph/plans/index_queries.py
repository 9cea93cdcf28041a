"""Indexes of vectors and texts, and the store, each after changes; and what they must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import retrieval, vector_index
from weftgraph.operators.text_index import TextIndex
from weftgraph.operators.vector_index import VectorIndex
from weftgraph.sources import derived
from weftgraph.sources.store import Store
from weftgraph.sources.tables import fresh_path, table, written

from .registry import query

COSINE = "list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / (sqrt(list_inner_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) * sqrt(list_inner_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[]))))"
QUESTIONS = "q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0)"


def rows(spark, sf_dir):
    """Vectors with a language."""
    langs = F.get(F.array(*map(F.lit, ("en", "de", "fr"))), (F.col("vec_id") % 3).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), langs.alias("language"), "embedding")


def questions(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def changed_index(spark, sf_dir):
    """Built on half of the rows, some of them later ones' vectors; then the others come, those are put right, and every seventh goes."""
    every = rows(spark, sf_dir)
    wrong = every.where("chunk_id % 4 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x))
    index = VectorIndex.create(spark, fresh_path(spark), wrong.unionByName(every.where("chunk_id % 4 = 1")))
    index.upsert(every.where("chunk_id % 4 <> 1"))
    index.delete(every.where("chunk_id % 7 = 3").select("chunk_id"))
    return index


@query(f"WITH {QUESTIONS}, s AS (SELECT query_id, vec_id AS chunk_id, {COSINE.format(a='c.embedding', b='q.e')} AS score FROM embeddings c, q WHERE vec_id % 7 <> 3 AND vec_id % 3 <> 1 AND vec_id <> query_id) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, chunk_id, round(score, 6) AS score FROM s QUALIFY rank <= 10")
def v1_v2_indexed_search(spark, sf_dir):
    """An index after upserts and deletions, all cells probed, with a condition on a column."""
    found = changed_index(spark, sf_dir).search(questions(spark, sf_dir), 10, probes=None, where=F.col("language") != "de", others=True)
    return found.withColumn("score", F.round("score", 6))


@query("SELECT count(*) AS questions, 10 * count(*) AS answers, true AS recall_of_nine_tenths FROM embeddings WHERE vec_id % 50 = 0")
def v11_probed_search(spark, sf_dir):
    """The share of the exact answers that are found with a part of the cells probed."""
    index = VectorIndex.create(spark, fresh_path(spark), rows(spark, sf_dir))
    asked = questions(spark, sf_dir)
    exact, some = (index.search(asked, 10, probes=p, others=True) for p in (None, max(8, len(index.centroids) * 3 // 4)))
    some = written(some)  # it is read twice
    reached = vector_index.recall(some, exact) >= 0.9
    return some.agg(F.count_distinct("query_id").alias("questions"), F.count(F.lit(1)).alias("answers")).withColumn("recall_of_nine_tenths", F.lit(reached))


def changed_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = TextIndex.create(spark, fresh_path(spark))
    index.update(docs.where("doc_id % 3 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.lit("another version of a token")).otherwise(F.col("text"))), "text")
    index.update(docs.where("doc_id % 3 = 0 OR doc_id % 5 = 0"), "text", removed=docs.where("doc_id % 11 = 7").select("doc_id"))
    return index


TEXTS = "d AS (SELECT doc_id, text FROM documents WHERE doc_id % 11 <> 7 OR doc_id % 3 = 0 OR doc_id % 5 = 0), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM d), n AS (SELECT doc_id, term, count(*) AS n FROM w WHERE term IN ('licensed', 'version', 'token') GROUP BY ALL), t AS (SELECT doc_id, sum(n * ln(1 + (SELECT count(*) FROM d) / h)) AS score FROM n JOIN (SELECT term, count(*) AS h FROM n GROUP BY term) USING (term) GROUP BY doc_id)"


@query(f"WITH {TEXTS} SELECT doc_id, round(score, 6) AS score FROM t")
def v10_indexed_scores(spark, sf_dir):
    """The text index after an update and removals agrees with a scan of what the texts are now."""
    return changed_texts(spark, sf_dir).search(["licensed", "version", "token"]).withColumn("score", F.round("score", 6))


@query(f"WITH {TEXTS}, v AS (SELECT vec_id AS doc_id, {COSINE.format(a='c.embedding', b='q.embedding')} AS score FROM embeddings c JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) q ON c.vec_id % 7 <> 3 ORDER BY score DESC, doc_id LIMIT 30), l AS (SELECT doc_id, score FROM t ORDER BY round(score, 9) DESC, doc_id LIMIT 30), u AS (SELECT doc_id, score / (SELECT max(score) FROM v) AS score FROM v UNION ALL SELECT doc_id, score / (SELECT max(score) FROM l) FROM l) SELECT doc_id, round(max(score), 6) AS score FROM u GROUP BY doc_id")
def v10_fused_retrieval(spark, sf_dir):
    """The best by vector and the best by words, each list in shares of its best, in one list."""
    asked = questions(spark, sf_dir).where("query_id = 0")
    near = changed_index(spark, sf_dir).search(asked, 30, probes=None).select(F.col("chunk_id").alias("doc_id"), "score")
    said = changed_texts(spark, sf_dir).search(["licensed", "version", "token"]).orderBy(F.desc(F.round("score", 9)), "doc_id").limit(30)
    return vector_index.fused(100, near, said, key="doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT o_orderkey AS id, o_orderstatus || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '+' END AS value, NOT o_orderkey % 2 = 0 AS again FROM orders WHERE o_orderkey % 5 <> 1")
def w4_landed_batches(spark, sf_dir):
    """Batches land in a store, one of them twice; upserts and deletions; the newest version."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("value"), F.lit(False).alias("again"))
    store = Store.create(spark, fresh_path(spark), orders.schema, ["id"], buckets=16)
    land = store.sink("orders")
    odd = orders.where("id % 2 = 1").select("id", F.concat("value", F.lit("+")).alias("value"), F.lit(True).alias("again"))
    for number, batch in ((0, orders), (1, odd), (0, orders), (1, orders)):  # the last two come again
        land(batch, number)
    store.delete(orders.where("id % 5 = 1").select("id"))
    return store.read()


@query("SELECT o_orderkey AS id, o_orderstatus AS value FROM orders WHERE o_orderkey % 3 = 0")
def w14_older_version(spark, sf_dir):
    """A version as it was before later upserts and deletions of documents, files, progress and sessions."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("value"))
    store = Store.create(spark, fresh_path(spark), orders.schema, ["id"], buckets=16)
    wanted = store.upsert(orders.where("id % 3 = 0"))
    store.upsert(orders.withColumn("value", F.lit("later")))
    store.delete_where(F.col("id") % 2 == 0)
    return store.read(wanted)


HITS = f"h AS (SELECT c.chunk_id, c.content, {COSINE.format(a='c.embedding', b='q.embedding')} AS score FROM g_chunks c JOIN embeddings q ON q.vec_id = 0 ORDER BY score DESC, chunk_id LIMIT 12), u AS (SELECT src, dst FROM g_edges UNION SELECT dst, src FROM g_edges), r AS (SELECT chunk_id AS start, chunk_id AS id, 0 AS depth FROM h WHERE chunk_id IN (SELECT id FROM g_symbols) UNION SELECT r.start, u.dst, r.depth + 1 FROM r JOIN u ON u.src = r.id WHERE r.depth < 2), n AS (SELECT start, id, min(depth) AS depth FROM r GROUP BY start, id)"


@query(f"WITH RECURSIVE {HITS} SELECT h.chunk_id, round(h.score, 6) AS score, left(h.content, 500) AS preview, coalesce((SELECT string_agg(DISTINCT s.name, ',' ORDER BY s.name) FROM n JOIN g_symbols s ON s.id = n.id WHERE n.start = h.chunk_id AND n.depth > 0), '') AS related FROM h")
def v8_search_packets(spark, sf_dir):
    """V8: hits with the beginning of their text and the names of all that is around them."""
    asked = questions(spark, sf_dir).where("query_id = 0")
    found = retrieval.search_packets(derived.chunks(spark, sf_dir), asked, derived.symbols(spark, sf_dir), derived.edges(spark, sf_dir), 12)
    return found.select("chunk_id", F.round("score", 6).alias("score"), "preview", F.array_join("related", ",").alias("related"))


@query(f"WITH RECURSIVE {HITS} SELECT h.chunk_id, coalesce((SELECT string_agg(id, ',' ORDER BY id) FROM n WHERE n.start = h.chunk_id AND n.depth = 1), '') AS first, coalesce((SELECT string_agg(id, ',' ORDER BY id) FROM n WHERE n.start = h.chunk_id AND n.depth = 2), '') AS second FROM h")
def v9_hits_with_neighbours(spark, sf_dir):
    """V9: hits with what is one edge and two edges away."""
    asked = questions(spark, sf_dir).where("query_id = 0")
    found = retrieval.hits_with_neighbours(derived.chunks(spark, sf_dir), asked, derived.symbols(spark, sf_dir), derived.edges(spark, sf_dir), 12)
    return found.select("chunk_id", F.array_join("first", ",").alias("first"), F.array_join("second", ",").alias("second"))


@query("WITH RECURSIVE r AS (SELECT id, 0 AS depth FROM g_symbols WHERE regexp_matches(name, '(^| )(ring|plate)( |$)') AND id % 20 < 3 UNION SELECT e.dst, r.depth + 1 FROM r JOIN g_edges e ON e.src = r.id WHERE r.depth < 2) SELECT src, dst, edge_type FROM g_edges WHERE src IN (SELECT id FROM r) AND dst IN (SELECT id FROM r)")
def r18_context_graph(spark, sf_dir):
    """The graph of what the start symbols of a question reach."""
    symbols = derived.symbols(spark, sf_dir).where("id % 20 < 3").select("id", "name")
    words = F.split("name", " ")
    starts = retrieval.start_symbols(*(symbols.where(F.array_contains(words, w)) for w in ("ring", "plate"))).select("id")
    return retrieval.context_graph(derived.edges(spark, sf_dir), starts, 2)
