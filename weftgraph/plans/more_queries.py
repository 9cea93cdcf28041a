"""Queries of operators that earlier ones share or leave out: data flow, contracts, uncovered lines, evidence without hot terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import analysis, state
from weftgraph.sources import derived
from weftgraph.sources.tables import table

from .registry import query


def like(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


STEP = f"CASE WHEN {like('s.name', analysis.PERSIST)} OR {like('s.file_path', analysis.PERSIST)} OR {like('s.kind', analysis.PERSIST)} THEN 'persist' WHEN {like('s.name', analysis.RETURN)} OR {like('s.kind', analysis.RETURN)} THEN 'return' ELSE 'process' END"


@query(f"WITH RECURSIVE r AS (SELECT id AS entry, id, 0 AS depth FROM g_symbols WHERE id % 50 = 7 UNION SELECT r.entry, e.dst, r.depth + 1 FROM r JOIN g_calls e ON e.src = r.id WHERE r.depth < 3), d AS (SELECT entry, id, min(depth) AS depth FROM r GROUP BY entry, id) SELECT d.entry, row_number() OVER (PARTITION BY d.entry ORDER BY d.depth, d.id) - 1 AS position, d.id, s.name, CAST(d.depth AS INTEGER) AS depth, CASE WHEN d.depth = 0 THEN 'entry' ELSE {STEP} END AS step, max(d.depth) OVER (PARTITION BY d.entry) >= 3 AS truncated FROM d JOIN g_symbols s ON s.id = d.id")
def l4_data_flow(spark, sf_dir):
    """L4: what entry points call, step by step, each with its type."""
    nodes = derived.symbols(spark, sf_dir).select("id", "name", "file_path", F.col("kind").alias("doc"))
    return analysis.data_flow(nodes, derived.calls(spark, sf_dir), nodes.where("id % 50 = 7").select("id"), 3)


EVIDENCE = "e AS (SELECT doc_id % 400 AS item, unnest(['all', 'h' || doc_id % 3, 'm' || length(text) % 40, 'r' || doc_id % 97]) AS term FROM documents)"


def evidence(spark, sf_dir):
    n = F.col("doc_id")
    terms = F.array(F.lit("all"), F.concat(F.lit("h"), (n % 3).cast("string")), F.concat(F.lit("m"), (F.length("text") % 40).cast("string")), F.concat(F.lit("r"), (n % 97).cast("string")))
    return table(spark, sf_dir, "documents").select((n % 400).alias("item"), F.explode(terms).alias("term"))


@query(f"WITH {EVIDENCE}, d AS (SELECT DISTINCT item, term FROM e) SELECT a.item AS a, b.item AS b, count(*) AS n, round(CAST(least(1.0, 0.7 + 0.1 * count(*)) AS DOUBLE), 6) AS confidence FROM d a JOIN d b ON a.term = b.term AND a.item < b.item GROUP BY a.item, b.item HAVING count(*) >= 4")
def l11_j20_several_terms(spark, sf_dir):
    """Pairs that share four terms; one term is everybody's, and makes no pairs."""
    rows = evidence(spark, sf_dir)
    return analysis.related_pairs(rows.select("item").distinct(), rows, 4).withColumn("confidence", F.round("confidence", 6))


@query("SELECT p_partkey AS id, CASE WHEN regexp_matches(lower(t), 'proto|grpc') THEN 'grpc' WHEN regexp_matches(lower(t), 'openapi|swagger|http|rest|api') THEN 'rest' ELSE 'dependency' END AS kind FROM (SELECT p_partkey, p_name || ' ' || ['see Http', 'a.Proto file', 'none', 'via grpc and rest'][p_partkey % 4 + 1] AS t FROM part)")
def j20_relation_kinds(spark, sf_dir):
    """What kind of relation the evidence tells of."""
    more = F.get(F.array(*map(F.lit, ("see Http", "a.Proto file", "none", "via grpc and rest"))), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), analysis.relation_kind(F.array("p_name", more)).alias("kind"))


RELATED = "k AS (SELECT o_orderkey % 200 AS source, o_custkey % 200 AS target, min(CASE o_orderkey % 3 WHEN 0 THEN 'rest' WHEN 1 THEN 'grpc' ELSE 'dependency' END) AS kind FROM orders WHERE o_orderkey % 11 = 0 GROUP BY ALL)"


def related(spark, sf_dir):
    n = F.col("o_orderkey")
    kind = F.when(n % 3 == 0, "rest").when(n % 3 == 1, "grpc").otherwise("dependency")
    return table(spark, sf_dir, "orders").where(n % 11 == 0).groupBy((n % 200).alias("source"), (F.col("o_custkey") % 200).alias("target")).agg(F.min(kind).alias("kind"))


@query(f"WITH {RELATED}, c AS (SELECT DISTINCT p_partkey % 200 AS repo FROM part WHERE p_size < 3) SELECT source, target, kind, CASE WHEN a.repo IS NOT NULL THEN 'no_consumer_contracts' ELSE 'no_provider_contracts' END AS gap, CASE WHEN a.repo IS NOT NULL THEN 'medium' ELSE 'high' END AS severity FROM k LEFT JOIN c a ON a.repo = source LEFT JOIN c b ON b.repo = target WHERE kind <> 'dependency' AND (a.repo IS NULL) <> (b.repo IS NULL)")
def l12_contract_gaps(spark, sf_dir):
    """Relations of which only one side has contracts."""
    contracts = table(spark, sf_dir, "part").where("p_size < 3").select((F.col("p_partkey") % 200).alias("repo"), F.col("p_name").alias("title"))
    return analysis.contract_gaps(related(spark, sf_dir), contracts)


@query(f"WITH {RELATED}, r AS (SELECT p_partkey % 200 AS repo, p_partkey AS risk_id, ['critical', 'High', 'low', 'medium'][p_size % 4 + 1] AS severity FROM part), w AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY risk_id) AS n FROM r WHERE lower(severity) IN ('critical', 'high')) SELECT k.source AS upstream, k.target AS downstream, w.risk_id, w.severity FROM (SELECT DISTINCT source, target FROM k) k JOIN w ON w.repo = k.source WHERE n <= 3")
def l12_dependency_issues(spark, sf_dir):
    """The first three grave risks of what a repository depends on."""
    level = F.get(F.array(*map(F.lit, ("critical", "High", "low", "medium"))), (F.col("p_size") % 4).cast("int"))
    risks = table(spark, sf_dir, "part").select((F.col("p_partkey") % 200).alias("repo"), F.col("p_partkey").alias("risk_id"), level.alias("severity"))
    return analysis.dependency_issues(related(spark, sf_dir), risks)


@query("WITH r AS (SELECT l_orderkey % 50 AS k, l_orderkey AS first, l_orderkey + 12 * l_linenumber AS last FROM lineitem WHERE l_partkey % 3 = 0), b AS (SELECT o_orderkey % 50 AS k, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders GROUP BY 1), s AS (SELECT k, first, last, low, high, max(last) OVER (PARTITION BY k ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM r JOIN b USING (k) WHERE last >= low AND first <= high), g AS (SELECT k, greatest(coalesce(reached + 1, low), low) AS first, first - 1 AS last FROM s UNION ALL SELECT b.k, greatest(coalesce(max(s.last) + 1, b.low), b.low), b.high FROM b LEFT JOIN s USING (k) GROUP BY b.k, b.low, b.high) SELECT k, first, last FROM g WHERE first <= last")
def n6_uncovered_ranges(spark, sf_dir):
    """What overlapping ranges leave uncovered within bounds."""
    ranges = table(spark, sf_dir, "lineitem").where("l_partkey % 3 = 0").select((F.col("l_orderkey") % 50).alias("k"), F.col("l_orderkey").alias("first"), (F.col("l_orderkey") + 12 * F.col("l_linenumber")).alias("last"))
    bounds = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 50).alias("k")).agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))
    return state.uncovered(bounds, ranges, "k")
