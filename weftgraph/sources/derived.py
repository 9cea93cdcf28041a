"""A property graph, chunks and a DAG, derived from the relational tables.

Symbols are parts, files are paths made of brand, type and size, and two parts of one brand
on neighbouring lines of an order call each other. ``SQL`` has the same views for DuckDB.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, kind, file_path."""
    path = F.concat("p_brand", F.lit("/"), "p_type", F.lit("/"), F.col("p_size").cast("string"), F.lit(".py"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lower("p_type").alias("kind"), path.alias("file_path"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst; cycles are possible."""
    brand = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(brand, "l_partkey")
    lines = lines.select("l_orderkey", "l_linenumber", "p_brand", F.col("l_partkey").alias("src"))
    following = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), "p_brand", F.col("src").alias("dst"))
    return lines.join(following, ["l_orderkey", "l_linenumber", "p_brand"]).where("src <> dst").select("src", "dst").distinct()


def calls_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).where("dst > src")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir).select("file_path").distinct()


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: paths of files whose symbols call each other."""
    of = symbols(spark, sf_dir).select("id", "file_path")
    src = of.select(F.col("id").alias("src"), F.col("file_path").alias("a"))
    dst = of.select(F.col("id").alias("dst"), F.col("file_path").alias("b"))
    return calls(spark, sf_dir).join(src, "src").join(dst, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def extends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: each symbol extends the first of its name."""
    of = symbols(spark, sf_dir).select("id", "name")
    base = of.groupBy("name").agg(F.min("id").alias("dst"))
    return of.join(base, "name").where("id <> dst").select(F.col("id").alias("src"), "dst")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, edge_type of all symbol edges."""
    typed = ((calls, "CALLS"), (extends, "EXTENDS"))
    parts = [of(spark, sf_dir).withColumn("edge_type", F.lit(name)) for of, name in typed]
    return parts[0].unionByName(parts[1])


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, repo_id, language, content, embedding."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("repo_id"), F.col("lang").alias("language"), F.col("text").alias("content"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return docs.join(vectors, "chunk_id")


#: The same views for DuckDB; a later one may use an earlier one.
SQL = {
    "g_symbols": "SELECT p_partkey AS id, p_name AS name, lower(p_type) AS kind, concat(p_brand, '/', p_type, '/', CAST(p_size AS VARCHAR), '.py') AS file_path FROM part",
    "g_calls": "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 JOIN part p ON p.p_partkey = a.l_partkey JOIN part q ON q.p_partkey = b.l_partkey WHERE p.p_brand = q.p_brand AND a.l_partkey <> b.l_partkey",
    "g_calls_dag": "SELECT src, dst FROM g_calls WHERE dst > src",
    "g_files": "SELECT DISTINCT file_path FROM g_symbols",
    "g_imports": "SELECT DISTINCT x.file_path AS src, y.file_path AS dst FROM g_calls e JOIN g_symbols x ON x.id = e.src JOIN g_symbols y ON y.id = e.dst WHERE x.file_path <> y.file_path",
    "g_extends": "SELECT p.p_partkey AS src, m.base AS dst FROM part p JOIN (SELECT p_name, min(p_partkey) AS base FROM part GROUP BY p_name) m ON p.p_name = m.p_name WHERE p.p_partkey <> m.base",
    "g_edges": "SELECT src, dst, 'CALLS' AS edge_type FROM g_calls UNION ALL SELECT src, dst, 'EXTENDS' FROM g_extends",
    "g_chunks": "SELECT d.doc_id AS chunk_id, d.source AS repo_id, d.lang AS language, d.text AS content, e.embedding AS embedding FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id",
}


def with_views(sql: str) -> str:
    """``sql`` with the definitions of the views that it names before it."""
    needed: set[str] = set()

    def need(text: str) -> None:
        for name in re.findall(r"\bg_\w+", text):
            if name in SQL and name not in needed:
                needed.add(name)
                need(SQL[name])

    need(sql)
    views = ", ".join(f"{name} AS ({SQL[name]})" for name in SQL if name in needed)
    body = sql.strip()
    if not views:
        return body
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        return f"WITH {'RECURSIVE ' * recursive}{views}, {body[len('WITH RECURSIVE') if recursive else len('WITH'):]}"
    return f"WITH {views} {body}"


Source = Callable[[SparkSession, str], DataFrame]
