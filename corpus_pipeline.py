"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
Columns beyond those that the stages name are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import leaks, mixing, near, private, toxicity
from weftgraph.llm.tables import dropped, table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the model, learnt from the labelled ones, rejects. Null texts stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.score(docs, model, prefix="stage_").where("stage_predicted = 0").select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group (five-word shingles, similarity 0.8).

    Different texts of one doc_id are documents of their own, ordered by a hash. Of rows that
    repeat doc_id and text one stays, the first by its other columns; rows without an id all stay.
    """
    named, nameless = docs.where("doc_id IS NOT NULL"), docs.where("doc_id IS NULL")
    repeated = written(named.groupBy(F.col("doc_id").alias("stage_id")).count().where("count > 1").select("stage_id"))
    if repeated.isEmpty():
        kept = near.near_duplicates(named).where("kept").select(F.col("doc_id").alias("stage_id"))
        return named.join(kept, F.col("doc_id") == F.col("stage_id"), "left_semi").unionByName(nameless)

    again = named.join(repeated, F.col("doc_id") == F.col("stage_id"), "left_semi").withColumn("stage_key", F.xxhash64("doc_id", F.col("text").isNull(), "text"))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*rest)) if rest else F.lit("")
    again = written(again.groupBy("stage_key").agg(F.min_by(F.struct(*docs.columns), order).alias("stage_row")).select("stage_key", "stage_row.*"))
    once = named.join(repeated, F.col("doc_id") == F.col("stage_id"), "left_anti").withColumn("stage_key", F.col("doc_id").cast("long"))
    rows = once.unionByName(again)
    groups = near.near_duplicates(rows.select(F.col("stage_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("stage_key"), "component_id")
    first = groups.join(rows.select("stage_key", "doc_id"), "stage_key").groupBy("component_id").agg(F.min(F.struct("doc_id", "stage_key")).alias("first"))
    kept = written(first.select(F.col("first.stage_key").alias("stage_key")))
    return rows.join(kept, "stage_key", "left_semi").select(*docs.columns).unionByName(nameless)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item within its edit budget."""
    found = leaks.find(docs, table(spark, sf_dir, "benchmark"), column="stage_leaks", every=False)
    return found.where(F.size("stage_leaks") == 0).select(*docs.columns)


def without_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the names of its kinds; n_chars follows the text."""
    out = private.redact(private.find(docs, column="stage_private"), column="stage_private")
    return (out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, and how many of their words, repeats counted."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_leaks),
    ("private_data", without_private_data),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        out = written(stage(spark, docs, sf_dir))
        dropped(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learnt scores and hashes that DuckDB doesn't have decide here; tests compare with brute force.
ORACLE_SQL = None
