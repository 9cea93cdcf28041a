"""The pipeline's stages on the smallest tables, each judged on its own input."""

import os

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    seen = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, FOLDER)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.count())
        if name == "decontamination":
            assert not [r for r in docs.collect() if any(i in r["text"] for i in items)]
            gone = before.join(docs, "doc_id", "left_anti").collect()
            assert gone and all(any(i[10:60] in r["text"] for i in items) for r in gone)
        if name == "private_data":
            assert docs.where(F.col("text").rlike(r"[a-z]@mail[0-9]\.example")).count() == 0
            assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
        if name == "mixing":
            assert docs.where("taken > 2 * size OR taken <= 0").count() == 0
    assert all(a >= b > 0 for a, b in zip(seen, seen[1:], strict=False)) and seen[4] > 0.7 * seen[0]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_run_agrees_with_the_stages(spark):
    one, two = (sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).select("doc_id", "taken").collect())) for _ in range(2))
    assert one == two and one


def test_stages_on_odd_rows(spark, tmp_path):
    rows = [(1, None), (1, None), (2, ""), (3, "a b c d e f"), (4, "a b c d e f"), (None, "x"), (5, "mail me@x.org")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(1).cast("long").alias("n_chars"), F.lit("y").alias("score"))
    spark.createDataFrame([(9, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing like this at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert "score" in docs.columns
    left = {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert left == {(1, None), (2, ""), (3, "a b c d e f"), (None, "x"), (5, "mail [EMAIL]")}
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0


def test_different_texts_of_one_id_all_stay(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(7, a, "z"), (7, b, "y"), (7, b, "x"), (7, None, "n"), (7, "", "e"), (9, a + " end", "w"), (3, c, "v"), (7, c, "u"), (8, c + " d", "t"), (None, a, "s")]
    for n in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(n)
        out = corpus_pipeline.without_near_duplicates(spark, docs, "")
        assert {tuple(r) for r in out.collect()} == {rows[k] for k in (0, 2, 3, 4, 6, 9)} and out.count() == 6
