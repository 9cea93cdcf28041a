"""What tasks hold and what is shuffled when files are many or long."""

import pyarrow as pa
from pyspark.sql import functions as F

from weftgraph.operators import code, text, text_index
from weftgraph.operators.files import CHARACTERS, ROWS, in_batches
from weftgraph.plans import code_queries

FILES = "file_path string, content string"


def test_results_leave_a_few_at_a_time():
    names = pa.schema([("path", pa.string()), ("k", pa.int32())])
    rows = pa.RecordBatch.from_pylist([{"path": str(n), "n": 700} for n in range(9)])
    made = list(in_batches([rows, rows], lambda path, n: ({"path": path, "k": k} for k in range(n)), names))
    assert max(b.num_rows for b in made) <= ROWS and sum(b.num_rows for b in made) == 2 * 9 * 700
    long = pa.RecordBatch.from_pylist([{"text": "x" * CHARACTERS}] * 3)
    assert [b.num_rows for b in in_batches([long], lambda text: [{"path": text[:1], "k": 1}], names)] == [1, 1, 1]


def test_a_small_table_is_many_tasks(spark):
    files = spark.createDataFrame([(f"{k}.x", "") for k in range(50)], FILES).coalesce(1)
    for read in (code.python_symbols, code.python_relations, code.script_symbols, code.script_relations):
        assert read(files).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_texts_of_scripts_are_made_in_many_tasks(spark):
    for files in (code_queries.script_files, code_queries.nested_files):
        assert files(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_chunks_are_made_without_rows_of_lines(spark):
    content = "a = 1\n\ndef f(x):\n" + "".join(f"    if x == {k}:\n        {'y' * (k % 7 * 40 + 1)}\n" for k in range(30)) + "b = 2"
    files = spark.createDataFrame([("a.py", content), ("b.py", None), ("c.py", "x = 1"), ("c.py", "x = 1")], FILES)
    chunks = code.code_chunks(files, code.python_symbols(files))
    out = code.fitted_chunks(chunks, 50)
    assert "explode" not in out._jdf.queryExecution().toString()
    rows = sorted((r["file_path"], r["start_line"], r["end_line"], r["symbol"], r["content"]) for r in out.where("symbol IS NULL OR symbol = 'f'").fillna("", ["symbol"]).collect())
    assert [r[1:] for r in rows if r[0] == "c.py"] == [(1, 1, "", "x = 1")] * 2
    of_a = [r for r in rows if r[0] == "a.py"]
    assert "\n".join(r[4] for r in of_a if r[1] <= r[2]).replace("\n", "") == content.replace("\n", "")
    assert sum(r[3] == "f" for r in of_a) == 1 and max(len(r[4]) // 4 for r in of_a) <= 50


def test_a_summary_splits_a_text_once(spark):
    df = spark.createDataFrame([(1, "Short."), (2, None), (3, " " * 120), (4, "One. Two. " + "Plain words go here. " * 20 + "The api stays. " + "More. " * 9)], "id int, text string")
    out = df.select("id", text.summary(F.col("text")).alias("s"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    got = {r["id"]: r["s"] for r in out.collect()}
    assert got[1] == "Short." and got[2] is None and got[3] == " " * 120
    assert got[4] == "One. Two. " + "Plain words go here. " * 10 + "The api stays."


def test_terms_are_counted_a_few_documents_at_a_time(spark, tmp_path, monkeypatch):
    docs = [{"doc_id": k, "length": k % 5, "words": [f"w{(k * j) % 3}" for j in range(k % 5)]} for k in range(1000)]
    made = list(text_index.counted_terms([pa.RecordBatch.from_pylist(docs)], "doc_id"))
    assert len(made) == 1000 // text_index.DOCUMENTS
    got = {(r["doc_id"], r["term"]): (r["n"], r["length"]) for b in made for r in b.to_pylist()}
    assert got == {(d["doc_id"], w): (d["words"].count(w), d["length"]) for d in docs for w in d["words"]}

    index = text_index.TextIndex.create(spark, str(tmp_path / "t"), buckets=2)
    plans = []
    append = index.postings.append
    monkeypatch.setattr(index.postings, "append", lambda rows: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or append(rows))
    index.update(spark.createDataFrame([(1, "a b a"), (2, None)], "doc_id long, text string"), "text")
    assert "Aggregate" not in plans[0] and sorted(r["n"] for r in index.postings.read().collect()) == [1, 2]
