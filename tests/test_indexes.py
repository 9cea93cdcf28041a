"""The vector index and the text index against scans, before and after changes."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weftgraph.operators import retrieval
from weftgraph.operators.text_index import TextIndex
from weftgraph.operators.vector_index import ROWS, VectorIndex, _open_pairs, fused, recall, sliced

SCHEMA = "chunk_id long, language string, embedding array<double>"


def vectors(r, n, first=0):
    centres = [[r.gauss(0, 1) for _ in range(12)] for _ in range(9)]
    return [(first + k, r.choice(["en", "de"]), [x + r.gauss(0, 0.5) for x in r.choice(centres)]) for k in range(n)]


def scan(rows, asked, k, keep=lambda r: True, others=False):
    out = []
    for q, _, v in asked:
        scored = [(-float(np.dot(v, e) / (np.linalg.norm(v) * np.linalg.norm(e))), i) for i, lang, e in rows if e and len(e) == 12 and any(e) and keep((i, lang)) and not (others and i == q)]
        out += [(q, rank, i) for rank, (_, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def found(out):
    return sorted((x["query_id"], x["rank"], x["chunk_id"]) for x in out.collect())


def test_searches_are_those_of_a_scan(spark, tmp_path):
    r = random.Random(1)
    rows = vectors(r, 400)
    rows += [(900, "en", None), (901, "en", [0.0] * 12), (902, "en", [1.0]), (903, "de", rows[3][2])]
    index = VectorIndex.create(spark, str(tmp_path / "v"), spark.createDataFrame(rows, SCHEMA), cells=20)
    asked = rows[:400:29] + [(777, "en", [r.gauss(0, 1) for _ in range(12)])]
    questions = spark.createDataFrame([(i, v) for i, _, v in asked] + [(5000, None), (5001, [0.0] * 12)], "query_id long, embedding array<double>")
    exact = index.search(questions, 10, probes=None)
    assert found(exact) == scan(rows, asked, 10)
    assert found(index.search(questions, 7, probes=None, where=F.col("language") == "de", others=True)) == scan(rows, asked, 7, lambda x: x[1] == "de", others=True)
    some = index.search(questions, 10, probes=5)
    assert recall(some, exact) >= 0.9 and recall(index.search(questions, 10, probes=1), exact) < 1
    touched = index.store.read(buckets=[0]).count()
    assert 0 < touched < 200 and index.store.read().count() == 401

    moved = [(k, "en", [-x for x in v]) for k, _, v in rows[:50]] + vectors(r, 60, first=2000) + [(60, "en", None)]
    index.upsert(spark.createDataFrame(moved, SCHEMA))
    index.delete(spark.createDataFrame([(k,) for k in range(100, 140)], "chunk_id long"))
    now = {x[0]: x for x in rows} | {x[0]: x for x in moved}
    now = [x for k, x in now.items() if not 100 <= k < 140]
    again = VectorIndex(spark, str(tmp_path / "v"))
    assert found(again.search(questions, 10, probes=None)) == scan(now, asked, 10)


def test_an_index_of_nothing(spark, tmp_path):
    index = VectorIndex.create(spark, str(tmp_path / "v"), spark.createDataFrame([], SCHEMA))
    assert index.search(spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>"), 3).count() == 0


def scanned(spark, texts, terms):
    df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    return {x["doc_id"]: round(x["score"], 9) for x in retrieval.lexical_scores(df, terms, "text", "doc_id").collect()}


def test_the_text_index_agrees_with_the_scan(spark, tmp_path):
    r, index = random.Random(2), TextIndex.create(spark, str(tmp_path / "t"), buckets=8)
    say = lambda: " ".join(r.choice(["Alpha", "beta", "gamma-delta", "x_1", "the"]) for _ in range(r.randrange(12)))
    frame = lambda texts: spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    texts = {k: say() for k in range(60)} | {60: None}
    index.update(frame(texts), "text")
    ask = lambda **how: {x["doc_id"]: round(x["score"], 9) for x in index.search(["alpha", "X_1", "nothing"], **how).collect()}
    assert ask() == scanned(spark, texts, ["alpha", "x_1"])
    for _ in range(2):
        some = {r.randrange(80): say() for _ in range(20)}
        gone = [r.randrange(60) for _ in range(5)]
        index.update(frame(some), "text", removed=spark.createDataFrame([(g,) for g in gone if g not in some], "doc_id long"))
        texts = {k: v for k, v in texts.items() if k not in gone} | some
        assert ask() == scanned(spark, texts, ["alpha", "x_1"])
    before = index.postings.read().count()
    index.compact()
    assert ask() == scanned(spark, texts, ["alpha", "x_1"]) and index.postings.read().count() < before
    assert set(ask(measure="bm25")) == set(ask())


def test_an_update_that_breaks_off_is_not_seen(spark, tmp_path, monkeypatch):
    index = TextIndex.create(spark, str(tmp_path / "t"), buckets=4)
    index.update(spark.createDataFrame([(1, "alpha"), (2, "beta")], "doc_id long, text string"), "text")

    def crash(*_, **__):
        raise OSError

    with monkeypatch.context() as broken:
        broken.setattr(index.documents, "upsert", crash)
        try:
            index.update(spark.createDataFrame([(1, "beta"), (3, "alpha")], "doc_id long, text string"), "text")
        except OSError:
            pass
    assert [x["doc_id"] for x in index.search(["alpha"]).collect()] == [1]


def test_fusion_takes_the_best_share(spark):
    a = spark.createDataFrame([(1, 4.0), (2, 2.0), (3, 1.0)], "chunk_id long, score double")
    b = spark.createDataFrame([(3, 0.5), (2, 0.4), (4, 0.1)], "chunk_id long, score double")
    assert [(x["chunk_id"], x["score"], x["rank"]) for x in fused(3, a, b).orderBy("rank").collect()] == [(1, 1.0, 1), (3, 1.0, 2), (2, 0.8, 3)]
    assert [(x["chunk_id"], round(x["score"], 6)) for x in fused(2, a, b, how="sum", weights=[0.5, 1]).orderBy("rank").collect()] == [(3, 1.125), (2, 1.05)]


def test_few_pairs_are_open_before_a_bar_is_known():
    """The first rows of a task meet no bar; they still don't all become exact pairs."""
    random_ = np.random.default_rng(3)
    x, q, k = random_.normal(size=(3000, 12)), random_.normal(size=(40, 12)), 5
    step = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / step[:, None]).astype(np.int8)
    rows = pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(step)], ["code", "step"])
    parts = list(sliced([rows]))
    assert max(p.num_rows for p in parts) == ROWS and sum(p.num_rows for p in parts) == 3000
    own = [n if n < 40 else -1 for n in range(3000)]
    row, one = _open_pairs(rows, x, q, np.ones((3000, 40), bool), own, np.full(40, -np.inf), k)
    score = x @ q.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(q, axis=1)
    score[np.arange(40), np.arange(40)] = -np.inf
    assert len(row) < 40 * 60 and not any(r == o for r, o in zip(row, one))
    for o in range(40):
        assert set(np.argsort(-score[:, o])[:k]) <= set(row[one == o])
