"""The engine's access point, guarded SQL, source files, and views."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftgraph.engine import Engine, guarded
from weftgraph.operators import code, index, retrieval, views
from weftgraph.operators.retrieval import Settings
from weftgraph.operators.text_index import TextIndex
from weftgraph.operators.vector_index import VectorIndex

SOURCE = '''import os
from . import util

X = 1


class Base(Thing):
    """Doc."""

    @cached
    def run(self, a, *, b=2):
        if a:
            return helper(a)
        for x in b:
            pass

    def _hidden(self):
        def inner():
            return 1
        return inner()


async def main(argv):
    await Base().run(argv)
'''


@pytest.fixture(scope="module")
def engine(spark):
    nodes = spark.createDataFrame([(1, "load", "function", "a/x.py"), (2, "save", "function", "a/y.py"), (3, "Store", "class", "b/z.py")], "id long, name string, kind string, file_path string")
    edges = spark.createDataFrame([(1, 2, "CALLS"), (2, 3, "CALLS"), (3, 1, "EXTENDS")], "src long, dst long, edge_type string")
    chunks = spark.createDataFrame([(1, "x", [1.0, 0.0]), (2, "y", [0.0, 1.0])], "chunk_id long, content string, embedding array<double>")
    return Engine(nodes, edges, chunks)


def test_tools(engine):
    assert engine.call("node", id=1).first()["name"] == "load"
    assert [r["id"] for r in engine.call("find", name="LOAD").collect()] == [1]
    assert {r["id"]: r["depth"] for r in engine.call("reachable", ids=[1], types=["CALLS"]).collect()} == {1: 0, 2: 1, 3: 2}
    assert list(engine.call("path", start=1, end=3, directed=True).first()["path"]) == [1, 2, 3]
    assert {r["id"] for r in engine.call("references", name="save").collect()} == {1}
    assert engine.call("search", vector=[1, 0], top=1).first()["chunk_id"] == 1
    files = engine.nodes.select(F.concat(F.lit("file:"), "file_path").alias("id"), F.col("file_path").alias("name"), F.lit("file").alias("kind"), "file_path")
    imports = engine.nodes.sparkSession.createDataFrame([("file:a/x.py", "file:b/z.py", "IMPORTS"), ("file:a/y.py", "file:a/x.py", "IMPORTS"), ("file:a/x.py", "file:a/y.py", "CONTAINS")], "src string, dst string, edge_type string")
    related = Engine(files, imports)
    assert {tuple(r) for r in related.call("related_files", file_path="a/x.py").collect()} == {("b/z.py", "imports"), ("a/y.py", "imported_by")}
    assert [r["file_path"] for r in related.call("related_files", file_path="a/x.py", relation="imports").collect()] == ["b/z.py"]
    assert related.call("related_files", file_path="none.py").isEmpty()
    with pytest.raises(ValueError):
        related.call("related_files", file_path="a/x.py", relation="odd")
    assert "Calls: save" in engine.call("packets", ids=[1]).first()["text"]
    assert {(r["key"], r["value"]) for r in engine.call("statistics").where("metric = 'edges'").collect()} == {("CALLS", 2), ("EXTENDS", 1)}
    with pytest.raises(KeyError):
        engine.call("drop")


def test_register_of_tools(engine):
    schema = engine.schemas()
    assert len(schema) >= 22 and schema["find"]["arguments"]["name"]["required"] and schema["find"]["arguments"]["most"]["default"] == 20
    engine.register(lambda: engine.nodes, "everything")
    assert engine.call("everything").count() == 3 and engine.unregister("everything") and not engine.unregister("everything")


def test_settings_hold_their_ranges_and_come_back():
    held = Settings(top_k_vector=0, max_depth=10**6, similarity_threshold=7, similarity_function="odd").checked()
    assert (held.top_k_vector, held.max_depth, held.similarity_threshold, held.similarity_function) == (5, 100, 1.0, "cosine")
    assert Settings.of_json(held.to_json()) == held and Settings.of_json('{"max_depth": 3, "new": 1}').max_depth == 3


def test_calls_are_traced(engine):
    assert [list(r["path"]) for r in engine.trace("load").collect()] == [[1, 2, 3]]
    assert [list(r["path"]) for r in engine.trace("TOR", "incoming").collect()] == [[3, 2, 1]]
    assert engine.trace("nobody").count() == 0
    assert engine.flow("load", "Store").first()["flow"] == "load -> save -> Store"
    with pytest.raises(ValueError):
        engine.trace("load", "sideways")


def test_views(engine):
    lines = {r["line"].strip() for r in engine.view("calls").collect()}
    assert {"1 --> 2", "2 --> 3"} <= lines and len(lines) == 5
    assert engine.view("call_chain", symbol="sa").count() == 3 and engine.view("hotspots").count() == 0
    assert {r["line"].strip() for r in engine.view("full", folder="a/").collect()} >= {"1 --> 2"}
    for bad in ({"kind": "odd"}, {"kind": "call_chain"}, {"kind": "full", "folder": "zzz"}):
        with pytest.raises(ValueError):
            engine.view(**bad)


def test_sections_of_an_analysis(engine):
    rows = {(r["section"], r["name"]) for r in engine.analysis().collect()}
    assert ("concept", "Store") in rows
    assert {r["metric"]: r["value"] for r in engine.statistics().where("metric = 'depth'").collect()} == {"depth": 2}
    assert [(r["folder"], r["files"], r["imports"]) for r in engine.architecture().collect()] == [("a", 2, 0), ("b", 1, 0)]
    assert engine.symbol_details("save").first()["total"] == 2


def test_queries_read_only_what_is_given(engine):
    assert engine.query("select count(*) as n from nodes where name <> '{x}'").first()["n"] == 3
    assert engine.query("with a as (select src as update from edges) select * from a join nodes n on n.id = a.update", 2).count() == 2
    for bad in ("select * from parquet.`/tmp/x`", "select * from other", "select * from default.nodes", "show tables", "with a as (select 1) update x set y = 1"):
        with pytest.raises(ValueError):
            engine.query(bad)


REPO = {
    "app/main.py": "from app.store import Shop\nimport os\n\n\ndef main():\n    shop = Shop()\n    return load_all(shop)\n\n\ndef load_all(shop):\n    return shop.fetch_items()\n",
    "app/store.py": "class Shop(Base):\n    def fetch_items(self):\n        return []\n\n\nclass Base:\n    pass\n",
    "web/a.ts": "import { b } from './b';\nexport class Page extends View {\n}\n",
    "web/b.ts": "export const b = (x) => x\n",
    "README.md": "# One\ntext\n\n# Two\nmore",
    "bad.py": "def (",
}
LANGUAGES = {"py": "python", "ts": "typescript", "md": "markdown"}


@pytest.fixture(scope="module")
def indexed(spark):
    rows = [(p, LANGUAGES[p.rpartition(".")[2]], t) for p, t in REPO.items()]
    return spark.createDataFrame(rows, "file_path string, language string, content string")


def test_index_of_files(indexed):
    made = index.index_files(indexed)
    nodes = {r["id"]: r["kind"] for r in made.nodes.collect()}
    assert nodes["file:app/main.py"] == "file" and nodes["dir:app"] == "directory" and nodes["app/store.py:Shop:class:1"] == "class" and "file:bad.py" in nodes
    edges = {(r["src"].split(":")[-3] if r["src"].count(":") > 2 else r["src"], r["dst"].split(":")[-3] if r["dst"].count(":") > 2 else r["dst"], r["edge_type"]) for r in made.edges.collect()}
    assert {("file:app/main.py", "file:app/store.py", "IMPORTS"), ("file:web/a.ts", "file:web/b.ts", "IMPORTS"), ("main", "load_all", "CALLS"), ("main", "Shop", "CALLS"), ("load_all", "fetch_items", "CALLS"), ("Shop", "Base", "EXTENDS"), ("dir:app", "file:app/main.py", "CONTAINS"), ("repo", "dir:app", "CONTAINS")} <= edges
    chunks = {(r["file_path"], r["symbol"]) for r in made.chunks.collect()}
    assert {("app/main.py", "main"), ("app/store.py", "fetch_items"), ("README.md", None)} <= chunks
    again = index.index_files(indexed, done=made.files)
    assert again.files.count() == 0 and again.nodes.count() == 0
    changed = indexed.withColumn("content", F.when(F.col("file_path") == "README.md", "# New").otherwise(F.col("content")))
    assert [r["file_path"] for r in index.index_files(changed, done=made.files).files.collect()] == ["README.md"]


def test_retrieval_of_a_question(spark, indexed):
    engine = Engine.of_files(indexed, Settings(top_k_vector=5))
    place = F.dense_rank().over(Window.orderBy("chunk_id"))
    engine.chunks = engine.chunks.withColumn("embedding", F.array(F.sin(place), F.cos(place)))
    found = engine.retrieve("What does load_all do?", [0.0, 1.0], current_file="app/main.py").collect()
    by_path = {r["file_path"] for r in found}
    assert any(r["anchor"] and r["file_path"] == "app/main.py" for r in found) and "app/store.py" in by_path
    assert {r["file_path"] for r in engine.retrieve("explain the web module", [0.0, 1.0]).collect()} == {"web/a.ts", "web/b.ts"}
    pinned = engine.retrieve("why?", [0.0, 1.0], anchors=["README.md"], stack='File "app/store.py", line 2').collect()
    assert {"README.md", "app/store.py"} <= {r["file_path"] for r in pinned}
    assert engine.call("unified", vector=[0.0, 1.0], top=3).where("is_documentation").count() >= 1
    assert engine.call("traverse_hybrid", vector=[0.0, 1.0], top=2, depth=9, terms=["items"]).count() >= 2


def test_a_file_nested_too_deeply(spark):
    deep = "x = " + "(" * 5000 + ")" * 5000
    files = spark.createDataFrame([("deep.py", deep), ("ok.py", "def f():\n    pass")], "file_path string, content string")
    found = {r["file_path"]: (r["kind"], r["name"]) for r in code.python_symbols(files).collect()}
    assert found == {"deep.py": (code.UNPARSED, None), "ok.py": ("function", "f")} and code.python_relations(files).count() == 0


@pytest.mark.parametrize("bad", ["drop table x", "select 1; select 2", "with a as (select 1) insert into b select * from a", ""])
def test_guard_rejects(spark, bad):
    with pytest.raises(ValueError):
        guarded(spark, bad)


def test_guard_limits(spark):
    assert guarded(spark, "select 'drop; it' as x, id from range(100)", 7).count() == 7


def test_python_symbols(spark):
    files = spark.createDataFrame([("a.py", SOURCE), ("bad.py", "def ("), ("none.py", None)], "file_path string, content string")
    found = {r["name"]: r for r in code.python_symbols(files).collect()}
    assert found.pop(None)["kind"] == code.UNPARSED
    assert set(found) == {"Base", "run", "_hidden", "inner", "main"}
    assert found["run"]["kind"] == "method" and found["run"]["parameters"] == ["a", "b"] and found["run"]["complexity"] == 3
    assert found["_hidden"]["visibility"] == "protected" and found["main"]["is_async"] and found["Base"]["doc"] == "Doc."
    relations = {(r["source"], r["relation"], r["target"]) for r in code.python_relations(files).collect()}
    assert {(None, "IMPORTS", "os"), (None, "IMPORTS", "."), ("Base", "EXTENDS", "Thing"), ("run", "CALLS", "helper"), ("main", "CALLS", "run"), ("cached", "DECORATES", "run")} <= relations


def test_code_chunks_cover_every_line(spark):
    files = spark.createDataFrame([("a.py", SOURCE)], "file_path string, content string")
    chunks = code.code_chunks(files, code.python_symbols(files)).orderBy("start_line").collect()
    covered = [n for c in chunks for n in range(c["start_line"], c["end_line"] + 1)]
    assert len(covered) == len(set(covered))
    assert all(k + 1 in covered for k, line in enumerate(SOURCE.split("\n")) if line.strip())
    assert [c["symbol"] for c in chunks if c["symbol"]] == ["run", "_hidden", "main"]
    assert chunks[0]["chunk_id"].startswith("a.py:1-")


def test_collapse_and_diagram(spark):
    nodes = spark.createDataFrame([("a", 'say "x"', "file"), ("b-1", "b", "class"), ("c", "c", "odd")], "id string, label string, node_type string")
    edges = spark.createDataFrame([("a", "b-1", "CALLS"), ("a", "c", "IMPORTS")], "src string, dst string, edge_type string")
    kept, left = views.collapsed(nodes, edges, 2)
    assert {r["id"] for r in kept.collect()} == {"a", "b-1"} and left.count() == 1
    lines = [r["line"].strip() for r in views.mermaid_lines(nodes, edges).orderBy("part", "at").collect()]
    assert lines == ["a[\"say 'x'\"]", 'b_1[["b"]]', 'c["c"]', "a --> b_1", "a -.-> c"]
    assert views.capped_layers(nodes.withColumn("node_type", F.lit("x")), {"x": 1}).count() == 1


def test_progress_of_a_retrieval(spark, indexed):
    engine = Engine.of_files(indexed, Settings(top_k_vector=5))
    place = F.dense_rank().over(Window.orderBy("chunk_id"))
    engine.chunks = engine.chunks.withColumn("embedding", F.array(F.sin(place), F.cos(place)))
    heard = []
    progress = retrieval.Progress(lambda *told: heard.append(told))
    found = engine.retrieve("What does load_all do?", [0.0, 1.0], current_file="app/main.py", progress=progress)
    plain = engine.retrieve("What does load_all do?", [0.0, 1.0], current_file="app/main.py")
    assert [(s, n, of) for s, n, of, _ in heard] == [(s, k, 6) for k, s in enumerate(retrieval.RETRIEVAL_STEPS, 1)]
    assert heard[0][3] == 5 and heard[5][3] == found.count() == plain.count() and heard[3][3] == heard[4][3] >= heard[5][3]
    rows = progress.rows(spark).orderBy("number").collect()
    assert [r["percent"] for r in rows][::5] == [100 / 6, 100.0] and len(rows) == 6
    domain = retrieval.Progress()
    engine.retrieve("explain the web module", [0.0, 1.0], progress=domain)
    assert [s[:3] for s in domain.steps] == [(retrieval.DOMAIN_STEP, 1, 1)]


def test_searches_through_indexes(spark, indexed, tmp_path):
    engine = Engine.of_files(indexed, Settings(top_k_vector=5))
    place = F.dense_rank().over(Window.orderBy("chunk_id"))
    engine.chunks = engine.chunks.withColumn("embedding", F.array(F.sin(place), F.cos(place)))
    scan = engine.call("search", vector=[0.3, 1.0], top=3)
    both = engine.call("fused", question="where is load_all and fetch_items", vector=[0.3, 1.0], top=4)
    plain = [(r["chunk_id"], round(r["score"], 9)) for r in scan.collect()], [(r["chunk_id"], round(r["score"], 9)) for r in both.orderBy("rank").collect()]
    engine.vectors = VectorIndex.create(spark, str(tmp_path / "v"), engine.chunks.select("chunk_id", "embedding"))
    engine.words = TextIndex.create(spark, str(tmp_path / "t"), "chunk_id", "string", buckets=4)
    engine.words.update(engine.chunks, "content")
    again = engine.call("search", vector=[0.3, 1.0], top=3), engine.call("fused", question="where is load_all and fetch_items", vector=[0.3, 1.0], top=4)
    assert ([(r["chunk_id"], round(r["score"], 9)) for r in again[0].collect()], [(r["chunk_id"], round(r["score"], 9)) for r in again[1].orderBy("rank").collect()]) == plain
