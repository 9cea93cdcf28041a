"""How often and how far a source file is read."""

import ast
import gc

from weftgraph.operators import code, index

FILES = "file_path string, content string"
SOURCE = '''import os
from . import a as b

@wrap(1)
@lib.deco
class K(Base, ns.Other[int]):
    def m(self, x):
        """Doc."""
        class In:
            def deep(self):
                return go(x) if x else obj().call(lambda: [y for y in x])
        return In
'''


def test_a_file_is_parsed_once(monkeypatch):
    parsed = []
    parse = ast.parse
    with monkeypatch.context() as m:
        m.setattr(code.ast, "parse", lambda text: parsed.append(text) or parse(text))
        rows = code._parsed("a.py", SOURCE, (code._symbols, code._no_symbols), (code._relations, lambda path, why: []))
    assert len(parsed) == 1
    assert {r["name"]: (r["kind"], r["parent"], r["complexity"]) for r in rows if "kind" in r} == {"K": ("class", None, 3), "m": ("method", "K", 3), "In": ("class", "m", 3), "deep": ("method", "In", 3)}
    assert sorted((r["source"], r["target"]) for r in rows if r.get("relation") == "CALLS") == sorted((f, t) for f in ("m", "deep") for t in ("go", "obj", "call"))
    assert [(r["source"], r["target"]) for r in rows if r.get("relation") == "DECORATES"] == [("wrap", "K"), ("lib.deco", "K")]
    assert [r["target"] for r in rows if r.get("relation") == "EXTENDS"] == ["Base", "ns.Other[int]"] and [r["target"] for r in rows if r.get("relation") == "IMPORTS"] == ["os", "."]


def test_contents_are_symbols_and_relations(spark):
    files = spark.createDataFrame([("a.py", SOURCE), ("bad.py", "def ("), ("none.py", None)], FILES)
    both = code.python_contents(files)
    for part, alone in ((both.where("relation IS NULL"), code.python_symbols(files)), (both.where("relation IS NOT NULL"), code.python_relations(files))):
        assert sorted(map(str, part.select(alone.columns).collect())) == sorted(map(str, alone.collect()))


def test_a_long_expression_is_no_deep_nesting(spark):
    files = spark.createDataFrame([("sum.py", "def f():\n    return g()\nx = " + " + ".join(["1"] * 1500))], FILES)
    assert [(r["kind"], r["name"]) for r in code.python_symbols(files).collect()] == [("function", "f")]
    assert [r["target"] for r in code.python_relations(files).collect()] == ["g"]


def test_chunks_that_fit_are_not_dealt_anew(spark):
    long = "def f(a):\n" + "".join(f"    if a == {k}:\n        return {k}\n" for k in range(60))
    files = spark.createDataFrame([("a.py", "python", long), ("b.py", "python", "x = 1"), ("c.py", "python", None)], "file_path string, language string, content string")
    out = index.chunks_of(files, code.python_symbols(files), 50)
    rows = out.collect()
    assert {r["file_path"] for r in rows} == {"a.py", "b.py"} and max(len(r["content"]) // 4 for r in rows) <= 50
    assert "\n".join(r["content"] for r in sorted(rows, key=lambda r: r["start_line"]) if r["file_path"] == "a.py").rstrip("\n") == long.rstrip("\n")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_no_garbage_is_sought_in_a_tree():
    text, seen = "def f(a):\n    return [g(x) for x in a if x]\n" * 2000, []
    watch = lambda phase, info: seen.append(phase)
    gc.callbacks.append(watch)
    try:
        rows = code._parsed("a.py", text, (code._symbols, code._no_symbols))
        bad = code._parsed("a.py", "def (", (code._symbols, code._no_symbols))
        during = len(seen)
    finally:
        gc.callbacks.remove(watch)
    assert during == 0 and gc.isenabled() and len(rows) == 2000 and bad[0]["kind"] == code.UNPARSED
