"""An index that is kept up to date is the one that is made anew."""

import random

import pytest

from weftgraph.operators import index

PATHS = ["a.py", "pkg/__init__.py", "pkg/b.py", "pkg/c.py", "web/x.ts", "web/y.ts", "web/y/index.ts", "doc/r.md"]
NAMES = ["one", "two", "three", "Four"]


def content(r, path):
    some = r.sample(NAMES, 2)
    if path.endswith(".md"):
        return f"# {some[0]}\n\ntext {r.randrange(3)}"
    if path.endswith(".py"):
        lead = r.choice(["import pkg.b", "from . import c", "from .b import x", "import a", "from pkg import b"])
        return f"{lead}\n\nclass Four({r.choice(NAMES)}):\n    pass\n\ndef {some[0]}():\n    {r.choice(NAMES)}()\n\ndef {some[1]}():\n    return {r.choice(NAMES)}({r.randrange(3)})\n"
    return f"import q from '{r.choice(['./y', './x', '../web/y', 'react'])}';\nfunction {some[0]}() {{ {r.choice(NAMES)}(); }}\nclass K extends {r.choice(NAMES)} {{ m() {{ {some[1]}(); }} }}\n"


def frame(spark, files):
    language = {"py": "python", "ts": "typescript", "md": "markdown"}
    return spark.createDataFrame([(p, language[p.rpartition(".")[2]], t) for p, t in sorted(files.items())], "file_path string, language string, content string")


def told(made):
    return {name: sorted((tuple(r) for r in getattr(made, name).select(*sorted(getattr(made, name).columns)).collect()), key=repr) for name in ("nodes", "edges", "chunks", "links", "files", "references", "imports")}


@pytest.mark.parametrize("seed", [2])
def test_random_edits_give_what_a_full_run_gives(spark, seed):
    r = random.Random(seed)
    files = {p: content(r, p) for p in r.sample(PATHS, 5)}
    made = index.index_files(frame(spark, files))
    for _ in range(2):
        edits = {p: content(r, p) for p in r.sample(PATHS, 3)}
        gone = r.sample(sorted(set(files) - set(edits)), 1) if set(files) - set(edits) else []
        files = {p: t for p, t in files.items() if p not in gone} | edits
        same = dict(list(files.items())[:2])  # given again as they are
        made = index.reindexed(made, frame(spark, edits | same), removed=spark.createDataFrame([(g,) for g in gone], "file_path string"))
        assert told(made) == told(index.index_files(frame(spark, files)))


def test_links_to_files_that_did_not_change_stay(spark):
    files = {"a.py": "def f():\n    pass\n", "b.py": "import a\n\ndef g():\n    f()\n"}
    made = index.index_files(frame(spark, files))
    again = index.reindexed(made, frame(spark, {"b.py": "import a\n\ndef g():\n    return f()\n"}))
    edges = {(r["src"], r["dst"], r["edge_type"]) for r in again.edges.collect()}
    assert {("file:b.py", "file:a.py", "IMPORTS"), ("b.py:g:function:3", "a.py:f:function:1", "CALLS")} <= edges
