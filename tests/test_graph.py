"""Traversals against plain Python on small and on random graphs."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import dag, graph, resolve

GRAPHS = {
    "empty": [],
    "loop": [(1, 1)],
    "two_cycle": [(1, 2), (2, 1)],
    "chain": [(1, 2), (2, 3), (3, 4)],
    "diamond": [(1, 2), (1, 3), (2, 4), (3, 4)],
    "apart": [(1, 2), (5, 6)],
    "multi": [(1, 2), (1, 2), (2, 3)],
}


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def starts(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def search(pairs, sources, most):
    depth, queue = {s: 0 for s in sources}, deque(sources)
    while queue:
        a = queue.popleft()
        for x, y in pairs:
            if x == a and y not in depth and depth[a] < most:
                depth[y] = depth[a] + 1
                queue.append(y)
    return depth


@pytest.mark.parametrize("name", GRAPHS)
def test_search_on_small_graphs(spark, name):
    nodes, edges = graph.traverse(frame(spark, GRAPHS[name]), starts(spark, 1), 10)
    assert {r["id"]: r["depth"] for r in nodes.collect()} == search(GRAPHS[name], [1], 10)
    depth = search(GRAPHS[name], [1], 10)
    want = {(a, b) for a, b in GRAPHS[name] if a in depth and depth.get(b) == depth[a] + 1}
    assert {(r["src"], r["dst"]) for r in edges.collect()} == want


def test_search_on_a_random_graph(spark):
    r = random.Random(5)
    pairs = [(r.randrange(40), r.randrange(40)) for _ in range(70)]
    nodes, _ = graph.traverse(frame(spark, pairs), starts(spark, 0, 3), 3)
    assert {x["id"]: x["depth"] for x in nodes.collect()} == search(pairs, [0, 3], 3)


def test_row_cap_keeps_the_smallest(spark):
    nodes, _ = graph.traverse(frame(spark, [(1, 9), (1, 4), (1, 7)]), starts(spark, 1), 1, row_cap=2)
    assert {x["id"] for x in nodes.collect()} == {1, 4, 7}


def test_shortest_path_is_undirected_by_default(spark):
    edges = frame(spark, [(2, 1), (2, 3), (3, 4), (1, 4)])
    found = {x["id"]: (x["length"], list(x["path"])) for x in graph.shortest_paths(edges, starts(spark, 1), 5).collect()}
    assert found[1] == (0, [1]) and found[3] == (2, [1, 2, 3]) and found[4] == (1, [1, 4])
    directed = graph.shortest_paths(edges, starts(spark, 1), 5, directed=True)
    assert {x["id"] for x in directed.collect()} == {1, 4}


def test_trails_use_an_edge_once(spark):
    out = graph.trails(frame(spark, [(1, 2), (2, 1)]), starts(spark, 1), 1, 4).collect()
    assert sorted(list(x["path"]) for x in out) == [[1, 2], [1, 2, 1]]


def test_paths_to_leaves(spark):
    out = graph.paths_to_leaves(frame(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (4, 1)]), starts(spark, 1), 9)
    assert out.count() == 0  # every end goes on through a node of the path
    out = graph.paths_to_leaves(frame(spark, GRAPHS["diamond"]), starts(spark, 1), 9)
    assert sorted(list(x["path"]) for x in out.collect()) == [[1, 2, 4], [1, 3, 4]]


def test_degrees_and_hotspots(spark):
    nodes = spark.createDataFrame([(i, f"n{i}") for i in range(1, 5)], "id long, name string")
    edges = frame(spark, GRAPHS["diamond"])
    assert {x["id"]: x["total"] for x in graph.degrees(edges).collect()} == {1: 2, 2: 2, 3: 2, 4: 2}
    assert [x["id"] for x in graph.hotspots(nodes, edges, 2, least=2).collect()] == [1, 2]


@pytest.mark.parametrize("name", GRAPHS)
def test_peeling_finds_cycles(spark, name):
    pairs = GRAPHS[name]
    tasks = spark.createDataFrame([(i,) for i in range(1, 7)], "task long")
    needs = spark.createDataFrame(pairs, "task long, dep long")
    done, left = dag.levels(tasks, needs)
    assert left.isEmpty() == (name not in ("loop", "two_cycle"))
    level = {x["task"]: x["level"] for x in done.collect()}
    assert all(level[a] > level[b] for a, b in pairs if a in level)


def levels_by_hand(tasks, pairs):
    needs = {t: {d for s, d in pairs if s == t and d in tasks} for t in tasks}
    level = {}
    while fresh := [t for t in tasks if t not in level and needs[t] <= level.keys()]:
        level |= {t: 1 + max((level[d] for d in needs[t]), default=-1) for t in fresh}
    return level, {(t, d) for t in tasks for d in needs[t] if d not in level}


@pytest.mark.parametrize("seed", range(4))
def test_levels_of_long_chains(spark, monkeypatch, seed):
    """Chains that meet, side ways into them, cycles, and tasks that wait for a cycle."""
    r = random.Random(seed)
    monkeypatch.setattr(dag, "PATIENCE", 1 + seed % 2)
    tasks = list(range(90))
    pairs = [(k, k - 1) for k in range(1, 90) if k % 30] + [(a, b) for a, b in (sorted(r.sample(tasks, 2), reverse=True) for _ in range(3 * seed))]
    if seed == 3:
        pairs += [(60, 63), (5, 999), (7, 7)]
    r.shuffle(tasks)
    done, left = dag.levels(spark.createDataFrame([(t,) for t in tasks], "task long"), spark.createDataFrame(pairs, "task long, dep long"))
    level, undone = levels_by_hand(tasks, pairs)
    assert {x["task"]: x["level"] for x in done.collect()} == level and done.count() == len(level)
    assert {tuple(x) for x in left.select("task", "dep").collect()} == undone


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    n, made = 3000, []
    monkeypatch.setattr(dag, "written", lambda df, f=dag.written: made.append(1) or f(df))
    done, left = dag.levels(spark.range(n).select(F.col("id").alias("task")), spark.range(1, n).select(F.col("id").alias("task"), (F.col("id") - 1).alias("dep")))
    assert done.where("task = level").count() == n and left.isEmpty() and len(made) < 80


def test_ready_and_stalled(spark):
    tasks = spark.createDataFrame([(1, False), (2, True), (3, False)], "task long, finished boolean")
    needs = spark.createDataFrame([(1, 2), (3, 1)], "task long, dep long")
    assert [x["task"] for x in dag.ready(tasks, needs).collect()] == [1]
    stuck = spark.createDataFrame([(1, 9)], "task long, dep long")
    alone = tasks.where("task = 1")
    assert dag.progress_state(alone, stuck).first()["state"] == "stalled"


def test_modules_resolve_in_order(spark):
    files = spark.createDataFrame([("a/b.py",), ("a/c/__init__.py",), ("w/x.ts",), ("w/y/index.js",)], "file_path string")
    rows = [("a/z.py", ".b", "python"), ("a/z.py", "a.c", "python"), ("a/z.py", "os", "python"), ("w/m.ts", "./x", "typescript"), ("w/m.ts", "./y", "typescript"), ("w/m.ts", "react", "typescript")]
    out = resolve.resolve_modules(spark.createDataFrame(rows, "importer string, module string, language string"), files)
    assert {x["module"]: x["target"] for x in out.collect()} == {".b": "a/b.py", "a.c": "a/c/__init__.py", "os": None, "./x": "w/x.ts", "./y": "w/y/index.js", "react": None}


def test_root_files_have_no_folder(spark):
    out = resolve.containment(spark.createDataFrame([("x.py",), ("a/b/y.py",), (None,)], "path string"), "path")
    assert {(x["src"], x["dst"]) for x in out.collect()} == {("repo", "file:x.py"), ("repo", "dir:a"), ("dir:a", "dir:a/b"), ("dir:a/b", "file:a/b/y.py")}


def all_simple_paths(edges, start, most_edges):
    """Simple paths that end in a leaf, in order."""
    out, after = [], {}
    for a, b in sorted(set(edges)):
        after.setdefault(a, []).append(b)

    def walk(path):
        if path[-1] not in after:
            out.append(path)
        elif len(path) <= most_edges:
            for b in after[path[-1]]:
                if b not in path:
                    walk([*path, b])

    walk([start])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_paths_to_leaves_of_cyclic_graphs_are_those_of_brute_force(spark, seed):
    r = random.Random(seed)
    edges = [(a, b) for a in range(9) for b in range(11) if a != b and r.random() < 0.3]
    out = graph.paths_to_leaves(frame(spark, edges), starts(spark, 0, 1, 10), 6, most=4)
    want = [(s, p) for s in (0, 1, 10) for p in all_simple_paths(edges, s, 6)[:4]]
    assert sorted((x["start"], list(x["path"])) for x in out.collect()) == sorted(want)


def test_the_only_leaf_behind_a_crowd(spark):
    crowd = range(1, 60)
    edges = [(0, k) for k in crowd] + [(k, 0) for k in crowd] + [(a, b) for a in crowd for b in crowd if a != b] + [(59, 500)]
    out = graph.paths_to_leaves(frame(spark, edges), starts(spark, 0), 3, most=5)
    assert sorted(list(x["path"]) for x in out.collect()) == [[0, k, 59, 500] for k in range(1, 6)]
    assert [list(x["path"]) for x in graph.paths_to_leaves(frame(spark, edges), starts(spark, 0), 2, most=5).collect()] == [[0, 59, 500]]


@pytest.mark.parametrize("directed", [True, False])
def test_search_from_both_ends_agrees_with_the_search_from_one(spark, directed):
    r = random.Random(7)
    edges = frame(spark, [(r.randrange(40), r.randrange(40)) for _ in range(55)])
    whole = {x["id"]: (x["length"], list(x["path"])) for x in graph.shortest_paths(edges, starts(spark, 3), 6, directed).collect()}
    for end in r.sample(range(40), 4):
        found = [(x["start"], x["id"], x["length"], list(x["path"])) for x in graph.shortest_path(edges, starts(spark, 3), starts(spark, end), 6, directed).collect()]
        assert found == ([(3, end, *whole[end])] if end in whole else [])
    assert graph.shortest_path(edges, starts(spark, 3), starts(spark, 3)).first()["length"] == 0
    assert graph.shortest_path(edges, starts(spark, 3), starts(spark, 999)).count() == 0
