"""Scalars, budgets, texts and state on hand-made rows."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.functions import scalars, vectors
from weftgraph.operators import analysis, dag, retrieval, state, text
from weftgraph.streaming import progress


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("path", "head", "want"),
    [("a/b.PY", None, "python"), ("run", "#!/usr/bin/env node\n", "javascript"), ("run", "echo", "unknown"), ("x.tar.yml", None, "yaml"), (".hidden", None, "unknown")],
)
def test_language(spark, path, head, want):
    assert value(spark, scalars.language(F.lit(path), F.lit(head) if head else None)) == want


@pytest.mark.parametrize(
    ("path", "want"),
    [("node_modules/a.js", True), ("src/node_modules/a.js", True), ("src/a.min.js", True), ("src/keep.min.js", False), ("build/x", True), ("src/build/x", False)],
)
def test_ignored(spark, path, want):
    assert value(spark, scalars.ignored(F.lit(path), ["node_modules/", "*.min.js", "!keep.min.js", "/build", "# no"])) == want


def test_scalars(spark):
    lit = F.lit
    assert value(spark, scalars.id_line(lit("f.py:name:function:12"))) == 12
    assert value(spark, scalars.id_line(lit("a:b"))) is None
    assert value(spark, scalars.nearest_points(lit(4))) == 3
    assert value(spark, scalars.camel_case(lit("a_bc_de"))) == "aBcDe"
    assert value(spark, scalars.csv_list(lit(" a, ,b "))) == ["a", "b"]
    assert value(spark, scalars.json_map(lit("no json"))) == {}
    assert value(spark, scalars.http_method(lit("Create_x"))) == "POST"
    assert value(spark, scalars.without_tags(lit("<p>a<b>b</b>\n c</p>"))) == "a b c"


@pytest.mark.parametrize(("path", "want"), [("a/../b", True), ("../b", False), ("a/../../b", False), ("/etc", False), ("./a//b", True)])
def test_inside(spark, path, want):
    assert value(spark, scalars.inside(F.lit(path))) is want


def test_similarity(spark):
    a, b, zero = (F.array(*map(F.lit, x)) for x in ((1.0, 0.0), (1.0, 1.0), (0.0, 0.0)))
    assert value(spark, vectors.cosine(a, b)) == pytest.approx(2**-0.5)
    assert value(spark, vectors.cosine(a, zero)) is None
    assert value(spark, vectors.euclidean(a, b)) == 0.5


@settings(max_examples=8, deadline=None)
@given(sizes=st.lists(st.integers(0, 60), min_size=1, max_size=12))
def test_first_fit(spark, sizes):
    rows = spark.createDataFrame(list(enumerate(sizes)), "id int, tokens int")
    kept, total = [], 0
    for k, n in enumerate(sizes):
        if k == 0 or total + n <= 100:
            kept.append(k)
            total += n
    assert sorted(x["id"] for x in retrieval.fitting(rows, 100, [F.col("id")]).collect()) == kept


@settings(max_examples=8, deadline=None)
@given(sizes=st.lists(st.integers(0, 60), min_size=1, max_size=12))
def test_packing(spark, sizes):
    rows = spark.createDataFrame([(1, k, n) for k, n in enumerate(sizes)], "doc int, part int, tokens int")
    want, used, chunk = [], 0, 0
    for n in sizes:
        if used and used + n > 50:
            chunk, used = chunk + 1, 0
        used += n
        want.append(chunk)
    assert [x["chunk"] for x in text.packed(rows, "doc", "part", 50).orderBy("part").collect()] == want


def test_error_stack_frames(spark):
    stack = 'File "a.py", line 3\n  at run (b.js:7)\nc.go:9 File "a.py", line 5'
    found = [(x["file"], x["line"]) for x in value(spark, retrieval.frames(F.lit(stack)))]
    assert found[0] == ("a.py", 3) and ("b.js", 7) in found and ("c.go", 9) in found and len({f for f, _ in found}) == len(found)


def test_names_and_domain(spark):
    assert set(value(spark, retrieval.names_in(F.lit("does GraphStore call load_rows or 'x1' and Other?")))) >= {"GraphStore", "load_rows", "x1", "Other"}
    assert value(spark, retrieval.asked_domain(F.lit("How does the billing module work?"))) == "billing"


def test_summary_keeps_key_sentences(spark):
    long = "First one here. Second one here. " + "Nothing to see in this one. " * 6 + "The api must validate it. " + "Filler again and again. " * 3
    out = value(spark, text.summary(F.lit(long)))
    assert out.startswith("First one here. Second one here.") and "The api must validate it." in out and len(out) <= len(long) / 2 + 1
    assert value(spark, text.summary(F.lit("short"))) == "short"


def test_marked_blocks_and_sections(spark):
    docs = spark.createDataFrame([(1, "intro\n# A\nx\n\n## B\ny"), (2, "plain")], "id int, t string")
    blocks = text.heading_blocks(docs, "id", "t").orderBy("id", "block").collect()
    assert [(b["start_line"], b["end_line"]) for b in blocks] == [(1, 1), (2, 4), (5, 6), (1, 1)]
    assert [(s["title"], s["level"]) for s in text.sections(docs, "id", "t").orderBy("id", "first").collect()] == [("A", 1), ("B", 2), ("", 0)]


def test_entry_and_domain_rules(spark):
    assert value(spark, analysis.entry_type(F.lit("get_user"), F.lit("app/routes.py"))) == "http"
    assert value(spark, analysis.entry_type(F.lit("get_user"), F.lit("app/x.py"))) is None
    assert value(spark, analysis.entry_type(F.lit("Main"), F.lit("x.py"))) == "main"
    none = F.array().cast("array<string>")
    assert value(spark, analysis.domain_category(F.lit("UserService"), F.lit("x"), F.array(F.lit("BaseRepository")))) == "repository"
    assert value(spark, analysis.domain_category(F.lit("UserService"), F.lit("x"), none)) == "service"
    assert value(spark, analysis.domain_category(F.lit("User"), F.lit("a/models/user.py"), none)) == "entity"


def test_upsert_and_diff(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in state.upserted(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in state.snapshot_diff(old, new, "k", "v").collect()} == {(1, "deleted"), (2, "modified"), (3, "added")}


def test_merges(spark):
    a, b = F.create_map(F.lit("x"), F.lit(1), F.lit("y"), F.lit(2)), F.create_map(F.lit("y"), F.lit(3))
    assert value(spark, state.merged_maps(a, b)) == {"x": 1, "y": 3}
    assert value(spark, state.capped_log(F.array(*map(F.lit, range(5))), F.array(F.lit(9)), 3)) == [3, 4, 9]


def test_fingerprint_ignores_order(spark):
    a, b = (F.array(*map(F.lit, x)) for x in (["p", "q"], ["q", "p"]))
    assert value(spark, dag.fingerprint(F.lit("z"), a)) == value(spark, dag.fingerprint(F.lit("z"), b))


def test_progress(spark):
    assert value(spark, progress.step_percent(F.lit("vector_search"))) == 50.0
    assert value(spark, progress.step_percent(F.lit("what"))) == 0.0
    pair = (F.lit(1), F.lit(4)), (F.lit(0), F.lit(0))
    assert value(spark, progress.phase_percent(F.lit("embed"), {"embed": pair[0]}, pair[1])) == 25.0
    done = progress.overall_progress({"a": 0.5, "b": 0.5}, F.array(F.lit("a")), F.lit("b"), F.lit(0.5))
    assert value(spark, done) == 0.75


def test_stream_matches_batch(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 7).alias("k"), (F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60)).alias("ts"))
    rows.write.parquet(f"{tmp_path}/in")
    counted = progress.windowed_counts(progress.stream(spark, f"{tmp_path}/in", "k long, ts timestamp"), "ts", "k", late="1 day")
    query = counted.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("counted").agg(F.sum("n")).first()[0] == 200
    batch = rows.groupBy(F.window("ts", "5 minutes"), "k").agg(F.count(F.lit(1)).alias("n"))
    assert spark.table("counted").exceptAll(batch).isEmpty()


def test_stream_restarts_from_its_checkpoint(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/in")
    seen = []
    for more in (0, 5):
        if more:
            spark.range(100, 100 + more).write.mode("append").parquet(f"{tmp_path}/in")
        progress.into(progress.stream(spark, f"{tmp_path}/in", "id long"), lambda df, n: seen.append(df.count()), f"{tmp_path}/at").awaitTermination()
    assert sum(seen) == 15


def test_stream_numbers_go_on_after_a_restart(spark, tmp_path):
    def run(first, last):
        spark.range(first, last).select((F.col("id") % 3).alias("k"), "id").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rows = progress.numbered(progress.stream(spark, f"{tmp_path}/in", "k long, id long"), "k", "id")
        rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()

    run(0, 30)
    run(30, 45)
    found = sorted((r["k"], r["sequence"], r["id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert found == sorted((i % 3, i // 3 + 1, i) for i in range(45))


def test_keys_expire(spark, tmp_path):
    times = [("a", 0), ("a", 1800), ("b", 100), ("a", 20_000), ("b", 30_000)]
    spark.createDataFrame(times, "k string, s long").select("k", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")).alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/in")
    rows = progress.expiring(progress.stream(spark, f"{tmp_path}/in", "k string, ts timestamp"), "k", "ts")
    query = rows.writeStream.format("memory").queryName("expired").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["k"], r["events"]) for r in spark.table("expired").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_token_counts_of_a_vocabulary(spark):
    vocabulary = pytest.importorskip("public_tokenizers")
    from weftgraph.functions.tokens import bpe_tokens

    path = str(vocabulary.path("byte_bpe_50k.tiktoken"))
    rows = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "é漢 x" * 100)], "id long, t string")
    got = {r["id"]: r["n"] for r in rows.select("id", bpe_tokens(F.col("t"), path).alias("n")).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and 100 < got[5] < 900


def test_repositories_are_validated(spark):
    rows = spark.createDataFrame([("a", "READY"), ("b", "completed"), ("c", "pending")], "repo_id string, status string")
    assert state.validated(rows, "a") is None and [state.validated(rows, x, "bool") for x in "abcd"] == [True, True, False, False]
    assert state.validated(rows, "a", "message") is None and "pending" in state.validated(rows, "c", "message") and "not found" in state.validated(rows, "d", "message")
    with pytest.raises(LookupError):
        state.validated(rows, "d")
    with pytest.raises(ValueError):
        state.validated(rows, "c")


def test_running_totals_by_ranges(spark):
    rows = spark.createDataFrame([("h" if k % 3 else None, k, 1 + k % 4) for k in range(300)], "key string, at long, n long").repartition(5)
    out = state.running_total(rows, "key", ["at"], F.col("n"), "running").collect()
    for name in ("h", None):
        total = 0
        for r in sorted((r for r in out if r["key"] == name), key=lambda r: r["at"]):
            total += r["n"]
            assert r["running"] == total
    assert len(out) == 300
