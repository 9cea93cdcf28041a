"""Each operator against brute force, exact round trips, or held-out accuracy; and odd inputs."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import chat, language, leaks, mixing, near, neighbours, private, repeats, toxicity, urls
from weftgraph.llm.suffix import SuffixAutomaton
from weftgraph.llm.words import NOT_LETTER, Words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, **more):
    rows = [(k, t, more.get("lang", ["en"] * len(texts))[k], more.get("source", ["s"] * len(texts))[k], len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd(spark):
    """Nulls, empty and repeated rows, a long text, and extra columns with clashing names."""
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (5, "one"), (None, "null id here"), (6, long), (7, long + " end"), (8, "é ß 漢字 👍")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = ["size", "score", "rep", "key", "part", "doc", "n_words", "kept", "row", "leaks", "private", "target", "lang", "source", "label"]
    return df.select("*", *(F.lit(None).cast("string").alias(c) for c in clash))


def sentences(r, n, words=400):
    return " ".join(f"v{r.randrange(words)}" for _ in range(n))


# 1 near duplicates


def brute_near(texts, shingle, percent):
    def shingles(t):
        w = SPLIT.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set())

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {(k, len(sets[k]), find(k)) for k in range(len(texts))}


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates_are_those_of_brute_force(spark, shingle):
    r, texts = random.Random(shingle), []
    for _ in range(12):
        base = sentences(r, r.randrange(3, 120)).split()
        for _ in range(r.randrange(1, 9)):
            copy = list(base)
            for _ in range(r.randrange(0, 1 + len(base) // 12)):
                copy[r.randrange(len(copy))] = f"v{r.randrange(400)}"
            texts.append(" ".join(copy))
    texts += [texts[0].upper(), "One", "one", "", None]
    out = near.near_duplicates(docs(spark, texts), shingle=shingle, percent=80).collect()
    assert {(x["doc_id"], x["n_shingles"], x["component_id"]) for x in out} == brute_near(texts, shingle, 80)
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in out)


def test_a_large_group_of_near_copies(spark):
    r = random.Random(9)
    base, texts = sentences(r, 150, 5000).split(), []
    for k in range(150):
        copy = list(base)
        for _ in range(0 if k == 77 else r.randrange(4, 20)):
            copy[r.randrange(len(copy))] = f"e{r.randrange(50)}"
        texts.append(" ".join(copy))
    out = near.near_duplicates(docs(spark, texts), shingle=2, percent=80).collect()
    assert {(x["doc_id"], x["n_shingles"], x["component_id"]) for x in out} == brute_near(texts, 2, 80)


def test_pruning_misses_little():
    bar = near.least_matches(192, 80, near.MISS)
    assert 110 < bar < 154 and near.least_matches(32, 80, near.MISS) < 32 * bar / 192


def test_near_duplicates_of_odd_rows(spark):
    out = near.near_duplicates(odd(spark)).collect()
    by_id = {x["doc_id"]: x for x in out}
    assert len(out) == 10 and by_id[5]["component_id"] == 4 and by_id[7]["component_id"] == 6
    assert by_id[None]["kept"] and by_id[1]["n_shingles"] == 0 and by_id[3]["kept"]
    assert near.near_duplicates(odd(spark).where("false")).count() == 0


def test_words_that_a_polynomial_hash_confuses(spark):
    one = "a"
    for _ in range(10):
        one += one.translate({97: 98, 98: 97})
    two = one.translate({97: 98, 98: 97})
    texts = [one, two, " ".join(one), " ".join(two), one[:40], two[:40]]
    out = near.near_duplicates(docs(spark, texts), shingle=5).collect()
    assert {(x["doc_id"], x["n_shingles"], x["component_id"]) for x in out} == brute_near(texts, 5, 80)


# 2 nearest neighbours


def test_nearest_neighbours_are_those_of_brute_force(spark):
    r = random.Random(2)
    rows = [(k, [round(r.gauss(0, 1), 2) for _ in range(8)]) for k in range(130)]
    rows += [(130, None), (131, [0.0] * 8), (132, [1.0, None] + [0.0] * 6), (133, [float("nan")] + [1.0] * 7), (134, rows[3][1]), (135, rows[3][1]), (None, rows[3][1]), (140, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=5, query_block=3, candidate_block=25).collect()
    exact = {x["vec_id"]: list(x["embedding"]) for x in df.where(neighbours.usable(F.col("embedding")) & F.col("vec_id").isNotNull()).collect()}
    for q in (v for v in exact if v % 20 == 0 and len(exact[v]) == 8):
        scores = sorted((-sum(a * b for a, b in zip(exact[q], e, strict=True)), v) for v, e in exact.items() if v != q and len(e) == 8)[:5]
        mine = sorted((x["rank"], x["vec_id"], x["score"]) for x in out if x["query_id"] == q)
        assert [(v, pytest.approx(-s)) for s, v in scores] == [(v, s) for _, v, s in mine]
    assert neighbours.nearest(df.where("false"), F.lit(True)).count() == 0


def test_large_components(spark):
    rows = [(0, [1e200, 1e200]), (1, [-1e200, -1e200]), (2, [1e200, -1e200]), (3, [1.0, 2.0]), (4, [1e-300, 0.0])] + [(20 + k, [float(k), 1.0]) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = neighbours.nearest(df, F.col("vec_id").isin(0, 3), k=20, candidate_block=5).collect()
    found = {q: [(x["vec_id"], x["score"]) for x in sorted(out, key=lambda x: x["rank"]) if x["query_id"] == q] for q in (0, 3)}
    assert len(found[0]) == 20 == len(found[3]) and found[3][0] == (0, 3e200)
    few = neighbours.nearest(df.where("vec_id < 4"), F.col("vec_id") == 0, k=5).orderBy("rank").collect()
    assert [(x["vec_id"], repr(x["score"])) for x in few][::2] == [(3, "3e+200"), (2, "nan")] and few[1]["score"] == -math.inf


def test_one_vector_many_times(spark):
    rows = [(k % 3, [1.0, 2.0]) for k in range(60)] + [(20, [0.5, 0.5])]
    out = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=45, query_block=2, candidate_block=7).collect()
    assert [(x["vec_id"], x["score"]) for x in sorted(out, key=lambda x: x["rank"]) if x["query_id"] == 0] == [(1, 5.0)] * 20 + [(2, 5.0)] * 20 + [(20, 1.5)]


# 3 personal data


def test_rules_are_those_of_the_patterns():
    r = random.Random(3)
    for k in range(30_000):
        alphabet = "0123456789.- +" if k % 3 == 0 else "ab1290@@..+-- ()é\n"
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(0, 45)))
        want = []
        want += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        want += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
        digits = lambda m: re.sub("[^0-9]", "", m.group())
        want += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m)) <= 19 and private.luhn(digits(m))]
        want += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
        assert private.base_spans(text) == [(a, b, private.KINDS[kind]) for a, kind, b in sorted(want)], text
    zeros = "0" * 5000
    assert private.base_spans(f"{zeros}1.1.1.{zeros}") == [(0, 10006, "ip")] and private.base_spans(f"1{zeros}.1.1.1") == []


def test_patterns_discover_unseen_identifiers(spark):
    seeds = [f"please call +1 555 010 {1000 + k} today about item{k}x9" for k in range(8)]
    texts = [*seeds, "please call 555-0199-22 today ok", "unrelated 555-0199-22x word", None, ""]
    out = private.find(docs(spark, texts), least_seeds=5, confidence=0.6).orderBy("doc_id").collect()
    found = {x["doc_id"]: [(s["first"], s["last"], s["kind"], s["added"]) for s in x["private"]] for x in out}
    assert found[8] == [(12, 23, "phone", True)] and found[9] == [] and found[10] == [] and len(found[0]) == 1
    clean = {x["doc_id"]: x["text"] for x in private.redact(private.find(docs(spark, texts), least_seeds=5, confidence=0.6)).collect()}
    assert clean[8] == "please call [PHONE] today ok" and clean[10] is None
    assert private.find(odd(spark).drop("private")).count() == 10
    assert private.find(docs(spark, ["x"]).where("false")).count() == 0


def test_learnt_identifiers_make_new_patterns(spark):
    texts = [f"please call +1 555 010 {1000 + k} today" for k in range(60)]
    for k in range(6):
        texts += [f"please call 555-01{k}9-22 today", f"line 555-01{k}9-22 rings"]
    texts += ["line 777-0001-3 rings", "other 777-0001-4 words"]
    out = private.find(docs(spark, texts), least_seeds=5, confidence=0.6).orderBy("doc_id").collect()
    assert [[(s["first"], s["last"], s["kind"], s["added"]) for s in x["private"]] for x in out[-2:]] == [[(5, 15, "phone", True)], []]


def test_identifiers_without_digits_and_plain_words(spark):
    texts = [f"write to mailbox user{k}@mail.example please" for k in range(12)]
    texts += ["write to mailbox bob-at-mail please", "see the thing bob-at-mail here", "the +1 555 010 1000 of", *(f"of the +1 555 010 {2000 + k} of" for k in range(9)), "of the well-known of", *(f"of the word{chr(97 + k)} of" for k in range(9))]
    out = private.find(docs(spark, texts), least_seeds=5, confidence=0.6).orderBy("doc_id").collect()
    added = {x["doc_id"]: [(s["first"], s["last"], s["kind"]) for s in x["private"] if s["added"]] for x in out}
    # nine words stand where nine numbers do, so "well-known" is none
    assert {k: v for k, v in added.items() if v} == {12: [(17, 28, "email")]}


def test_long_contexts_and_instances_are_told_apart(spark):
    long = "x" * 200
    texts = [f"call {long}a +1 555 010 {1000 + k} now{k}" for k in range(9)] + [f"call {long}b 555-0199-{k} yes{k}" for k in range(3)]
    out = private.find(docs(spark, texts), least_seeds=5, confidence=0.6).orderBy("doc_id").collect()
    assert not [s for x in out for s in x["private"] if s["added"]]


def test_redaction_of_a_long_text_with_many_spans(spark):
    said = " ".join(f"é{k} me{k}@mail.example" for k in range(20_000))
    out = private.redact(private.find(docs(spark, [said, None, ""]))).orderBy("doc_id").collect()
    assert out[0]["text"] == " ".join(f"é{k} [EMAIL]" for k in range(20_000)) and out[1]["text"] is None and out[2]["text"] == ""


# 4 toxicity


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(4)
    texts, labels = [], []
    for k in range(600):
        said = [sentences(r, 12) for _ in range(r.randrange(1, 12))]
        if bad := k % 5 == 1:
            said[r.randrange(len(said))] += r.choice([" you rotten", " vileness here"])
        texts.append(". ".join(said) + ".")
        labels.append((k, 1, int(bad)))
    df, lab = docs(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(df, lab, F.col("doc_id") < 450)
    out = toxicity.score(df, model).where("doc_id >= 450").collect()
    assert sum(x["predicted"] == labels[x["doc_id"]][2] for x in out) >= 0.97 * len(out)
    for x in out:
        if x["predicted"] and x["offending"]:
            assert any(w in x["text"][x["offending"][0]["first"] : x["offending"][0]["last"]] for w in ("rotten", "vileness"))
    clash = toxicity.score(odd(spark), model, prefix="my_")
    assert clash.count() == 10 and clash.where("my_score IS NULL OR my_score < 0 OR my_score > 1").count() == 0
    assert toxicity.score(df.where("false"), model).count() == 0
    alone = toxicity.train(df, lab.where("toxic = 0"), F.lit(True))
    assert toxicity.score(df, alone).agg(F.max("predicted")).first()[0] == 0


def test_noisy_or_is_that_of_brute_force(spark):
    r = random.Random(14)
    texts = [". ".join(sentences(r, 8, 30) + (" rotten" if r.random() < 0.2 else "") for _ in range(r.randrange(1, 6))) + r.choice((".", "", "!\n")) for _ in range(80)] + ["", None, "Rotten? v1 v2", "é!?..x"]
    df = docs(spark, texts)
    labels = spark.createDataFrame([(k, 1, int("rotten" in (t or ""))) for k, t in enumerate(texts)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, labels, F.lit(True), least_z=0.5, rounds=60)
    known = dict(zip(model.hashes.tolist(), model.weights.tolist(), strict=True))
    for x in toxicity.score(df, model).collect():
        text, none = x["text"] or "", 1.0
        for said in re.findall(r"[^.!?\n]*[.!?\n]|[^.!?\n]+", text) or [""]:
            data = np.frombuffer("".join(c.lower() if "A" <= c <= "Z" else c for c in said).encode(), np.uint8)
            words = Words(data, np.array([0, len(data)]), NOT_LETTER)
            held = {h for f in toxicity.features(words) for h in f.tolist()}
            none *= 1 - 1 / (1 + math.exp(-(model.bias + sum(known.get(h, 0) for h in held))))
        assert x["score"] == pytest.approx(1 - none, abs=1e-9) and x["predicted"] == (1 - none >= 0.5), text


# 5 chat formatting


def test_chats_come_back_as_they_were(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "␛0␛1|<␛1|<|", "a\nb", "", None, "<|" * 3, "é漢👍 <|"]
    rows = [(c, t, ("user", "assistant", "sys\ntem<|", None)[(c + t) % 4], nasty[(c * 3 + t) % 7]) for c in range(9) for t in range(5)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("formatted", F.lit(1)).withColumn("messages", F.lit("x"))
    out = chat.format_chats(df).withColumns({"said": chat.parsed(F.col("formatted")), "loss": chat.under_loss(F.col("formatted"), F.col("loss_spans"))}).collect()
    for x in out:
        want = [(r or "", t or "") for c, _, r, t in sorted((q for q in rows if q[0] == x["conv_id"]), key=lambda q: q[1])]
        assert [(s["role"], s["text"]) for s in x["said"]] == want
        assert x["loss"] == "".join(t for r, t in want if r == "assistant")
    assert chat.format_chats(df.where("false")).count() == 0


def test_layouts_give_the_same_turns(spark):
    spark_rows = {
        "messages": ("conv_id long, messages array<struct<role: string, content: string>>, extra int", [(1, [("user", "hi"), ("assistant", "yo")], 0)]),
        "shared": ("conv_id long, conversations array<struct<from: string, value: string>>", [(1, [("human", "hi"), ("gpt", "yo")])]),
        "instruction": ("conv_id long, instruction string, output string", [(1, "hi", "yo")]),
        "prompt": ("conv_id long, prompt string, completion string, id int", [(1, "hi", "yo", 3)]),
        "rows": ("conv_id long, turn int, role string, text string", [(1, 1, "assistant", "yo"), (1, 0, "user", "hi")]),
    }
    made = {name: chat.format_chats(spark.createDataFrame(rows, schema)).first()["formatted"] for name, (schema, rows) in spark_rows.items()}
    assert len(set(made.values())) == 1
    with pytest.raises(ValueError):
        chat.format_chats(spark.createDataFrame([(1, "x")], "conv_id long, other string"))


def test_a_table_of_mixed_layouts(spark):
    schema = "conv_id long, messages array<struct<role: string, content: string>>, prompt string, completion string, instruction string, input string, output string, layout_note string"
    say = [("user", "hi"), ("assistant", "yo<|")]
    rows = [(1, say, None, None, None, None, None, "x"), (2, None, "hi", "yo<|", None, None, None, None), (3, None, None, None, None, None, None, None), (4, [], None, None, None, None, None, None), (5, say, None, None, None, None, None, None), (5, [("human", "two"), None], None, None, None, None, None, None), (6, None, None, None, "do", "it", "yo<|", None), (7, None, None, None, "hi", None, "yo<|", None), (8, None, "hi", None, None, None, None, None)]
    out = chat.format_chats(spark.createDataFrame(rows, schema)).withColumns({"said": chat.parsed(F.col("formatted")), "loss": chat.under_loss(F.col("formatted"), F.col("loss_spans"))}).collect()
    got = sorted((x["conv_id"], [tuple(s) for s in x["said"]], x["loss"]) for x in out)
    said = [("user", "hi"), ("assistant", "yo<|")]
    assert got == [(1, said, "yo<|"), (2, said, "yo<|"), (3, [], ""), (4, [], ""), (5, said, "yo<|"), (5, [("user", "two"), ("", "")], ""), (6, [("user", "do\n\nit"), ("assistant", "yo<|")], "yo<|"), (7, said, "yo<|"), (8, [("user", "hi")], "")]
    both = spark.createDataFrame([(1, 0, "user", "hi", None), (1, 1, "assistant", "yo<|", None), (2, None, None, None, say)], "conv_id long, turn int, role string, text string, messages array<struct<role: string, content: string>>")
    assert len({x["formatted"] for x in chat.format_chats(both).collect()}) == 1
    long = [(1, [(("user", "assistant")[k % 2], "x" * (k % 5)) for k in range(3000)])]
    x = chat.format_chats(spark.createDataFrame(long, "conv_id long, messages array<struct<role: string, content: string>>")).first()
    assert [x["formatted"][s["first"] : s["last"]] for s in x["loss_spans"]] == [t for r, t in long[0][1] if r == "assistant"]


# 6 repeated sequences


def brute_repeats(rows, window):
    seen, out = set(), {}
    for doc_id, text in rows:
        words = SPLIT.findall(text or "")
        gone = set()
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone |= set(range(i, i + window))
            seen.add(w)
        out[doc_id] = (len(words), len(gone), " ".join(x for i, x in enumerate(words) if i not in gone))
    return out


@pytest.mark.parametrize("hot", [1000, 3])
def test_repeats_are_those_of_brute_force(spark, hot):
    r, rows = random.Random(6), []
    pool = [[f"p{k}w{j}" for j in range(r.randrange(15, 60))] for k in range(6)]
    for k in range(60):
        words = []
        for _ in range(r.randrange(0, 5)):
            words += r.choice(pool)[r.randrange(0, 8) :] if r.random() < 0.6 else [f"u{r.randrange(9)}" for _ in range(r.randrange(1, 40))]
        rows.append((k, r.choice((" ", "\n", "\t ")).join(words)))
    rows += [(60, "a " * 70), (61, "a b " * 40), (62, None), (63, ""), (64, rows[5][1])]
    out = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()
    assert {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_text"]) for x in out} == brute_repeats(rows, 20)


def test_repeats_of_odd_rows(spark):
    out = {x["doc_id"]: x for x in repeats.without_repeats(odd(spark)).collect()}
    assert out[7]["n_removed"] == 60_000 and out[6]["n_removed"] > 0 and out[1]["n_words"] == 0
    assert repeats.without_repeats(odd(spark)).count() == 10
    assert repeats.without_repeats(odd(spark).where("false")).count() == 0


def test_texts_of_one_id_whose_short_hashes_agree(spark):
    said = " ".join(f"s{k}" for k in range(30))
    texts = [f"{said if k % 2 else ' '.join(f'u{k}x{j}' for j in range(30))} end{k}" for k in range(2000)]
    hashed = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("text", "pmod(xxhash64(text), 65536) AS h").collect()
    groups = {}
    for x in hashed:
        groups.setdefault(x["h"], []).append(x["text"])
    mixed = [g for g in groups.values() if len({t.startswith("s0 ") for t in g}) == 2]
    assert mixed
    rows = [(1, said), *((None, t) for g in mixed for t in g)]
    out = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id IS NULL").collect()
    assert len(out) == len(rows) - 1
    assert sorted(x["kept_text"] for x in out) == sorted(t.removeprefix(said).strip() for _, t in rows[1:])


def test_matching_statistics():
    r = random.Random(1)
    for _ in range(200):
        known = ["".join(r.choice("ab") for _ in range(r.randrange(0, 12))) for _ in range(3)]
        automaton = SuffixAutomaton()
        for j, text in enumerate([*known, "".join(r.choice("abc") for _ in range(20))]):
            want = [max(n for n in range(i + 2) if text[i + 1 - n : i + 1] in text[:i] or any(text[i + 1 - n : i + 1] in k for k in known[:j])) for i in range(len(text))]
            assert list(automaton.add(text)) == want


# 7 mixing


def test_mix_meets_its_targets(spark):
    r = random.Random(7)
    names = [None, "b", "a", "c", "tiny"]
    sources = [r.choice(names[:4]) for _ in range(900)] + ["tiny"] * 3
    texts = [sentences(r, r.randrange(0, 40)) for _ in sources]
    out = mixing.mix(docs(spark, texts, source=sources), bucket_rows=16).collect()
    sizes = {s: sum(len(t.split()) for t, x in zip(texts, sources, strict=True) if x == s) for s in names}
    order, weights = sorted(n for n in names if n is not None) + [None], {}
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, capped = {}, 1.5 * sum(sizes.values()), set()
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in order if x not in capped) for s in order if s not in capped}
        over = {s for s in share if share[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
        left -= sum(2 * sizes[s] for s in over)
        target |= {s: 2 * sizes[s] for s in over}
    target |= share
    for s in names:
        mine = [x for x in out if x["source"] == s]
        assert all(x["target"] == pytest.approx(target[s]) and x["taken"] <= 2 * x["size"] for x in mine)
        assert abs(sum(x["taken"] for x in mine) - target[s]) <= 1
        assert all(x["taken"] >= x["epochs"] * x["size"] for x in mine)
    again = mixing.mix(docs(spark, texts, source=sources).repartition(3), bucket_rows=16)
    assert sorted((x["doc_id"], x["taken"]) for x in out) == sorted((x["doc_id"], x["taken"]) for x in again.collect())
    assert mixing.mix(odd(spark)).count() == 10 and mixing.mix(odd(spark).where("false")).count() == 0


# 8 decontamination


def edit_distance(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_leaks_are_those_of_brute_force(spark):
    r = random.Random(8)
    items = [(k, sentences(r, r.randrange(3, 40), 60)) for k in range(12)] + [(12, None), (13, " ?! "), (14, "Ünïcode wörds")]
    texts = []
    for _ in range(60):
        words = sentences(r, r.randrange(0, 80), 60).split()
        if r.random() < 0.6:
            item = r.choice(items[:12])[1].split()
            for _ in range(r.randrange(0, 1 + len(item) // 4)):
                at = r.randrange(len(item))
                item[at : at + 1] = r.choice(([], ["new"], [item[at], "more"]))
            at = r.randrange(len(words) + 1)
            words[at:at] = item
        texts.append(", ".join(words).capitalize())
    texts += [None, "", "x ünïcode wörds x", "x Ünïcode Wörds x"]
    df = docs(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = leaks.find(df, bench).collect()
    token = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for x in out:
        words = token.findall(lower(x["text"]))
        want = {}
        for item_id, text in items:
            if item := token.findall(lower(text)):
                d = edit_distance(item, words)
                if d <= int(len(item) * 0.2):
                    want[item_id] = d
        got = {}
        for m in x["leaks"]:
            got[m["item_id"]] = min(got.get(m["item_id"], 99), m["distance"])
            assert edit_distance(token.findall(lower(dict(items)[m["item_id"]])), token.findall(lower(x["text"][m["first"] : m["last"]]))) == m["distance"]
        assert got == want, x["text"]
    sharded = leaks.find(df, bench, shard_bytes=200).collect()
    by_id = lambda rows: sorted((x["doc_id"], x["leaks"]) for x in rows)
    assert by_id(sharded) == by_id(out)
    assert leaks.find(odd(spark).drop("leaks"), bench).count() == 10 and leaks.find(df, bench.where("false")).where("size(leaks) > 0").count() == 0


def test_repeated_passages_of_one_document(spark):
    items = [(1, "word"), (2, "one two three one two three")]
    texts = ["word " * 3000, "one two three " * 2000]
    out = leaks.find(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).orderBy("doc_id").collect()
    assert len(out[0]["leaks"]) == 3000 and len(out[1]["leaks"]) == 1000 and all(m["distance"] == 0 for x in out for m in x["leaks"])


def test_many_items_of_one_wording_and_of_a_common_piece(spark, monkeypatch):
    monkeypatch.setattr(leaks, "HITS", 500)
    words = sentences(random.Random(3), 10, 9999).split()
    items = [(k, " ".join(words)) for k in range(300)] + [(1000 + k, " ".join([*words[:9], f"x{k}"])) for k in range(200)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [" ".join(["y", *words, "z"] * 5), "nothing here", " ".join([*words[:9], "x7"])]
    out = {x["doc_id"]: x["leaks"] for x in leaks.find(docs(spark, texts), bench).collect()}
    assert len(out[0]) == 5 * 500 and out[1] == [] and len(out[2]) == 500
    assert sorted(m["item_id"] for m in out[2] if m["distance"] == 0) == [1007]
    one = {x["doc_id"]: x["leaks"] for x in leaks.find(docs(spark, texts), bench, every=False).collect()}
    assert {k: bool(v) for k, v in one.items()} == {0: True, 1: False, 2: True} and len(one[0]) < 2500
    entries, pieces = leaks.prepared(items, 0.2)
    assert len(entries) == 201 and len(entries[0].ids) == 300
    data = np.frombuffer(texts[0].encode(), np.uint8)
    held = Words(data, np.array([0, len(data)]), leaks.BETWEEN)
    parts = list(leaks._hits(held, held.hashes(), pieces, len(entries)))
    assert len(parts) > 2 and all(len(p) < 1500 for p in parts)
    whole = np.concatenate(parts)
    monkeypatch.setattr(leaks, "HITS", 10**9)
    assert np.array_equal(np.unique(whole, axis=0), next(leaks._hits(held, held.hashes(), pieces, len(entries))))


# 9 language


def test_language_on_held_out_rows(spark):
    r = random.Random(10)
    parts = {"en": "the and ing tion her", "de": "der sch ung keit über", "fr": "les eaux ment être qui", "es": "ción los mente que ñar"}
    langs = [list(parts)[k % 4] for k in range(400)]
    texts = [" ".join("".join(r.choice(parts[x].split()) for _ in range(r.randrange(1, 3))) for _ in range(25)) for x in langs]
    df = docs(spark, texts, lang=langs)
    model = language.train(df, F.col("doc_id") < 250)
    out = language.identify(df, model).where("doc_id >= 250").collect()
    assert sum(x["lang_pred"] == langs[x["doc_id"]] for x in out) >= 0.97 * len(out)
    told = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language.identify(spark.createDataFrame([(1, None), (2, ""), (3, "12 !? 34"), (4, "漢字")], "doc_id long, text string"), model).collect()}
    assert told[1] == told[2] == told[3] == ("und", 0.0) and told[4][0] in parts
    none = language.train(df.where("false"), F.lit(True))
    assert {x["lang_pred"] for x in language.identify(df, none).collect()} == {"und"}
    one = language.train(df.where("lang = 'de'"), F.lit(True))
    assert {x["lang_pred"] for x in language.identify(df, one).collect()} == {"de"}
    assert language.identify(odd(spark), model).count() == 10


def test_votes_are_those_of_brute_force(spark):
    r = random.Random(15)
    parts = {"en": "the and ing", "de": "der sch ung", "nl": "het een ijk", "fr": "les eaux qui", "es": "los que ñar", "qq": "zub wix"}
    langs = [list(parts)[k % 6] for k in range(90)]
    texts = [" ".join(r.choice(parts[x if r.random() < 0.7 else r.choice(list(parts))].split()) for _ in range(9)) for x in langs]
    df = docs(spark, texts, lang=langs)
    model = language.train(df, F.lit(True), rounds=15)
    families = sorted({*model.family.values()})
    for x in language.identify(df, model).collect():
        data = [b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in texts[x["doc_id"]].encode()]
        codes = [a << 16 | b << 8 | c for a, b, c in zip(data, data[1:], data[2:], strict=False) if (a, b, c) != (32, 32, 32)]
        at = [(c * 2654435761 % 2**32) >> 20 for c in codes]
        margin = {pair: sum(float(w[k]) for k in at) / len(at) * language.SCALE + float(b) for pair, w, b in zip(model.pairs, model.weights, model.biases, strict=True)}

        def best(names, margin=margin):
            wins = {n: (sum((m > 0) if n == a else (m < 0) for (a, b), m in margin.items() if n in (a, b) and {a, b} <= {*names}), sum(m if n == a else -m for (a, b), m in margin.items() if n in (a, b) and {a, b} <= {*names})) for n in names}
            return max(names, key=lambda n: wins[n])

        family = best(families)
        assert x["lang_pred"] == best([v for v in sorted(model.family) if model.family[v] == family])


def test_every_language_is_learnt(spark):
    langs = [f"x{k}" for k in range(45) for _ in range(4)]
    texts = [" ".join(f"{chr(97 + int(x[1:]) % 26) * 2}{chr(97 + int(x[1:]) // 26)}{'aeiou'[j % 5]}" for j in range(k % 4, k % 4 + 20)) for k, x in enumerate(langs)]
    df = docs(spark, texts, lang=langs)
    model = language.train(df, F.lit(True), rounds=20)
    assert set(model.family) == set(langs)
    assert [x["lang_pred"] for x in language.identify(df, model).orderBy("doc_id").collect()] == langs


def test_languages_of_copies_are_learnt(spark):
    langs = ["de"] * 60 + ["fr"] * 300 + ["en"] * 50
    texts = ["sch ung keit"] * 60 + ["eaux ment qui"] * 300 + [f"the ing {chr(97 + k % 26)}tion {chr(97 + k // 26)}her" for k in range(50)]
    df = docs(spark, texts, lang=langs)
    taken = [sorted(map(tuple, language.sample(df.select("lang", "text").repartition(n, "doc_id"), 3).collect())) for n in (1, 5)]
    assert taken[0] == taken[1] and [x for x, _ in taken[0]] == ["de", "en", "en", "en", "fr"]
    out = language.identify(df, language.train(df, F.lit(True), per_language=3)).collect()
    assert all(x["lang_pred"] == langs[x["doc_id"]] for x in out if langs[x["doc_id"]] != "en")


# 10 URLs


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://A.Example.ORG/es/x?q#f", "a.example.org", "/es/x", "example.org/es/", "block"),
        ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("https://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
        ("x://b.com/fr/", "b.com", "/fr/", "com/fr/", "allow"),
        ("x://b.com/de/9", "b.com", "/de/9", "com/de/", "block"),
        ("http://a.org", "a.org", "", None, None),
        ("http://a.org?x://y/de/", "a.org", "", None, None),
        ("no scheme", "", "", None, None),
        ("", "", "", None, None),
        (None, "", "", None, None),
    ],
)
def test_url_rules(spark, url, host, path, rule, verdict):
    model = (-1.0, [0.0] * 16)
    x = urls.judge(spark.createDataFrame([(1, url, 5)], "page_id long, url string, score int"), model).first()
    assert (x["host"], x["path"], x["rule"], x["verdict"]) == (host, path, rule, verdict or "allow")


def test_url_model_on_unseen_hosts(spark):
    model = urls.train(urls.labelled_urls(spark))
    names = {1: ("super-casino", "freepoker", "hotadult", "lottery-win", "payday-cash", "best-viagra"), 0: ("city-library", "tech-news", "my-recipes", "open-science", "gardentips", "schoolbooks", "quxvanto", "zz9")}
    rows = [(k, y, f"http://{name}.example.net/{'en/3' if k % 2 else 'x.html?q=1'}") for y, own in names.items() for k, name in enumerate(own)]
    out = urls.judge(spark.createDataFrame(rows, "page_id long, y int, url string").withColumn("page_id", F.col("page_id") * 2 + F.col("y")), model, ()).collect()
    assert all((x["verdict"] == "block") == bool(x["page_id"] % 2) for x in out)
    assert urls.train(urls.labelled_urls(spark).where("label = 0"))[0] == 0.0


def test_hosts_and_paths_that_the_model_has_not_seen(spark):
    """Every fourth word and path is held out: their hosts and paths are judged by what resembles them."""
    rows = urls.labelled_rows()
    kept, out = [r for r in rows if r[2] % 4 != 1], [r for r in rows if r[2] % 4 == 1]
    model = urls.train(spark.createDataFrame([(u, y) for u, y, _ in kept], "url string, label int"))
    judged = urls.judge(spark.createDataFrame([(k, r[0]) for k, r in enumerate(out)], "page_id long, url string"), model, ()).collect()
    shares = {}
    for x in judged:
        url, label, _ = out[x["page_id"]]
        kind = "good" if not label else "host" if any(w in x["host"] for w in urls.UNWANTED) else "path"
        shares.setdefault(kind, []).append(x["verdict"] == "block")
    share = {k: sum(v) / len(v) for k, v in shares.items()}
    assert share["host"] > 0.5 and share["path"] > 0.75 and share["good"] < 0.03


def test_url_scores_are_those_of_brute_force(spark):
    bias, weights = model = urls.train(urls.labelled_urls(spark), slots=256, rounds=5)
    links = ["http://Ab.example.net/x/1?q", "https://casino.example.org", "x", None, "http://é漢.org/ü#f"]
    for url, x in zip(links, urls.judge(spark.createDataFrame([(k, u) for k, u in enumerate(links)], "page_id long, url string"), model, ()).orderBy("page_id").collect(), strict=True):
        rest = (url or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        marked = ("\x02" + "".join(c.lower() if "A" <= c <= "Z" else c for c in host) + "\x03", "\x04" + path + "\x05")
        grams = [t[i : i + n] for t in marked for n in (3, 4) for i in range(len(t) - n + 1)]
        at = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "g string").selectExpr("pmod(xxhash64(g), 256)").collect()] if grams else []
        z = bias + sum(weights[k] for k in at) / max(1, len(at)) ** 0.5
        assert x["score"] == pytest.approx(1 / (1 + math.exp(-z))), url
