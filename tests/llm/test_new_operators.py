"""Merkle manifest, SimHash and whitening against brute force; and odd inputs."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftgraph.llm import merkle, queries, simhash, whitening

from test_operators import SPLIT, odd

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

# 11 Merkle manifest


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def brute_levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def brute_manifest(rows):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of rows of DOCS."""

    def leaf(doc_id, text, lang, source, n_chars):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))

    groups = {}
    for r in rows:
        more = r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
        groups.setdefault(r[2], []).append((r[0], leaf(*r), leaf(*r[:4], r[4] + more if r[4] is not None else None)))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = brute_levels([x[1] for x in groups[g]])
    top = brute_levels([trees[g][-1][0] for g in langs])
    out = []
    for number, g in enumerate(langs):
        for k, (doc_id, own, changed) in enumerate(groups[g]):
            steps = []
            for levels, at in ((trees[g], k), (top, number)):
                for level in levels[:-1]:
                    pair = level[at & ~1 : (at & ~1) + 2]
                    steps.append((at % 2, pair[:0] if len(pair) < 2 else [pair[1 - at % 2]]))
                    at //= 2
            node = changed
            for right, others in steps:
                node = h(*others, node) if right else h(node, *others)
            out.append((doc_id, own, trees[g][-1][0], top[-1][0], h(*(x for _, o in steps for x in o)), node, node == top[-1][0]))
    return sorted(out, key=repr)


def manifest_rows(spark, rows, **how):
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = {"n_chars": F.when(touched, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    return merkle.manifest(spark.createDataFrame(rows, DOCS), changed=changed, **how)


def some_docs(r, n, langs):
    return [(k, r.choice([None, "", "é ß 漢字 👍", f"text {k}", "x" * 300]), r.choice(langs), r.choice([None, "a", "b:c"]), r.choice([None, 0, 9, 99])) for k in range(n)]


@pytest.mark.parametrize("n, levels", [(1, 12), (2, 12), (73, 2), (300, 3), (40, 12)])
def test_the_manifest_is_that_of_brute_force(spark, n, levels):
    r = random.Random(n)
    rows = some_docs(r, n, ["en", "en", "en", "en", "", None, "de", "é", "-", "z:1"])
    out = manifest_rows(spark, rows, levels=levels).drop("proof").collect()
    assert sorted((tuple(x) for x in out), key=repr) == brute_manifest(rows)


def test_superblocks_in_the_tasks_and_several_rounds(spark):
    assert merkle._levels(list("abc"), 3, 12) == [list("abc"), [h("a", "b"), h("c")], [h(h("a", "b"), h("c"))]]
    r = random.Random(4)
    rows = some_docs(r, 9000, ["en"] * 40 + ["de", None])
    out = manifest_rows(spark, rows, proofs=False).collect()
    assert sorted((tuple(x) for x in out), key=repr) == brute_manifest(rows)


def test_proofs_fold_to_the_root(spark):
    rows = some_docs(random.Random(5), 50, ["en", "de", None])
    out = manifest_rows(spark, rows)
    folded = out.select(merkle.fold(F.col("leaf"), F.col("proof")).alias("up"), "root").collect()
    assert len(folded) == 50 and all(x["up"] == x["root"] for x in folded)
    longer = out.select(merkle.fold(F.sha2(F.lit("other"), 256), F.col("proof")).alias("up"), "root").collect()
    assert all(x["up"] != x["root"] for x in longer)


def test_a_manifest_of_odd_rows(spark):
    same = [(None, "a", "en", None, None)] * 3 + [(5, "b", "en", "s", 1), (5, "b", "en", "s", 1), (5, "c", "en", "s", 1), (2**62 + 1, None, None, None, None)]
    out = manifest_rows(spark, same, proofs=False).collect()
    assert sorted((tuple(x) for x in out), key=repr) == brute_manifest(same)
    assert manifest_rows(spark, same).where("false").count() == 0
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
    clash = odd(spark).withColumn("n_chars", F.length("text")).withColumn("grp", F.lit(1)).withColumn("pos", F.lit(2)).withColumn("digest", F.lit("d"))
    assert merkle.manifest(clash).where("verified").count() == 10


# 12 SimHash


def brute_fingerprint(text, n):
    words = SPLIT.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def brute_components(codes, distance):
    root = {c: c for c in codes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    every = sorted(root)
    for i, a in enumerate(every):
        for b in every[:i]:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {c: find(c) for c in every}


def test_fingerprints_and_components_are_those_of_brute_force(spark):
    r, texts = random.Random(12), []
    for _ in range(40):
        base = [f"v{r.randrange(3000)}" for _ in range(r.choice([2, 3, 4, 5, 40, 300]))]
        for _ in range(r.randrange(1, 6)):
            copy = list(base)
            for _ in range(r.randrange(0, 3)):
                copy[r.randrange(len(copy))] = "Émile" if r.random() < 0.5 else "x"
            texts.append(r.choice([" ", "\t\n "]).join(copy))
    texts += [None, "", " \n", texts[0].upper(), "one", "one"]
    out = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shingle=4, distance=4).collect()
    codes = [brute_fingerprint(t, 4) for t in texts]
    of = brute_components(codes, 4)
    least = {}
    for k, c in enumerate(codes):
        least[of[c]] = min(k, least.get(of[c], k))
    assert {(x["doc_id"], x["fingerprint"], x["component_id"]) for x in out} == {(k, f"{c:016x}", least[of[c]]) for k, c in enumerate(codes)}


def code_sets(r):
    """Spread codes with neighbours at 0 to 6 bits, chains, and a dense ball."""
    out = set()
    for _ in range(150):
        c = r.getrandbits(64)
        for _ in range(r.randrange(1, 5)):
            out.add(c)
            for b in r.sample(range(64), r.randrange(0, 7)):
                c ^= 1 << b
    centre = r.getrandbits(64)
    for _ in range(300):
        out.add(centre ^ sum(1 << b for b in r.sample(range(0, 40, 2), r.randrange(0, 9))))
    few = r.sample(range(64), 7)
    far = r.getrandbits(64)
    out |= {far ^ sum((k >> i & 1) << b for i, b in enumerate(few)) for k in range(128)}
    return sorted(out)


@pytest.mark.parametrize("seed, distance", [(1, 4), (2, 4), (3, 0), (4, 1), (5, 6)])
def test_the_index_finds_all_links(seed, distance):
    codes = code_sets(random.Random(seed))
    index = simhash.GrayIndex(np.array(codes, np.uint64))
    assert [a ^ b for a, b in zip(*[iter(simhash.gray_rank(np.array([0, 1, 3, 2], np.uint64)).tolist())] * 2, strict=True)] == [1, 1]
    forest = index.links(distance)
    assert all((int(a) ^ int(b)).bit_count() <= distance for a, b in forest)
    want, found = brute_components(codes, distance), {c: c for c in codes}
    for a, b in forest.tolist():
        x, y = found[a], found[b]
        assert x != y  # a forest
        found = {c: min(x, y) if v in (x, y) else v for c, v in found.items()}
    assert found == want


def test_search_prunes_whole_groups():
    r = random.Random(8)
    codes = np.array([r.getrandbits(64) for _ in range(4096)], np.uint64)
    index = simhash.GrayIndex(np.unique(codes))
    assert [len(m) for m in index.mask] == [4096, 512, 64, 8, 1]
    # masks of a path are disjoint and together the code's 64 bits
    for at in range(0, 4096, 511):
        masks = [int(index.mask[k][at // 8**k]) for k in range(5)]
        assert sum(m.bit_count() for m in masks) == 64 and not (masks[0] & masks[1])
        assert sum(int(index.pattern[k][at // 8**k]) for k in range(5)) == int(index.codes[at])


@pytest.mark.parametrize("group", [16, 100])
def test_groups_that_are_dealt_again(spark, monkeypatch, group):
    """Many small groups in rounds find what one large group finds."""
    monkeypatch.setattr(simhash, "GROUP", group)
    codes = code_sets(random.Random(20 + group))
    df = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "code long")
    want, found = brute_components(codes, 4), {c: c for c in codes}
    for a, b in simhash.linked_codes(df, 4).collect():
        a, b = a % (1 << 64), b % (1 << 64)
        assert (a ^ b).bit_count() <= 4
        x, y = found[a], found[b]
        found = {c: min(x, y) if v in (x, y) else v for c, v in found.items()}
    assert found == want


def test_simhash_of_odd_rows(spark):
    out = simhash.near_duplicates(odd(spark)).collect()
    by_id = {x["doc_id"]: x for x in out}
    assert len(out) == 10 and by_id[5]["component_id"] == 4 and by_id[2]["component_id"] == 1 == by_id[3]["component_id"]
    assert by_id[1]["fingerprint"] == "0" * 16 and by_id[7]["component_id"] == 6
    assert by_id[None]["component_id"] is None
    assert simhash.near_duplicates(odd(spark).where("false")).count() == 0


# 13 whitening


def whitened(spark, rows, **how):
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int"), **how)
    return out, out.collect()


def brute_whitening(vectors, k):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s) / n
    values, found = np.linalg.eigh(centred.T @ centred / n)
    values, found = values[::-1][:k], found[:, ::-1][:, :k]
    found = found * np.sign(found[np.abs(found).argmax(axis=0), np.arange(k)])
    trace = (centred**2).sum() / n
    deviation = [sum(int(v) ** 2 for v in row) for row in (n * x - s)]
    return deviation, centred @ found / np.sqrt(values), values / trace


@pytest.mark.parametrize("n, dim, k", [(200, 20, 8), (50, 3, 8), (9, 30, 4), (300, 1, 8)])
def test_whitening_is_that_of_an_eigenvalue_solver(spark, n, dim, k):
    r = np.random.default_rng(n)
    data = (r.standard_normal((n, dim)) * np.linspace(2, 0.1, dim) + r.standard_normal(dim)).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(data)]
    bad = [(-1, None, 1), (-2, [None] + [1.0] * (dim - 1), 1), (-3, [float("nan")] * dim, 1), (-4, [float("inf")] * dim, 1), (-5, [1.0] * (dim + 1), 1)]
    _, out = whitened(spark, rows + bad, components=k)
    k = min(k, dim, n - 1)
    deviation, coordinates, explained = brute_whitening(data, k)
    assert len(out) == n * k and {x["component"] for x in out} == set(range(1, k + 1)) and {x["n"] for x in out} == {n}
    for x in out:
        assert x["deviation"] == deviation[x["vec_id"]]
        assert x["whitened"] == pytest.approx(coordinates[x["vec_id"], x["component"] - 1], abs=1e-8)
        assert x["explained"] == pytest.approx(explained[x["component"] - 1], rel=1e-9)
        assert 0 <= x["identity_error"] < 1e-10


def test_bidiagonalisation_of_flat_and_repeated_spectra():
    r = np.random.default_rng(3)
    for values in ([5, 5, 5, 1, 1, 0, 0, 0], [1.0] * 8, [1e6, 1, 1e-3, 1e-4, 0, 0, 0, 0]):
        x = np.linalg.qr(r.standard_normal((40, 8)))[0] * values @ np.linalg.qr(r.standard_normal((8, 8)))[0]
        got, found = whitening.bidiagonalised(lambda c: (x.T @ (x @ c), float((x @ c) @ (x @ c))), 8, 8)  # noqa: B023
        want = np.array([v for v in np.linalg.svd(x)[1] if v > 1e-9 * max(values)])
        assert np.allclose(got, want, rtol=1e-9, atol=1e-11 * max(values))
        assert np.allclose(found.T @ found, np.eye(len(got)), atol=1e-12)
        assert np.allclose(np.linalg.norm(x @ found, axis=0), got, rtol=1e-9, atol=1e-11 * max(values))


def test_whitening_of_odd_rows(spark):
    _, out = whitened(spark, [(None, [1.0, 2.0], 1), (1, [1.0, 3.0], 1), (1, [1.0, 3.0], 1), (2, [2.0, 2.0], 1)])
    assert len(out) == 8 and sum(x["vec_id"] is None for x in out) == 2
    assert whitened(spark, [(1, [1.0, 2.0], 1)])[1] == [] and whitened(spark, [(1, None, 1)])[1] == [] and whitened(spark, [])[1] == []
    assert whitened(spark, [(k, [1.0, 2.0], 1) for k in range(5)])[1] == []
    frame, out = whitened(spark, [(1, [3e38, 1.0], 1), (2, [-3e38, 1.5], 1), (3, [7.0, 1e30], 1)])
    assert len(out) == 6 and frame.schema["deviation"].dataType.simpleString() == "decimal(38,0)"
    x = [[(1 << 44) + 100_000, 101_024], [-(1 << 44) + 100_000, 101_536], [107_168, (1 << 44) + 100_000]]
    total = [sum(c) for c in zip(*x, strict=True)]
    assert {(v["vec_id"], int(v["deviation"])) for v in out} == {(k + 1, sum((3 * a - t) ** 2 for a, t in zip(row, total, strict=True))) for k, row in enumerate(x)}


def test_the_query_has_the_types_of_its_contract(spark):
    kinds = dict(queries.op13_embedding_whitening(spark, "/root/testdata/sf0.001").dtypes)
    assert kinds["deviation"] == kinds["n"] == "bigint" and kinds["component"] == "int" and kinds["whitened"] == "double"
