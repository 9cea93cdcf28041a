"""Personal data: rule-based seeds, and bootstrapped contextual extraction of what the rules miss.

Each seed entity and each identifier-like token votes for the lexical patterns around it (word
before, word after, both). Spark scores patterns and instances in turn over that graph: a
pattern by the share of its distinct instances that are of a kind, an instance by its patterns.
A pattern that would pass on identifier-like tokens alone is counted once more over all words
of the corpus. What is learnt is a seed of the next round, until nothing more is learnt.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import WORD, dropped, written
from .words import extend, map_blocks, summed

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(WORD)
DIGIT = re.compile(r"[0-9]")
#: What makes a token identifier-like: a digit or @, or other marks between other characters.
INNER = re.compile(r"[0-9@]|[^\x20\x09-\x0D._:/+#-][._:/+#-]+[^\x20\x09-\x0D._:/+#-]")
EDGES = "\"'`()[]{}<>.,;:!?"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER = str.maketrans(UPPER, LOWER)

FOUND = "first bigint, last bigint, kind string, instance string, before string, after string"
#: Added spans of about so many bytes are sent to all executors; more are joined by a shuffle.
BROADCAST_BYTES = 8_000_000
#: Words of at most so many patterns are looked up as the texts are read; those of more meet in a join only.
LOOKED_UP = 10_000
#: One of so many texts gives a lower bound of a pattern's size, which can only rule it out.
SLICES = 64


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, done, seen, at = [], 0, 0, text.find("@")
    while at >= 0:
        run = text[max(done, seen) : at]
        first = at - len(run) + len(run.rstrip(LOCAL))
        if first < at and (domain := DOMAIN.match(text, at + 1)):
            out.append((first, domain.end()))
            done = domain.end()
        seen = at + 1
        at = text.find("@", max(seen, done))
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    out = []
    for run in DOTTED.finditer(text):
        parts, first = run.group().split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            last = first + sum(map(len, four)) + 3
            if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in four):
                out.append((first, last))
            first = last + 1
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(first, last, kind) by the rules, by first, then kind in the order of KINDS."""
    out = [(a, b, 0) for a, b in emails(text)]
    if DIGIT.search(text):
        out += [(a, b, 1) for a, b in addresses(text)]
        for m in NUMBER.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        for m in DIALLED.finditer(text):
            if 9 <= len(DIGIT.findall(m.group())) <= 15:
                out.append((m.start(), m.end(), 3))
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda s: (s[0], s[2]))]


def _said(token: str) -> str:
    return (token.strip(EDGES) or token).translate(_LOWER)


def said(token: Column) -> Column:
    """The same of a column."""
    bare = F.btrim(token, F.lit(EDGES))
    return F.translate(F.when(bare == "", token).otherwise(bare), UPPER, LOWER)


def entities(text: str) -> list[tuple]:
    """Seeds (with their kind) and identifier-like tokens (kind null): (first, last, kind, instance, word before, word after)."""
    if not INNER.search(text):
        return []
    base, tokens = base_spans(text), [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    starts, ends = [a for a, _ in tokens], [b for _, b in tokens]

    def around(first: int, last: int) -> tuple[str, str]:
        k, n = bisect_left(ends, first + 1) - 1, bisect_left(starts, last)
        return _said(text[tokens[k][0] : tokens[k][1]]) if k >= 0 else "^", _said(text[tokens[n][0] : tokens[n][1]]) if n < len(tokens) else "$"

    out = [(a, b, kind, text[a:b].translate(_LOWER), *around(a, b)) for a, b, kind in base]
    reach, k, searched = 0, 0, -1
    for a, b in tokens:
        while k < len(base) and base[k][0] < b:
            reach, k = max(reach, base[k][1]), k + 1
        if a > searched:  # where the next token of the kind is
            m = INNER.search(text, a)
            searched = m.end() - 1 if m else len(text)
        if reach > a or b <= searched:
            continue
        token = text[a:b]
        a += len(token) - len(token.lstrip(EDGES))
        b -= len(token) - len(token.rstrip(EDGES))
        if b - a >= 4 and INNER.search(text, a, b):
            out.append((a, b, None, text[a:b].translate(_LOWER), *around(a, b)))
    return out


def _entities(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    out: list[list] = [[] for _ in range(8)]
    for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        for found in entities(data[a:b].tobytes().decode("utf-8", "replace")):
            for column, value in zip(out, (rows.column("one")[k].as_py(), rows.column("two")[k].as_py(), *found), strict=True):
                column.append(value)
    kinds = [pa.int64()] * 4 + [pa.string()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["one", "two", "first", "last", "kind", "instance", "before", "after"])


def _base(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    held = summed(((data >= 48) & (data <= 57)) | (data == 64), offsets) > 0
    found = [base_spans(data[a:b].tobytes().decode("utf-8", "replace")) if some else [] for a, b, some in zip(offsets[:-1], offsets[1:], held, strict=True)]
    return [pa.array([[{"first": a, "last": b, "kind": kind} for a, b, kind in own] for own in found], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("kind", pa.string())])))]


def patterns(before: Column, after: Column) -> Column:
    return F.array(F.concat(F.lit("< "), before), F.concat(F.lit("> "), after), F.concat(F.lit("= "), before, F.lit(" "), after))


def all_fillers(texts: DataFrame, known: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pattern, size): how many distinct instances, ``known`` ones and single words of ``texts`` (text), stand in each wanted pattern."""
    words = texts.where("text IS NOT NULL").select(F.transform(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), said).alias("words"))
    # an index below 0 or beyond the end gives null
    around = F.transform("words", lambda word, at: F.struct(F.get("words", at - 1).alias("before"), word.alias("instance"), F.get("words", at + 1).alias("after")))
    around = F.transform(around, lambda x: F.struct(F.coalesce(x["before"], F.lit("^")).alias("before"), x["instance"].alias("instance"), F.coalesce(x["after"], F.lit("$")).alias("after")))
    looked_up = wanted.limit(LOOKED_UP + 1).collect()
    if len(looked_up) <= LOOKED_UP:
        words_of = {mark: {x["pattern"][2:].split(" ")[0] for x in looked_up if x["pattern"][0] in mark} for mark in ("<=", ">")}
        around = F.filter(around, lambda x: x["before"].isin(*words_of["<="]) | x["after"].isin(*words_of[">"]))
    edges = words.select(F.inline(around)).select("instance", F.explode(patterns(F.col("before"), F.col("after"))).alias("pattern"))
    return edges.unionByName(known).join(wanted, "pattern", "left_semi").groupBy("pattern").agg(F.count_distinct("instance").alias("size"))


def accepted(found: DataFrame, texts: DataFrame, *, least_seeds: int = 5, confidence: float = 0.7, seed_trust: float = 0.8) -> DataFrame:
    """Spans that the patterns add: one, two, first, last, kind. ``found``: one, two, first, last, kind, instance, before, after.

    An instance keeps the kind and trust with which it was learnt, and counts as a seed from
    ``seed_trust`` on. Votes only grow, so it ends: when no more instance is learnt.
    """
    graph = found.select("one", "two", "first", "last", "kind", "instance", F.explode(patterns(F.col("before"), F.col("after"))).alias("pattern"))
    edges = written(graph.select("pattern", "instance", "kind").distinct())
    instances = edges.select("pattern", "instance").distinct()
    sizes = written(instances.groupBy("pattern").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least_seeds))
    part = all_fillers(texts.where(F.pmod(F.xxhash64("text"), F.lit(SLICES)) == 0), instances, sizes.select("pattern"))
    least = written(part)
    seeds = written(edges.where("kind IS NOT NULL").select("instance", "kind").distinct().withColumn("trust", F.lit(1.0)))
    unseen = edges.where("kind IS NULL").select("pattern", "instance")
    known, learnt, counted = seeds, None, None
    while True:
        votes = instances.join(known, "instance").groupBy("pattern", "kind")
        votes = votes.agg(F.sum("trust").alias("votes"), F.count(F.when(F.col("trust") >= seed_trust, 1)).alias("seeds"))
        # these sizes leave the plain words of most texts out, so what fails here fails
        able = written(votes.where(F.col("seeds") >= least_seeds).join(least, "pattern").where(F.col("votes") / (F.col("size") + 1) >= confidence).select("pattern", "kind", "votes"))
        new = able.select("pattern").distinct()
        new = written(new if counted is None else new.join(counted, "pattern", "left_anti"))
        if counted is None or not new.isEmpty():
            more = written(all_fillers(texts, instances, new)) if not new.isEmpty() else written(sizes.where("false"))
            counted = more if counted is None else written(more.unionByName(counted))
        trusted = able.join(counted, "pattern").withColumn("trust", F.col("votes") / (F.col("size") + 1)).where(F.col("trust") >= confidence)
        trusted = written(trusted.select("pattern", "kind", "trust"))
        best = unseen.join(trusted, "pattern").groupBy("instance").agg(F.max(F.struct("trust", "kind")).alias("best")).select("instance", "best.kind", (F.col("best.trust") * 0.999).alias("trust"))
        fresh = written(best if learnt is None else best.join(learnt.select("instance"), "instance", "left_anti"))
        dropped(able, new)
        done = fresh.isEmpty()
        learnt = fresh if learnt is None else learnt if done else written(learnt.unionByName(fresh))
        if done:
            break
        dropped(trusted)
        known = seeds.unionByName(learnt.join(seeds.select("instance"), "instance", "left_anti").select("instance", "kind", "trust"))
    there = graph.where("kind IS NULL").drop("kind").join(trusted.select("pattern", "kind"), "pattern")
    out = written(there.join(learnt.select("instance", "kind"), ["instance", "kind"], "left_semi").select("one", "two", "first", "last", "kind").distinct())
    dropped(edges, sizes, least, seeds, trusted, counted, learnt)
    return out


def find(docs: DataFrame, *, text: str = "text", column: str = "private", keep_text: bool = True, least_seeds: int = 5, confidence: float = 0.7, seed_trust: float = 0.8) -> DataFrame:
    """``docs`` (without the text, unless ``keep_text``) with ``column``: an array of (first, last, kind, added), by first, kind and last.

    Spans are code points, end exclusive. The rules' spans are always there; ``added`` marks
    those that patterns brought: identifier-like tokens (four or more characters with a
    digit, an @, or one of ``._:/+#-`` inside) in a context where at least ``least_seeds``
    distinct seeds of a kind, and ``confidence`` of all distinct words, stand; what was
    learnt with a trust of ``seed_trust`` is a seed then. Null and empty texts hold none;
    equal texts hold the same, as texts are told apart by two 64-bit hashes; a corpus
    without seeds adds nothing.
    """
    one, two = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    texts = docs.select(F.col(text).alias("text"))
    found = written(map_blocks(texts.select("text", F.xxhash64("text").alias("one"), F.xxhash64(F.lit(1), "text").alias("two")), "text", _entities, f"one bigint, two bigint, {FOUND}"))
    more = accepted(found, texts, least_seeds=least_seeds, confidence=confidence, seed_trust=seed_trust)
    held, added = f"{column}_found", f"{column}_added"
    kind = "array<struct<first: bigint, last: bigint, kind: string>>"
    out = extend(docs, text, _base, {held: kind})
    if more.isEmpty():
        out = out.withColumn(added, F.array().cast(kind))
    else:
        size = more.agg(F.sum(F.lit(60) + F.octet_length("kind"))).first()[0]
        spans = written(more.groupBy(F.col("one").alias(f"{column}_one"), F.col("two").alias(f"{column}_two")).agg(F.collect_list(F.struct("first", "last", "kind")).alias(added)))
        beside = F.broadcast(spans) if size <= BROADCAST_BYTES else spans
        out = out.join(beside, (one == F.col(f"{column}_one")) & (two == F.col(f"{column}_two")), "left").drop(f"{column}_one", f"{column}_two")
    dropped(found, more)
    place = F.array(*map(F.lit, KINDS))

    def ordered(spans: str, is_added: bool) -> Column:
        known = F.coalesce(spans, F.array().cast(kind))
        return F.transform(known, lambda x: F.struct(x["first"].alias("first"), F.array_position(place, x["kind"]).alias("place"), x["last"].alias("last"), x["kind"].alias("kind"), F.lit(is_added).alias("added")))

    every = F.array_sort(F.concat(ordered(held, False), ordered(added, True)))
    out = out.withColumn(column, F.transform(every, lambda x: F.struct(x["first"], x["last"], x["kind"], x["added"]))).drop(held, added)
    return out if keep_text else out.drop(text)


def _redacted(text: str, column: str):
    def work(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        spans, out = rows.column(column).to_pylist(), rows.column(text).to_pylist()
        for k in (k for k, own in enumerate(spans) if own):
            pieces, done = [], 0
            for x in spans[k]:
                if x["first"] >= done:
                    pieces += [out[k][done : x["first"]], f"[{x['kind'].upper()}]"]
                done = max(done, x["last"])
            out[k] = "".join([*pieces, out[k][done:]])
        return [pa.array(out, pa.string())]

    return work


def redact(docs: DataFrame, *, text: str = "text", column: str = "private") -> DataFrame:
    """Spans in ``column`` become ``[KIND]``; what overlaps an earlier span goes with it. Drops ``column``."""
    name = f"{column}_redacted"
    return extend(docs, text, _redacted(text, column), {name: "string"}).withColumn(text, F.col(name)).drop(column, name)


def digest(spans, all_spans: bool):
    """kind:start:end, comma-joined: of all spans, or of the rules' only."""
    spans = spans if all_spans else F.filter(spans, lambda x: ~x["added"])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["first"].cast("string"), x["last"].cast("string"))), ",")
