"""Folders of files, scripts, and chunks of texts."""

import random
import re

from pyspark.sql import functions as F

from weftgraph.operators import code, text
from weftgraph.sources import files

SCRIPT = """import { a } from './a';
const b = require("b");
export class Shop extends Base implements Open {
  #stock = 1;
  private async load(id: string): Promise<void> {
    if (id) {
    }
  }
}
export interface Named extends Other { }
enum Color { Red }
type Pair = [number, number];
export const add = (x, y) => x + y;
async function main() {
}
"""


def test_folder(spark, tmp_path):
    root = tmp_path / "repo"
    for name, data in {"a/x.py": b"x = 1\n", "node_modules/y.js": b"1", ".git/z.py": b"1", "big.py": b"#" * 300_000, "latin.md": "caf\xe9".encode("latin-1"), "skip/k.py": b"1", "note.txt": b"1"}.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    found = {r["file_path"]: (r["language"], r["content"]) for r in files.read_folder(spark, str(root), ignore=["skip/"]).collect()}
    assert found == {"a/x.py": ("python", "x = 1\n"), "latin.md": ("markdown", "café")}


def test_changed_files(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1")], "file_path string, content string")
    b = spark.createDataFrame([("x", "1"), ("y", "2"), ("w", "1")], "file_path string, content string")
    assert {tuple(r) for r in files.changed_files(a, b).collect()} == {("y", "modified"), ("z", "deleted"), ("w", "added")}


def test_script_symbols(spark):
    df = spark.createDataFrame([("s.ts", SCRIPT)], "file_path string, content string")
    found = {r["name"]: (r["kind"], r["visibility"], r["is_async"], list(r["bases"])) for r in code.script_symbols(df).collect()}
    assert found["Shop"] == ("class", "public", False, ["Base"]) or found["Shop"][3][0] == "Base"
    assert found["load"][:3] == ("method", "private", True)
    assert found["Named"][0] == "interface" and found["Color"][0] == "enum" and found["Pair"][0] == "type_alias"
    assert found["add"][0] == "function" and found["main"][:3] == ("function", "public", True) and "if" not in found
    assert {r["module"] for r in code.script_imports(df).collect()} == {"./a", "b"}


def test_text_chunks(spark):
    long = "\n".join(f"line {k} of a long paragraph" for k in range(40))
    rows = [("a.md", "# One\nx\n\n# Two\ny"), ("b.yaml", "k: 1\nj:\n  - 2"), ("c.json", "{}"), ("d.txt", "p\n\n" + long)]
    df = spark.createDataFrame(rows, "file_path string, content string")
    out = code.text_chunks(df, 60).collect()
    texts = {p: t for p, t in rows}
    for r in out:
        assert r["content"].strip() in texts[r["file_path"]] and len(r["content"]) // 4 <= 80
        assert "\n".join(texts[r["file_path"]].split("\n")[r["start_line"] - 1 : r["end_line"]]).strip() == r["content"].strip()
    assert sum(r["file_path"] == "a.md" for r in out) == 2 and sum(r["file_path"] == "b.yaml" for r in out) == 2
    for path, content in rows:
        lines = {n for r in out if r["file_path"] == path for n in range(r["start_line"], r["end_line"] + 1)}
        assert all(k + 1 in lines for k, line in enumerate(content.split("\n")) if line.strip())


def test_documents_from_sections(spark):
    sections = [("d", "b_x", "see {{ref:a}}, {{ref:nope}}, {{ref:later}} {{ref:a}}"), ("d", "z", "{{ref:b_x}}"), ("d", "a", "A"), ("d", "late", None), (None, "b_x", "{{ref:a}}"), ("e", "a", "1"), ("e", "a", "2")]
    template = [("d", "a", 2, "First", 1), ("d", "b_x", 1, None, None), ("d", "later", 3, None, 2), (None, "a", 1, "T", 3), ("d", "a", 9, "Other", 4)]
    out = text.assembled(spark.createDataFrame(sections, "document string, section string, content string"), spark.createDataFrame(template, "document string, section string, place int, title string, level int"))
    got = {(r["document"], r["position"]): (r["section"], r["entry"], r["content"]) for r in out.collect()}
    assert got == {
        ("d", 1): ("b_x", "- [B X](#b-x)", "## B X\n\nsee [A](#a), {{ref:nope}}, [Later](#later) [A](#a)\n"),
        ("d", 2): ("a", "- [First](#a)", "# First\n\nA\n"),
        ("d", 3): ("z", "- [Z](#z)", "## Z\n\n[B X](#b-x)\n"),
        (None, 1): ("b_x", "- [B X](#b-x)", "## B X\n\n[A](#a)\n"),
        ("e", 1): ("a", "- [A](#a)", "## A\n\n2\n"),
    }
    assert text.assembled(spark.createDataFrame([], "document string, section string, content string"), out.select("document", "section", F.lit(1).alias("place"), "title", "level")).isEmpty()


def split_by_hand(content, budget):
    """(first line, last line, text) of the pieces, counted from 0."""
    limit = max(1, int(0.95 * budget))
    lines = content.split("\n")
    if len(content) // 4 <= budget:
        return [(0, len(lines) - 1, content)]
    cuts = [0, *(k for k, line in enumerate(lines) if k and re.match(r"\s*(?:(?:if|elif|else|for|while|try|except|finally|with|match|case|def|class)\b|async def\b)", line)), len(lines)]
    parts = []
    for a, b in zip(cuts, cuts[1:]):
        if parts and len("\n".join(lines[parts[-1][0] : b])) // 4 <= limit:
            parts[-1] = (parts[-1][0], b)
        else:
            parts.append((a, b))
    out = []
    for a, b in parts:
        if len("\n".join(lines[a:b])) // 4 <= limit:
            out.append((a, b - 1, "\n".join(lines[a:b])))
            continue
        start = a
        for k in range(a, b):
            if len(lines[k]) > 4 * limit:
                out += [(start, k - 1, "\n".join(lines[start:k]))] * (start < k)
                out += [(k, k, lines[k][i : i + 4 * limit]) for i in range(0, len(lines[k]), 4 * limit)]
                start = k + 1
            elif start < k and len("\n".join(lines[start : k + 1])) // 4 > limit:
                out.append((start, k - 1, "\n".join(lines[start:k])))
                start = k
        out += [(start, b - 1, "\n".join(lines[start:b]))] * (start < b)
    return out


def test_long_chunks_are_split_at_control_flow(spark):
    r = random.Random(5)
    heads = ["if x:", "  for a in b:", "    return 1", "plain", "iffy = 1", "  async def f():", "\telse:", "", "w" * 90, "y" * 200]
    rows = [(f"{k}.py", 5, 99, f"s{k}", "\n".join(r.choice(heads) + "z" * r.randint(0, 9) for _ in range(r.randint(1, 40)))) for k in range(40)]
    rows += [rows[0], ("none.py", 1, 1, "n", None), ("empty.py", 1, 1, "e", ""), ("line.py", 1, 1, "l", "q" * 500), ("blank.py", 1, 400, "b", "\n" * 399)]
    out = code.fitted_chunks(spark.createDataFrame(rows, "file_path string, start_line int, end_line int, symbol string, content string"), 20).collect()
    want = [(path, first + a, first + b, name if not k else None, piece) for path, first, _, name, text in dict.fromkeys(rows) if text is not None for k, (a, b, piece) in enumerate(split_by_hand(text, 20))]
    assert all(len(x[4]) // 4 <= 20 for x in want)
    got = sorted(((x["file_path"], x["start_line"], x["end_line"], x["symbol"], x["content"]) for x in out), key=repr)
    kept = {p for p, _, _, _, t in rows if t is not None and len(t) // 4 <= 20}
    assert [x for x in got if x[0] not in kept] == sorted((x for x in want if x[0] not in kept), key=repr)
    assert {x[0] for x in got} == {x[0] for x in rows if x[4] is not None}
