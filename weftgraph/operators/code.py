"""Symbols and chunks of source files, one file at a time: Python with the standard ``ast`` module, scripts with a scanner."""

from __future__ import annotations

import ast
import gc
import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import mapped, spread
from .scripts import script_imports, script_relations, script_symbols

__all__ = ["UNPARSED", "chunk_id", "code_chunks", "python_contents", "python_relations", "python_symbols", "script_imports", "script_relations", "script_symbols", "text_chunks"]

SYMBOLS = "file_path string, name string, kind string, parent string, start_line int, end_line int, visibility string, bases array<string>, decorators array<string>, parameters array<string>, is_async boolean, complexity int, doc string"
RELATIONS = "file_path string, source string, relation string, target string, line int"
CHUNKS = "file_path string, start_line int, end_line int, symbol string, content string"
_DEFINED = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
_DECISIONS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.BoolOp, ast.IfExp, ast.comprehension)


#: Nodes with nothing below that counts.
_LEAVES = (ast.Name, ast.Constant, ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop)


class _Found(NamedTuple):
    """What one walk over a file finds. Definitions are named by their places in the list, -1 is the file; one stands behind the one it is in."""

    definitions: list[ast.AST]
    around: list[int]
    decisions: list[int]
    calls: list[tuple[int, ast.Call]]
    imports: list[ast.Import | ast.ImportFrom]


def _found(tree: ast.AST) -> _Found:
    out = _Found([], [], [], [], [])
    open_: list[tuple[ast.AST, int]] = [(tree, -1)]
    while open_:
        node, own = open_.pop()
        for field in node._fields:
            value = getattr(node, field, None)
            for x in value if isinstance(value, list) else (value,):
                if not isinstance(x, ast.AST) or isinstance(x, _LEAVES):
                    continue
                inside = own
                if isinstance(x, _DEFINED):
                    inside = len(out.definitions)
                    out.definitions.append(x)
                    out.around.append(own)
                    out.decisions.append(0)
                elif isinstance(x, ast.Call):
                    out.calls.append((own, x))
                elif isinstance(x, _DECISIONS):
                    if own >= 0:
                        out.decisions[own] += 1
                elif isinstance(x, (ast.Import, ast.ImportFrom)):
                    out.imports.append(x)
                open_.append((x, inside))
    for k in range(len(out.definitions) - 1, -1, -1):
        if (outer := out.around[k]) >= 0:
            out.decisions[outer] += out.decisions[k]
    return out


def _source(node: ast.AST) -> str:
    """What ``ast.unparse`` gives, which takes long for names."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and isinstance(node.value, (ast.Name, ast.Attribute)):
        return f"{_source(node.value)}.{node.attr}"
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords and all(isinstance(a, ast.Name) or (isinstance(a, ast.Constant) and type(a.value) is int) for a in node.args):
        return f"{node.func.id}({', '.join(a.id if isinstance(a, ast.Name) else repr(a.value) for a in node.args)})"
    return ast.unparse(node)


def _symbols(path: str, found: _Found) -> Iterator[dict]:
    for node, outer, decisions in zip(found.definitions, found.around, found.decisions, strict=True):
        parent = found.definitions[outer].name if outer >= 0 else None
        is_class = isinstance(node, ast.ClassDef)
        params = [] if is_class else [a.arg for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs] if a.arg not in ("self", "cls")]
        private = node.name.startswith("__") and not node.name.endswith("__")
        yield {
            "file_path": path, "name": node.name, "kind": "class" if is_class else "method" if parent else "function", "parent": parent,
            "start_line": min([node.lineno, *(d.lineno for d in node.decorator_list)]), "end_line": node.end_lineno,
            "visibility": "private" if private else "protected" if node.name.startswith("_") and not node.name.startswith("__") else "public",
            "bases": [_source(b) for b in node.bases] if is_class else [], "decorators": [_source(d) for d in node.decorator_list], "parameters": params,
            "is_async": isinstance(node, ast.AsyncFunctionDef), "complexity": 1 + decisions, "doc": ast.get_docstring(node),
        }


def _relations(path: str, found: _Found) -> Iterator[dict]:
    row = lambda source, relation, target, line: {"file_path": path, "source": source, "relation": relation, "target": target, "line": line}
    for x in found.imports:
        if isinstance(x, ast.Import):
            yield from (row(None, "IMPORTS", a.name, x.lineno) for a in x.names)
        else:
            yield row(None, "IMPORTS", "." * x.level + (x.module or ""), x.lineno)
    for node in found.definitions:
        if isinstance(node, ast.ClassDef):
            yield from (row(node.name, "EXTENDS", _source(b), node.lineno) for b in node.bases)
        yield from (row(_source(d).partition("(")[0], "DECORATES", node.name, d.lineno) for d in node.decorator_list)
    for own, call in found.calls:
        name = call.func.attr if isinstance(call.func, ast.Attribute) else _source(call.func).rpartition(".")[2]
        while own >= 0:  # a call is one of each function around it
            node = found.definitions[own]
            if not isinstance(node, ast.ClassDef):
                yield row(node.name, "CALLS", name, call.lineno)
            own = found.around[own]


#: Kind of the one row of a file that can't be parsed; its doc says why.
UNPARSED = "unparsed"
_TOO_MUCH = (SyntaxError, ValueError, RecursionError, MemoryError)


_EMPTY: dict = dict.fromkeys(c.split()[0] for c in SYMBOLS.split(", ")) | {"kind": UNPARSED, "bases": [], "decorators": [], "parameters": [], "is_async": False}


def _no_symbols(path: str, why: str) -> list[dict]:
    return [_EMPTY | {"file_path": path, "doc": why}]


def _parsed(path: str, text: str | None, *works: tuple[Callable[[str, _Found], Iterable[dict]], Callable[[str, str], list[dict]]]) -> list[dict]:
    """What each of ``works`` gives, or what its other function gives if that is too much; the text is parsed once."""
    collects = gc.isenabled()
    gc.disable()  # a tree has no cycles, and going through it again and again takes longer the longer the file
    try:
        try:
            found = _found(ast.parse(text or ""))
        except _TOO_MUCH as why:
            return [row for _, failed in works for row in failed(path, type(why).__name__)]
        out: list[dict] = []
        for work, failed in works:
            try:  # a file that is nested too deeply may fail in any step
                out += list(work(path, found))
            except _TOO_MUCH as why:
                out += failed(path, type(why).__name__)
        return out
    finally:
        if collects:
            gc.enable()


def _read(files: DataFrame, schema: str, *works: tuple[Callable, Callable]) -> DataFrame:
    return mapped(spread(files.select("file_path", "content"), "file_path", "content"), lambda path, text: _parsed(path, text, *works), schema)


def python_symbols(files: DataFrame) -> DataFrame:
    """Classes, functions and methods of ``files`` (file_path, content); for a file that can't be parsed one row of kind ``UNPARSED``."""
    return _read(files, SYMBOLS, (_symbols, _no_symbols))


def python_relations(files: DataFrame) -> DataFrame:
    """Imports, calls, base classes and decorators of ``files`` (file_path, content)."""
    return _read(files, RELATIONS, (_relations, lambda path, why: []))


def python_contents(files: DataFrame) -> DataFrame:
    """The rows of ``python_symbols``, whose relation is null, and those of ``python_relations``, whose kind is null: each file is parsed once."""
    both = ", ".join([SYMBOLS, *(c for c in RELATIONS.split(", ") if not c.startswith("file_path "))])
    return _read(files, both, (_symbols, _no_symbols), (_relations, lambda path, why: []))


def _runs(path: str, text: str | None, spans: list[dict] | None) -> Iterator[dict]:
    """The lines of each span, and each run of lines that are in none."""
    lines = text.split("\n") if text is not None else []
    ends: dict[int, tuple[int, str]] = {}  # of spans that begin on one line the longest counts
    for s in spans or ():
        ends[s["start_line"]] = max(ends.get(s["start_line"], (0, "")), (s["end_line"], s["name"]))

    def row(first: int, last: int, name: str | None) -> dict:
        return {"file_path": path, "start_line": first, "end_line": last, "symbol": name, "content": "\n".join(lines[first - 1 : last])}

    free = 1  # the first line behind all spans so far
    for first, (last, name) in sorted(ends.items()):
        if last < free:  # inside another one
            continue
        if free < first and free <= len(lines):
            yield row(free, min(first - 1, len(lines)), None)
        if first <= len(lines):
            yield row(first, min(last, len(lines)), name)
        free = last + 1
    if free <= len(lines):
        yield row(free, len(lines), None)


def code_chunks(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """One chunk for each method and top-level function, and for each run of other non-blank lines:
    file_path, start_line, end_line, symbol, content, chunk_id."""
    spans = symbols.where(F.col("kind").isin("function", "method") & F.col("end_line").isNotNull())
    spans = spans.groupBy("file_path").agg(F.collect_list(F.struct("start_line", "end_line", "name")).alias("spans"))
    held = spread(files.select("file_path", "content"), "file_path").join(spans, "file_path", "left").select("file_path", "content", "spans")
    chunks = mapped(held, _runs, CHUNKS)
    chunks = chunks.where(F.trim(F.regexp_replace("content", r"\s+", " ")) != "")
    return chunks.select("file_path", "start_line", "end_line", "symbol", "content", chunk_id(F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("content")).alias("chunk_id"))


#: Lines at which an over-long function may be split.
FLOW = r"^[ \t\n\x0b\f\r]*((if|elif|else|for|while|try|except|finally|with|match|case|def|class)\b|async def\b)"
#: Fixed value: the share of the budget that a piece of a split chunk may use.
FILL = 0.95
_FLOW = re.compile(FLOW)


def fitted_chunks(chunks: DataFrame, budget: int) -> DataFrame:
    """``chunks`` (file_path, start_line, end_line, symbol, content) with at most ``budget`` tokens each.

    A larger one is split before lines that begin with a word of control flow or a definition;
    consecutive segments are packed while they use at most ``FILL`` of the budget together, with
    the line breaks between them. A segment that alone is larger is packed by lines, and a line
    that is larger is cut into pieces. Only a chunk's first piece keeps its symbol. Null contents
    are dropped; of equal rows that are split one counts. A token is four characters, as in ``text.tokens``.
    """
    kind = chunks.schema["start_line"].dataType.simpleString()
    equal = ["file_path", "start_line", "end_line", "content"]
    one = chunks.where("content IS NOT NULL").groupBy(*equal).agg(F.sort_array(F.collect_list(F.struct("symbol")), asc=False).alias("symbols"))

    def work(path: str, first: int, last: int, content: str, symbols: list[dict]) -> Iterator[dict]:
        if len(content) // 4 <= budget:
            yield from ({"file_path": path, "start_line": first, "end_line": last, "symbol": s["symbol"], "content": content} for s in symbols)
            return
        for low, high, opens, text in _pieces(content, max(1, int(FILL * budget))):
            yield {"file_path": path, "start_line": first + low, "end_line": first + high, "symbol": symbols[0]["symbol"] if opens else None, "content": text}

    return mapped(one, work, f"file_path string, start_line {kind}, end_line {kind}, symbol string, content string")


def _packed(sizes: Iterable[int], room: int) -> Iterator[tuple[int, int]]:
    """First and last place of consecutive parts that have room together; one that is larger is alone."""
    first = used = k = 0
    for k, size in enumerate(sizes):
        if used and used + size > room:
            yield first, k - 1
            first, used = k, 0
        used += size
    yield first, k


def _pieces(content: str, limit: int) -> Iterator[tuple[int, int, bool, str]]:
    """First and last line (from 0) of each piece, whether it is the first, and its text."""
    # n characters and their line breaks are floor((n - 1) / 4) tokens, if each line counts one more than its length
    room, longest = 4 * limit + 4, 4 * limit
    lines = content.split("\n")
    begins = [k for k, text in enumerate(lines) if k == 0 or _FLOW.match(text)]
    segments = list(zip(begins, [*begins[1:], len(lines)], strict=True))
    sizes = [sum(len(text) + 1 for text in lines[a:b]) for a, b in segments]
    for i, j in _packed(sizes, room):
        a, b = segments[i][0], segments[j][1]
        if sizes[i] <= room:
            yield a, b - 1, a == 0, "\n".join(lines[a:b])
            continue
        units = [(k, at, lines[k][at : at + longest]) for k in range(a, b) for at in range(0, max(1, len(lines[k])), longest)]
        for x, y in _packed([room if len(lines[k]) > longest else len(text) + 1 for k, _, text in units], room):
            yield units[x][0], units[y][0], units[x][:2] == (0, 0), "\n".join(text for _, _, text in units[x : y + 1])


def chunk_id(path: Column, first: Column, last: Column, content: Column) -> Column:
    return F.concat(path, F.lit(":"), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(":"), F.substring(F.sha1(content.cast("binary")), 1, 10))


def text_chunks(files: DataFrame, budget: int) -> DataFrame:
    """Chunks of files that are not code: Markdown by headings, YAML by top-level keys, JSON whole if
    it fits the budget, all else by paragraphs; what is larger is packed by lines."""
    from .text import heading_blocks, packed, paragraphs, tokens, yaml_blocks

    kind = F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1))
    rows = files.select("file_path", "content", kind.alias("ending"))
    parts = [
        heading_blocks(rows.where("ending = 'md'"), "file_path", "content"),
        yaml_blocks(rows.where("ending IN ('yaml', 'yml')"), "file_path", "content"),
        paragraphs(rows.where("ending NOT IN ('md', 'yaml', 'yml', 'json')"), "file_path", "content"),
    ]
    blocks = rows.where("ending = 'json'").select("file_path", F.lit(1).alias("start_line"), F.size(F.split("content", "\n")).alias("end_line"), "content")
    for p in parts:
        blocks = blocks.unionByName(p.select("file_path", "start_line", "end_line", "content"))
    blocks = blocks.withColumn("tokens", tokens(F.col("content")))
    small = blocks.where(F.col("tokens") <= budget).drop("tokens")
    large = blocks.where(F.col("tokens") > budget).withColumn("block", F.concat_ws(":", "file_path", F.col("start_line").cast("string")))
    lines = large.select("block", "file_path", "start_line", F.posexplode(F.split("content", "\n")).alias("at", "text")).withColumn("tokens", tokens(F.col("text")))
    chunked = packed(lines, "block", "at", budget).groupBy("block", "file_path", "start_line", "chunk")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n")
    cut = chunked.agg(F.min("at").alias("low"), F.max("at").alias("high"), text.alias("content"))
    return small.unionByName(cut.select("file_path", (F.col("start_line") + F.col("low")).alias("start_line"), (F.col("start_line") + F.col("high")).alias("end_line"), "content"))
