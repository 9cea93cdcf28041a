"""Symbols and relations of JavaScript and TypeScript files, one file at a time, by a scanner of tokens.

The scanner tells strings, templates, comments and regular expressions from code; brackets are matched on the tokens,
so every symbol has an end, symbols nest, and what stands in a text or a comment is neither a symbol nor a call.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from string import ascii_letters
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import mapped, spread

SYMBOLS = "file_path string, name string, kind string, parent string, start_line int, end_line int, visibility string, is_static boolean, is_async boolean, bases array<string>, interfaces array<string>, complexity int"
RELATIONS = "file_path string, source string, source_kind string, source_line int, relation string, target string, line int"

#: A token, behind space and comments of its line: a name, the end of a line, a mark, a number, a text, or a comment that may go on over lines.
TOKEN = re.compile(
    r"""[^\S\n]*+(?://[^\n]*+)?+
    (\#?[A-Za-z_$][\w$]*+
    |\n\s*+
    |=>|\?[.?]?|\.(?:\.\.)?|&&?|\|\|?
    |\d[\w.]*+
    |"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'
    |/\*.*?(?:\*/|\Z)
    |.
    |\Z)""",
    re.DOTALL | re.VERBOSE,
)
#: What comes before the next template or slash, whole tokens and comments; and inside of a template before the next brace, too.
_PLAIN = r"""(?:[^`/"'%s]++|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|//[^\n]*+|/\*.*?(?:\*/|\Z)|["'])*+"""
PLAIN, PLAIN_INSIDE = (re.compile(_PLAIN % braces, re.DOTALL) for braces in ("", "{}"))
TEMPLATE = re.compile(r"[^`\\$]*+(?:(?:\\.|\\\Z|\$(?!\{))[^`\\$]*+)*+(?:`|\$\{|\Z)", re.DOTALL)
REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
#: After these a slash divides; after all else it begins a regular expression.
VALUES = frozenset(") ] }".split())
#: Words after which a value, and no operator, follows.
BEFORE_VALUE = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())
PAIRS = {")": "(", "]": "[", "}": "{"}
BRACKETS = frozenset("([{)]}")
#: What a name begins with, and a name or a common mark; marks that begin, end and decide nothing, the most common ones.
INITIALS = frozenset(ascii_letters + "_$#")
WORDS = INITIALS | frozenset("!%&()*+,-.:;<=>?@[]^{|}~")
INERT = frozenset(["", "=>", *".,:;=<>"])
MODIFIERS = frozenset("public private protected static async readonly get set abstract override declare accessor *".split())
#: Words before a parenthesis that are no calls.
NO_CALLS = frozenset("if for while switch catch function return typeof await yield new in of do else with super import delete void throw case instanceof".split())
#: Words that begin a symbol outside the body of a class.
DEFINES = frozenset("class interface enum type function const let var".split())
DECISIONS = frozenset("if for while case catch ? && || ??".split())
#: Words at which a walk stops wherever they are.
STEPS = DEFINES | DECISIONS
#: Tokens that carry a statement on over the end of a line: before it, and after it.
GOES_ON = frozenset("= | & => . ? ?. : , + - * / % < ( [ { && || ?? ! extends keyof typeof return new await in of instanceof".split())
#: Words that tell something of the symbol behind them.
KEPT = MODIFIERS | {"export", "default", "const"}
CARRIES_ON = frozenset("| & ? ?. . : = => + * / % && || ?? ) , ] } ; extends instanceof in of as".split())


class Token(NamedTuple):
    kind: str
    text: str
    first: int
    last: int


class Symbol(NamedTuple):
    name: str
    kind: str
    begin: int
    end: int
    body: int
    words: frozenset[str]
    bases: list[str]
    interfaces: list[str]


def _read(text: str) -> tuple[list[str], list[int], dict[int, Token]]:
    """All names and marks, with an empty one for each other token; the lines they begin on; and the others by their numbers.

    A template is a text, but the code inside its ``${}`` is code. Names and marks are the most by far, and objects for them would take long.
    """
    words: list[str] = []
    lines: list[int] = []
    others: dict[int, Token] = {}
    at, line = 0, 1
    depths: list[int] = []  # for each ``${`` around this place the braces open in it

    def put(word: str) -> None:
        words.append(word)
        lines.append(line)

    def put_other(kind: str, found: str) -> None:
        nonlocal line
        last = line + found.count("\n")
        others[len(words)] = Token(kind, found, line, last)
        put("")
        line = last

    def template(at: int) -> int:
        end = TEMPLATE.match(text, at + 1).end()
        inside = text.startswith("${", end - 2)
        put_other("text", text[at : end - 2 if inside else end])
        if inside:
            depths.append(0)
            put("{")
        return end

    while at < len(text):
        end = (PLAIN_INSIDE if depths else PLAIN).match(text, at).end()
        for found in TOKEN.findall(text, at, end) if end > at else ():
            first = found[:1]
            if first in WORDS:
                words.append(found)
                lines.append(line)
            elif first == "\n" or first == "/":
                line += found.count("\n")
            elif first.isdecimal():
                put_other("number", found)
            elif len(found) > 1:
                put_other("text", found)
            elif found:
                put(found)
        if end == len(text):
            break
        here, at = text[end], end + 1
        if here == "`":
            at = template(end)
            continue
        if here == "/":
            word, other = words[-1] if words else "", others.get(len(words) - 1)
            divides = other.kind != "regex" if other else word in VALUES or (_named(word) and word not in BEFORE_VALUE)
            if not divides and (found := REGEX.match(text, end)):
                at = found.end()
                put_other("regex", found.group())
                continue
        put(here)
        if here == "{":
            depths[-1] += 1
        elif here == "}" and depths[-1] > 0:
            depths[-1] -= 1
        elif here == "}":
            depths.pop()
            at = template(end)  # it goes on at the brace
    return words, lines, others


def _named(word: str) -> bool:
    return word[:1] in INITIALS and word != "#"


def tokens(text: str) -> list[Token]:
    """All tokens with their lines."""
    words, lines, others = _read(text)
    return [others.get(k) or Token("name" if _named(word) else "mark", word, line, line) for k, (word, line) in enumerate(zip(words, lines))]


def matched(found: list[Token]) -> list[int]:
    """For each bracket the number of its partner; the last token for one that has none, and -1 for all else."""
    return _partners([t.text if t.kind == "mark" else "" for t in found])


def _partners(words: list[str]) -> list[int]:
    out, stack, last = [-1] * len(words), [], len(words) - 1
    for k, word in enumerate(words):
        if word not in BRACKETS:
            continue
        if word not in PAIRS:
            stack.append(k)
            continue
        opens = PAIRS[word]
        while stack and words[stack[-1]] != opens:
            out[stack.pop()] = last
        if stack:
            out[k] = stack[-1]
            out[stack.pop()] = k
    for k in stack:
        out[k] = last
    return out


class Scanner:
    #: So many places beyond the ends, before the first token and behind the last, are looked at; no word is there.
    BEYOND = 8

    def __init__(self, text: str) -> None:
        self.words, self.lines, self.others = _read(text)
        self.pair = _partners(self.words)
        self.n = len(self.words)
        self.words += [""] * self.BEYOND

    def last_line(self, k: int) -> int:
        return other.last if (other := self.others.get(k)) else self.lines[k]

    def is_name(self, k: int) -> bool:
        word = self.words[k]  # as _named, which is a call more
        return word[:1] in INITIALS and word != "#"

    def quoted(self, k: int) -> str | None:
        """What stands in the text at k, if that is a text and no template."""
        other = self.others.get(k)
        return other.text[1:-1] if other and other.kind == "text" and not other.text.startswith("`") else None

    def kept(self, k: int) -> frozenset[str]:
        """The words before k that tell something of the symbol there."""
        first = k
        while self.words[first - 1] in KEPT:
            first -= 1
        return frozenset(self.words[first:k])

    def after_angles(self, k: int) -> int:
        """The place behind ``<...>`` that may begin at k."""
        if self.words[k] != "<":
            return k
        depth = 0
        for j in range(k, min(self.n, k + 500)):
            here = self.words[j]
            depth += (here == "<") - (here == ">")
            if depth == 0:
                return j + 1
            if here in (";", "{") and self.pair[j] < 0:
                break
        return k

    def after_type(self, k: int) -> int:
        """The place behind a type annotation, whose colon is at k."""
        k += 1
        while k < self.n:
            here, before = self.words[k], self.words[k - 1]
            if here == "{" and before not in (":", "|", "&", "=>", ",", "is", "asserts", "<"):
                return k
            if here in ("(", "[", "{"):
                k = self.pair[k] + 1
            elif here == "<":
                k = max(k + 1, self.after_angles(k))
            elif here in (";", ")", "]", "}", ",", "=") or (here == "=>" and before != ")"):
                return k
            elif here == "=>":
                if self.words[k + 1] == "{" or not self.is_name(k + 1):
                    return k
                k += 1
            else:
                k += 1
        return k

    def statement_end(self, k: int) -> int:
        """The last token of the statement or expression that begins at k."""
        while k < self.n:
            here = self.words[k]
            if here == ";":
                return k
            if here in PAIRS or here == ",":
                return k - 1
            if here in ("(", "[", "{"):
                k = self.pair[k]
            after = self.words[k + 1]
            if k + 1 >= self.n or after in PAIRS:
                return k
            if self.lines[k + 1] > self.last_line(k) and self.words[k] not in GOES_ON and after not in CARRIES_ON:
                return k
            k += 1
        return self.n - 1

    def listed(self, k: int) -> tuple[list[str], int]:
        """Names of a heritage clause from k, without their arguments, and the place behind it."""
        out, fresh = [], True
        while k < self.n and self.words[k] not in ("{", "extends", "implements"):
            if self.is_name(k) and self.words[k - 1] == "." and out:
                out[-1] += f".{self.words[k]}"
            elif self.is_name(k) and fresh:
                out.append(self.words[k])
                fresh = False
            elif self.words[k] == ",":
                fresh = True
            if self.words[k] == "<":
                k = max(k + 1, self.after_angles(k))
            elif self.words[k] in ("(", "["):
                k = self.pair[k] + 1
            else:
                k += 1
        return out, k

    def arrow(self, k: int) -> int | None:
        """The place of the arrow of an arrow function that begins at k."""
        if self.words[k] == "async":
            k += 1
        k = self.after_angles(k)
        if self.words[k] == "(":
            k = self.pair[k] + 1
            k = self.after_type(k) if self.words[k] == ":" else k
        elif self.is_name(k):
            k += 1
        else:
            return None
        return k if self.words[k] == "=>" else None

    def body_of(self, k: int) -> int | None:
        """The brace of the body of a function whose parameters begin at k."""
        k = self.after_angles(k)
        if self.words[k] != "(":
            return None
        k = self.pair[k] + 1
        k = self.after_type(k) if self.words[k] == ":" else k
        return k if self.words[k] == "{" else None

    def assigned(self, k: int) -> int | None:
        """The place of the value of ``name [: type] = value``, whose name is at k."""
        k += 1
        k += self.words[k] in ("?", "!")
        k = self.after_type(k) if self.words[k] == ":" else k
        return k + 1 if self.words[k] == "=" else None

    def definition(self, k: int, in_class: bool) -> Symbol | None:
        """The symbol that the token at k begins, if it does."""
        word, name = self.words[k], self.words[k + 1]
        named = self.is_name(k + 1) and self.words[k - 1] not in (".", "?.")
        if word in ("class", "interface") and named and name not in ("extends", "implements"):
            at = self.after_angles(k + 2)
            held: dict[str, list[str]] = {"extends": [], "implements": []}
            while self.words[at] in held:
                clause = self.words[at]
                held[clause], at = self.listed(at + 1)
            if self.words[at] == "{":
                return Symbol(name, word, k, self.pair[at], at, self.kept(k), held["extends"], held["implements"])
        elif word == "enum" and named and self.words[k + 2] == "{":
            return Symbol(name, "enum", k, self.pair[k + 2], k + 2, self.kept(k), [], [])
        elif word == "type" and named and self.words[at := self.after_angles(k + 2)] == "=":
            return Symbol(name, "type_alias", k, self.statement_end(at + 1), -1, self.kept(k), [], [])
        elif word == "function" and self.words[k - 1 - (self.words[k - 1] == "async")] not in ("=", "(", ",", ":", "return", "=>", "?", "["):
            at = k + 1 + (self.words[k + 1] == "*")
            if self.is_name(at) and (body := self.body_of(at + 1)) is not None:
                return Symbol(self.words[at], "function", k, self.pair[body], body, self.kept(k), [], [])
        elif word in ("const", "let", "var") and named:
            value = self.assigned(k + 1)
            if value is not None and (at := self.arrow(value)) is not None:
                end = self.pair[at + 1] if self.words[at + 1] == "{" else self.statement_end(at + 1)
                return Symbol(name, "function", k, end, at + 1, self.kept(k) | {self.words[value]}, [], [])
        elif in_class and self.is_name(k) and not (word in MODIFIERS and (self.is_name(k + 1) or self.words[k + 1] in ("*", "["))):
            if self.words[k - 1] in (".", "=", "new", "?.", "@"):
                return None
            if (body := self.body_of(k + 1 + (self.words[k + 1] in ("?", "!")))) is not None and word not in NO_CALLS:
                return Symbol(word, "method", k, self.pair[body], body, self.kept(k), [], [])
            value = self.assigned(k)
            if value is not None and (at := self.arrow(value)) is not None:
                end = self.pair[at + 1] if self.words[at + 1] == "{" else self.statement_end(at + 1)
                return Symbol(word, "method", k, end, at + 1, self.kept(k) | {self.words[value]}, [], [])
        return None

    def walk(self, names: bool) -> Iterator[tuple[int, Symbol | None, Symbol | None]]:
        """For each word that may begin a symbol or decides, or each name too, its number, the symbol it begins and the innermost one around it."""
        stack: list[Symbol] = []
        open_at: list[int] = []
        bodies: set[int] = set()  # of classes
        pair, in_body = self.pair, False
        for k, word in enumerate(self.words):
            if word in INERT:
                continue
            if word in BRACKETS:
                if word not in PAIRS:
                    open_at.append(k)
                elif open_at and pair[k] == open_at[-1]:
                    open_at.pop()
                in_body = bool(open_at) and open_at[-1] in bodies
            elif word in STEPS or ((names or in_body) and word[:1] in INITIALS and word != "#"):
                while stack and k > stack[-1].end:
                    stack.pop()
                around = stack[-1] if stack else None
                in_class = in_body and around.kind == "class" and open_at[-1] == around.body
                made = self.definition(k, in_class) if in_class or word in DEFINES else None
                yield k, made, around
                if made:
                    stack.append(made)
                    if made.kind == "class":
                        bodies.add(made.body)


def _symbols(path: str, text: str) -> list[dict]:
    scanner = Scanner(text)
    out: list[dict] = []
    rows: dict[tuple[int, str], dict] = {}
    for k, made, around in scanner.walk(names=False):
        if made:
            private = made.name.startswith("#") or "private" in made.words
            out.append(
                {
                    "file_path": path, "name": made.name, "kind": made.kind, "parent": around.name if around else None, "start_line": scanner.lines[k], "end_line": scanner.last_line(made.end),
                    "visibility": "private" if private else "protected" if "protected" in made.words else "public", "is_static": "static" in made.words, "is_async": "async" in made.words,
                    "bases": made.bases, "interfaces": made.interfaces, "complexity": 1,
                }
            )
            rows[(made.begin, made.name)] = out[-1]
        elif around and scanner.words[k] in DECISIONS and (row := rows.get((around.begin, around.name))):
            row["complexity"] += scanner.words[k] != "?" or scanner.words[k + 1] not in (":", ")", ",", ";", "=")
    return out


def _relations(path: str, text: str) -> list[dict]:
    scanner, out = Scanner(text), []

    def add(source: Symbol | None, relation: str, target: str, k: int) -> None:
        begin = scanner.lines[source.begin] if source else None
        out.append({"file_path": path, "source": source.name if source else None, "source_kind": source.kind if source else None, "source_line": begin, "relation": relation, "target": target, "line": scanner.lines[k]})

    for k, made, around in scanner.walk(names=True):
        if made:
            for relation, names in (("EXTENDS", made.bases), ("IMPLEMENTS", made.interfaces)):
                for name in names:
                    add(made, relation, name, k)
            continue
        if not scanner.is_name(k):
            continue
        word = scanner.words[k]
        if word in ("import", "from", "require"):
            if word != "require" and scanner.words[k - 1] != "." and (module := scanner.quoted(k + 1)) is not None:
                add(None, "IMPORTS", module, k)
                continue
            if word != "from" and scanner.words[k + 1] == "(" and (module := scanner.quoted(k + 2)) is not None:
                add(None, "IMPORTS", module, k)
                continue
        if around and around.kind in ("function", "method") and scanner.words[k + 1] in ("(", "<") and word not in NO_CALLS and scanner.words[scanner.after_angles(k + 1)] == "(" and k != around.begin and scanner.words[k - 1] != "function" and k > min(around.body, around.end):
            add(around, "CALLS", word, k)
    return out


def _mapped(files: DataFrame, work: Callable[[str, str], list[dict]], schema: str) -> DataFrame:
    return mapped(spread(files.select("file_path", "content"), "file_path", "content"), lambda path, text: work(path, text or ""), schema)


def script_symbols(files: DataFrame) -> DataFrame:
    """Classes, interfaces, enums, types, functions and methods of ``files`` (file_path, content), with their spans and what they are in."""
    return _mapped(files, _symbols, SYMBOLS)


def script_relations(files: DataFrame) -> DataFrame:
    """Imports, calls (by the last name before the parenthesis; of the innermost function or method), base classes and interfaces."""
    return _mapped(files, _relations, RELATIONS)


def script_imports(files: DataFrame) -> DataFrame:
    """file_path and module of each import and require, once."""
    return script_relations(files).where("relation = 'IMPORTS'").select("file_path", F.col("target").alias("module")).distinct()
