"""Scalar functions of paths, ids, text, JSON, tokens and time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by file extension.
LANGUAGES = {
    ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".go": "go",
    ".java": "java", ".rb": "ruby", ".rs": "rust", ".c": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".cs": "csharp",
    ".md": "markdown", ".yaml": "yaml", ".yml": "yaml", ".json": "json",
}
#: Extensions that are indexed, and the largest size.
INDEXED = (".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".java", ".rb", ".rs", ".c", ".cpp", ".cs", ".yaml", ".yml", ".json", ".md")
LARGEST = 256 * 1024
#: Story points.
POINTS = (1, 2, 3, 5, 8, 13, 21)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def language(path: Column, head: Column | None = None) -> Column:
    """By extension; else by the interpreter that the first line names; else ``unknown``."""
    known = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))[extension(path)]
    if head is None:
        return F.coalesce(known, F.lit("unknown"))
    line = F.when(head.startswith("#!/"), F.lower(F.substring_index(head, "\n", 1)))
    sniffed = F.when(line.contains("python"), "python").when(line.contains("node") | line.contains("deno"), "javascript")
    return F.coalesce(known, sniffed, F.lit("unknown"))


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob: ``**/`` any folders, ``*`` within a segment."""
    special, out, k = ".^$+{}[]()|\\", "", 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        elif glob[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif glob[k] == "?":
            out, k = out + "[^/]", k + 1
        else:
            out, k = out + ("\\" if glob[k] in special else "") + glob[k], k + 1
    return f"^{out}$"


def ignored(path: Column, patterns: Sequence[str]) -> Column:
    """Whether gitignore-style patterns exclude the path; later ones, and ``!``, win over earlier ones."""
    out = F.lit(False)
    for p in patterns:
        keep, body = p.startswith("!"), p.lstrip("!").strip()
        if not body or body.startswith("#"):
            continue
        inner = body.strip("/")
        anchored = "/" in body.rstrip("/")
        glob = inner if anchored else f"**/{inner}"
        pattern = glob_pattern(glob)[:-1] + ("/.*$" if body.endswith("/") else "(?:/.*)?$")
        out = F.when(path.rlike(pattern), F.lit(not keep)).otherwise(out)
    return out


def hidden(path: Column) -> Column:
    return path.rlike(r"(^|/)\.[^/]")


def inside(path: Column) -> Column:
    """Whether a relative path stays below its root: not absolute, and never more ``..`` than folders."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    start = F.struct(F.lit(0).alias("depth"), F.lit(True).alias("ok"))
    step = F.aggregate(
        parts,
        start,
        lambda now, x: F.struct((now["depth"] + F.when(x == "..", -1).otherwise(1)).alias("depth"), (now["ok"] & ~((x == "..") & (now["depth"] == 0))).alias("ok")),
        lambda now: now["ok"],
    )
    return ~path.startswith("/") & step


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def id_line(symbol_id: Column) -> Column:
    """The line number at the end of an id ``file:name:kind:line``; null if there is none."""
    parts = F.split(symbol_id, ":")
    return F.when(F.size(parts) >= 4, F.element_at(parts, -1).try_cast("int"))


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def json_map(text: Column) -> Column:
    """A JSON object as a map of strings; empty for null and for what is none."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def csv_list(text: Column) -> Column:
    """The trimmed, non-empty parts between commas."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def tokens_by_length(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")


def tokens_by_words(text: Column) -> Column:
    return F.floor(F.size(words(text)) * 1.33)


def truncated_to_tokens(text: Column, most: int, suffix: str = "...") -> Column:
    """At four characters a token, with the suffix inside the budget."""
    room = max(0, 4 * most - len(suffix))
    return F.when(F.length(text) > 4 * most, F.concat(F.substring(text, 1, room), F.lit(suffix))).otherwise(text)


def nearest_points(value: Column) -> Column:
    """The nearest of POINTS; of two equally near ones the smaller."""
    return F.array_min(F.transform(F.array(*map(F.lit, POINTS)), lambda x: F.struct(F.abs(x - value).alias("off"), x.alias("x"))))["x"]


def http_method(name: Column) -> Column:
    """From the prefix of a function name; null for others."""
    low = F.lower(name)
    return (
        F.when(low.rlike("^(get|retrieve|list)_"), "GET")
        .when(low.rlike("^(post|create)_"), "POST")
        .when(low.rlike("^(put|update)_"), "PUT")
        .when(low.startswith("patch_"), "PATCH")
        .when(low.startswith("delete_"), "DELETE")
    )


def camel_case(name: Column) -> Column:
    """snake_case to camelCase."""
    parts = F.split(F.lower(name), "_")
    return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.initcap), ""))


def without_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "))


def safe_id(text: Column) -> Column:
    """Letters, digits and underscores only, for diagram ids."""
    return F.regexp_replace(text, "[^A-Za-z0-9_]", "_")
