"""Text chunks, sections and summaries. Lines and sentences are rows or array elements."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.scalars import tokens_by_length

#: What makes a sentence a key sentence.
KEY_PATTERN = r"(?i)(^|[^A-Za-z0-9_])(interface|class|def|model|constraint|endpoint|schema|api|type|return|param|error|response|request)([^A-Za-z0-9_]|$)|(^|[^A-Za-z0-9_])(require|validat)"
#: Fixed values of summaries: shorter texts stay, so many first sentences stay, largest share.
SHORT, LEADING, SHARE = 100, 2, 0.5


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 1), content."""
    return docs.select(key, F.posexplode(F.split(text, "\n"))).select(key, (F.col("pos") + 1).alias("line"), F.col("col").alias("content"))


def marked_blocks(docs: DataFrame, key: str, text: str, mark: str) -> DataFrame:
    """Blocks that begin at lines matching ``mark``: key, block, start_line, end_line, content.

    What comes before the first mark is block 0. Blank blocks are dropped.
    """
    rows = lines(docs, key, text)
    order = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("block", F.sum(F.col("content").rlike(mark).cast("int")).over(order))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), "\n")
    blocks = rows.groupBy(key, "block").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), content.alias("content"))
    return blocks.where(F.trim(F.regexp_replace("content", r"\s+", " ")) != "")


def heading_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Markdown by headings."""
    return marked_blocks(docs, key, text, r"^#{1,6}\s+")


def yaml_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """YAML by top-level key."""
    return marked_blocks(docs, key, text, r"^[A-Za-z_]\w*:")


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Split at blank lines: key, place, start_line, end_line, content; blank ones are dropped."""
    parts = docs.select(key, F.posexplode(F.split(text, "\n\n")).alias("place", "content"))
    parts = parts.withColumn("height", F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1)
    before = F.coalesce(F.sum(F.col("height") + 1).over(Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("start_line", (before + 1).cast("int"))
    return parts.where(F.trim("content") != "").select(key, "place", "start_line", (F.col("start_line") + F.col("height") - 1).cast("int").alias("end_line"), "content")


def packed(parts: DataFrame, key: str, place: str, budget: int, name: str = "chunk") -> DataFrame:
    """Greedy packing of consecutive parts into chunks of at most ``budget`` tokens (a part that is
    larger is a chunk of its own): ``parts`` with the chunk (from 0) as ``name``. A text is one fold."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), F.col("tokens").cast("long").alias("tokens"))))
    # the fold carries counters, and grows its array by one for a chunk only
    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("used"), F.array(F.lit(0)).alias("cuts"))

    def step(now: Column, r: Column) -> Column:
        over = (now["used"] > 0) & (now["used"] + r["tokens"] > budget)
        used = F.when(over, r["tokens"]).otherwise(now["used"] + r["tokens"])
        return F.struct((now["at"] + 1).alias("at"), used.alias("used"), F.when(over, F.concat(now["cuts"], F.array(now["at"]))).otherwise(now["cuts"]).alias("cuts"))

    listed = parts.groupBy(key).agg(rows.alias("rows")).withColumn("cuts", F.aggregate("rows", start, step, lambda now: now["cuts"]))
    ends = F.transform("cuts", lambda first, k: F.struct(k.alias(name), F.slice(F.col("rows.place"), first + 1, F.coalesce(F.get("cuts", k + 1), F.size("rows")) - first).alias("places")))
    chunked = listed.select(key, F.inline(ends)).select(key, F.explode("places").alias(place), name)
    return parts.join(chunked, [key, place])


def token_windows(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Windows of ``size`` words without overlap: key, part (from 0), content."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    rows = docs.select(key, words.alias("words")).where(F.size("words") > 0)
    windows = F.transform(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / size).cast("int")), lambda i: F.array_join(F.slice("words", i * size + 1, F.lit(size)), " "))
    return rows.select(key, F.posexplode(windows).alias("part", "content"))


def references(docs: DataFrame, key: str, text: str, names: Column) -> Column:
    """Those of ``names`` that are words of the text."""
    return F.array_intersect(names, F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"([A-Za-z0-9_]+)"), F.lit(1))))


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Headings with level, title, and code point span; a text without one is one section of level 0."""
    rows = lines(docs, key, text)
    order = Window.partitionBy(key).orderBy("line")
    rows = rows.withColumn("first", (F.sum(F.length("content") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("content") - 1).cast("long"))
    heads = rows.where(F.col("content").rlike(r"^#{1,6}\s+\S"))
    whole = docs.select(key, F.length(text).cast("long").alias("length"))
    heads = heads.join(whole, key).withColumn("last", F.coalesce(F.lead("first").over(order), F.col("length")))
    out = heads.select(key, F.length(F.regexp_extract("content", r"^(#{1,6})", 1)).alias("level"), F.trim(F.regexp_replace("content", r"^#{1,6}\s+", "")).alias("title"), "first", "last")
    rest = whole.join(heads.select(key).distinct(), key, "left_anti").select(key, F.lit(0).alias("level"), F.lit("").alias("title"), F.lit(0).cast("long").alias("first"), F.col("length").alias("last"))
    return out.unionByName(rest).withColumn("tokens", F.floor((F.col("last") - F.col("first")) / 4))


def summary(text: Column) -> Column:
    """Extract of a text: leading and key sentences, and others from the start while at most half
    of the length is used. A text below SHORT characters stays as it is.

    Sentences end at ``.``, ``!`` or ``?`` before white space, and at blank lines. Of the
    others, those go that come last, until the rest fits.
    """
    # what is used twice is bound first: Spark would make it again for each use, and in a fold for each sentence
    def bound(value: Column, then: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(value), then), F.lit(0))

    split = F.filter(F.transform(F.split(F.trim(text), r"(?<=[.!?])\s+|\n\n+"), lambda s: F.trim(s)), lambda s: s != "")
    marked = F.transform(split, lambda s, i: F.struct(s.alias("s"), ((i < LEADING) | s.rlike(KEY_PATTERN)).alias("stays"), (F.length(s) + 1).alias("n")))

    def cut(v: Column) -> Column:
        """At which place the first of the others is that doesn't fit."""

        def step(now: Column, x: Column) -> Column:
            used = now["used"] + F.when(x["stays"], 0).otherwise(x["n"])
            late = ~x["stays"] & (used > v["room"])
            return F.struct(used.alias("used"), (now["at"] + 1).alias("at"), F.when(late, F.least(now["cut"], now["at"])).otherwise(now["cut"]).alias("cut"))

        must = F.aggregate(v["all"], F.lit(-1), lambda n, x: n + F.when(x["stays"], x["n"]).otherwise(0))
        return F.aggregate(v["all"], F.struct(must.alias("used"), F.lit(0).alias("at"), F.lit(2**31 - 1).alias("cut")), step, lambda now: now["cut"])

    def joined(v: Column) -> Column:
        left = F.transform(F.filter(v["all"], lambda x, i: x["stays"] | (i < v["cut"])), lambda x: x["s"])
        return F.when(F.size(v["all"]) == 0, text).otherwise(F.array_join(left, " "))

    given = F.struct(marked.alias("all"), F.floor(F.length(text) * SHARE).alias("room"))
    short = bound(given, lambda v: bound(F.struct(v["all"].alias("all"), cut(v).alias("cut")), joined))
    return F.when(text.isNull() | (F.length(text) < SHORT), text).otherwise(short)


def naming_style(text: Column) -> Column:
    """``snake_case`` or ``camelCase``, whichever is more common (the first on a tie); null for none."""
    snake = F.regexp_count(text, F.lit(r"(?<![A-Za-z0-9_])[a-z][a-z0-9]*(_[a-z0-9]+)+(?![A-Za-z0-9_])"))
    camel = F.regexp_count(text, F.lit(r"(?<![A-Za-z0-9_])[a-z][a-z0-9]*([A-Z][a-z0-9]*)+(?![A-Za-z0-9_])"))
    return F.when((snake > 0) | (camel > 0), F.when(snake >= camel, "snake_case").otherwise("camelCase"))


def tokens(text: Column) -> Column:
    return tokens_by_length(text)


def diagrams(text: Column) -> Column:
    """The trimmed bodies of fenced mermaid blocks."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?s)```mermaid\s*\n(.*?)```"), F.lit(1)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def cross_references(text: Column, sections: Sequence[str]) -> Column:
    """``{{ref:name}}`` of a known section becomes a link with its title; others stay."""
    for name in sections:
        link = f"[{name.replace('_', ' ').title()}](#{name.replace('_', '-')})"
        text = F.replace(text, F.lit("{{ref:" + name + "}}"), F.lit(link))
    return text


def titled(section: Column) -> Column:
    """The title of a section that has none: its id in words with capitals."""
    return F.initcap(F.replace(section, F.lit("_"), F.lit(" ")))


def assembled(sections: DataFrame, template: DataFrame) -> DataFrame:
    """document, position (from 1), section, title, level, entry and content: documents put together from ``sections``
    (document, section, content), as ``template`` (document, section, place, title, level) orders them.

    Sections of the template come in the order of place, others last by id, at level 2. ``entry``
    is the line of the table of contents; ``content`` has its heading, and ``{{ref:id}}`` of a
    section or template row of the same document is a link; others stay. Sections without content
    are left out; of several with one id the greatest content counts, and of several template rows
    the first. A null document is a document; its sections meet its template. Rows stay rows, so a
    document of many sections is many tasks; ``document, position`` is the order to write them in.
    """
    from .state import running_total

    own = sections.where("content IS NOT NULL AND section IS NOT NULL").groupBy("document", "section").agg(F.max("content").alias("body"))
    plan = template.where("section IS NOT NULL").groupBy("document", "section").agg(F.min(F.struct("place", "title", "level")).alias("plan"))
    plan = plan.select(F.col("document").alias("of_document"), F.col("section").alias("of_section"), "plan")
    marked = own.select("document", "section", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"(?U)\{\{ref:(\w+)\}\}"), F.lit(1)))).alias("ref"))
    known = own.select("document", "section").unionByName(plan.select(F.col("of_document").alias("document"), F.col("of_section").alias("section"))).select(F.col("document").alias("of_document"), F.col("section").alias("of_section"))
    refs = marked.join(known, F.col("document").eqNullSafe(F.col("of_document")) & (F.col("ref") == F.col("of_section")), "left_semi")
    refs = refs.groupBy("document", "section").agg(F.collect_set("ref").alias("refs")).select(F.col("document").alias("ref_document"), F.col("section").alias("ref_section"), "refs")

    rows = own.join(plan, F.col("document").eqNullSafe(F.col("of_document")) & (F.col("section") == F.col("of_section")), "left").join(refs, F.col("document").eqNullSafe(F.col("ref_document")) & (F.col("section") == F.col("ref_section")), "left")
    link = lambda s: F.concat(F.lit("["), titled(s), F.lit("](#"), F.replace(s, F.lit("_"), F.lit("-")), F.lit(")"))
    body = F.aggregate(F.coalesce("refs", F.array().cast("array<string>")), F.col("body"), lambda t, s: F.replace(t, F.concat(F.lit("{{ref:"), s, F.lit("}}")), link(s)))
    title, level = F.coalesce("plan.title", titled(F.col("section"))), F.coalesce("plan.level", F.lit(2))
    entry = F.concat(F.lit("- ["), title, F.lit("](#"), F.replace("section", F.lit("_"), F.lit("-")), F.lit(")"))
    content = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), title, F.lit("\n\n"), body, F.lit("\n"))
    rows = rows.select("document", "section", title.alias("title"), level.alias("level"), entry.alias("entry"), content.alias("content"), F.col("plan").isNull().alias("extra"), F.col("plan.place").alias("place"))
    placed = running_total(rows, "document", ["extra", "place", "section"], F.lit(1), "position")
    return placed.select("document", F.col("position").cast("long").alias("position"), "section", "title", "level", "entry", "content")


def findings(text: Column) -> Column:
    """(summary, insights, confidence, sources) of a report in Markdown; empty or 0.5 where missing."""

    def section(title: str) -> Column:
        return F.regexp_extract(text, rf"(?s)##\s*{title}\s*\n+(.*?)(?=\n##\s|\z)", 1)

    percent = F.regexp_extract(text, r"\*\*Confidence:\s*(\d+)%?\*\*", 1)
    return F.struct(
        F.regexp_replace(section("Summary"), r"^\s+|\s+$", "").alias("summary"),
        F.regexp_extract_all(section("Key Insights?"), F.lit(r"(?m)^\d+\.\s+(.+)$"), F.lit(1)).alias("insights"),
        F.when(percent != "", percent.cast("double") / 100).otherwise(F.lit(0.5)).alias("confidence"),
        F.regexp_extract_all(section("Sources?"), F.lit(r"(?m)^[-*]\s+(.+)$"), F.lit(1)).alias("sources"),
    )
