"""Scalar functions, chunks, sections, rule chains on texts, pages, events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import scalars
from weftgraph.operators import analysis, retrieval, text
from weftgraph.sources import derived
from weftgraph.sources.tables import table

from .registry import query


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


WORDS = r"list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


@query("SELECT page_id, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest FROM pages")
def s13_strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(scalars.without_tags(F.col("html")), 256).alias("digest"))


@query("WITH f AS (SELECT file_path, sum(p.p_retailprice * 100) AS bytes FROM g_symbols s JOIN part p ON p.p_partkey = s.id GROUP BY file_path) SELECT file_path FROM f WHERE bytes <= 262144 AND ends_with(file_path, '.py') AND NOT regexp_matches(file_path, '^Brand#1/') AND NOT regexp_matches(file_path, '(^|/)[.][^/]') ORDER BY file_path")
def s1_s4_discover_files(spark, sf_dir):
    """Extension, size, hidden and ignored paths, sorted."""
    sizes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") * 100).alias("size"))
    files = derived.symbols(spark, sf_dir).join(sizes, "id").groupBy("file_path").agg(F.sum("size").alias("bytes"))
    path = F.col("file_path")
    keep = scalars.extension(path).isin(*scalars.INDEXED) & (F.col("bytes") <= scalars.LARGEST) & ~scalars.hidden(path) & ~scalars.ignored(path, ["Brand#1/", "*.min.js"])
    return files.where(keep).select("file_path").orderBy("file_path")


ENDINGS = ("py", "TS", "jsx", "go", "unknown", "cpp", "md", "yml", "tar.gz", "json", "rs/x", "py/.rb")
HEADS = ("#!/usr/bin/env python3", "#!/usr/bin/node -x", "#!/bin/sh", "# python", "#!/bin/Deno")


@query("WITH f AS (SELECT page_id, 'a.b/f' || CASE WHEN page_id % 4 = 3 THEN '' ELSE '.' || ['py', 'TS', 'jsx', 'go', 'unknown', 'cpp', 'md', 'yml', 'tar.gz', 'json', 'rs/x', 'py/.rb'][page_id % 12 + 1] END AS path, ['#!/usr/bin/env python3', '#!/usr/bin/node -x', '#!/bin/sh', '# python', '#!/bin/Deno'][page_id % 5 + 1] || chr(10) || html AS head FROM pages), g AS (SELECT *, lower(regexp_extract(path, '[^/]([.][^./]+)$', 1)) AS e, lower(split_part(head, chr(10), 1)) AS l FROM f) SELECT page_id, path, CASE WHEN e = '.py' THEN 'python' WHEN e IN ('.ts', '.tsx') THEN 'typescript' WHEN e IN ('.js', '.jsx') THEN 'javascript' WHEN e = '.go' THEN 'go' WHEN e = '.rb' THEN 'ruby' WHEN e = '.rs' THEN 'rust' WHEN e = '.cpp' THEN 'cpp' WHEN e = '.md' THEN 'markdown' WHEN e IN ('.yml', '.yaml') THEN 'yaml' WHEN e = '.json' THEN 'json' WHEN starts_with(l, '#!/') AND contains(l, 'python') THEN 'python' WHEN starts_with(l, '#!/') AND (contains(l, 'node') OR contains(l, 'deno')) THEN 'javascript' ELSE 'unknown' END AS language FROM g")
def s5_detect_language(spark, sf_dir):
    """By extension, then by the first line; paths and first lines of many forms."""
    ending, head = (F.array(*map(F.lit, x)) for x in (ENDINGS, HEADS))
    n = F.col("page_id").cast("int")
    path = F.concat(F.lit("a.b/f"), F.when(n % 4 == 3, "").otherwise(F.concat(F.lit("."), F.get(ending, n % 12))))
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.concat(F.get(head, n % 5), F.lit("\n"), "html").alias("head"))
    return rows.select("page_id", "path", scalars.language(F.col("path"), F.col("head")).alias("language"))


@query("SELECT event_type, count(*) AS events, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def x1_x2_json_fields(spark, sf_dir):
    """JSON attributes as a map."""
    k = scalars.json_map(F.col("props"))["k"].cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.sum(k).alias("total"))


@query("SELECT p_partkey AS id, p_type || ',' || p_brand AS joined, split_part(p_brand, '#', 2) AS last_part FROM part")
def x4_csv_lists(spark, sf_dir):
    """Comma lists and back, last segments."""
    parts = scalars.csv_list(F.concat(F.lit(" "), "p_type", F.lit(", ,"), "p_brand"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(parts, ",").alias("joined"), F.element_at(F.split("p_brand", "#"), -1).alias("last_part"))


@query("SELECT file_path, split_part(file_path, '/', 3) AS base, split_part(file_path, '/', 1) || '/' || split_part(file_path, '/', 2) AS folder FROM g_files")
def x5_base_and_folder(spark, sf_dir):
    return derived.files(spark, sf_dir).select("file_path", scalars.basename(F.col("file_path")).alias("base"), scalars.dirname(F.col("file_path")).alias("folder"))


@query("SELECT file_path, split_part(file_path, '/', 1) || '/lib/' || split_part(file_path, '/', 3) AS normal FROM g_files")
def x6_normal_paths(spark, sf_dir):
    from weftgraph.operators import resolve

    parts = F.split("file_path", "/")
    odd = F.concat(F.lit("./"), parts[0], F.lit("/"), parts[1], F.lit("/.././/lib/"), parts[2])
    return derived.files(spark, sf_dir).select("file_path", resolve.normalised(odd).alias("normal"))


@query("SELECT id, CAST(id AS INTEGER) AS line FROM g_symbols")
def x7_line_of_id(spark, sf_dir):
    symbol = F.concat_ws(":", "file_path", "name", "kind", F.col("id").cast("string"))
    return derived.symbols(spark, sf_dir).select("id", scalars.id_line(symbol).alias("line"))


VERBS = ("list_", "Get_", "retrieve_", "getter_", "post_", "CREATE_", "put_", "update_", "updates_", "patch_", "delete_", "_get_", "undelete_")


@query("WITH n AS (SELECT id, ['list_', 'Get_', 'retrieve_', 'getter_', 'post_', 'CREATE_', 'put_', 'update_', 'updates_', 'patch_', 'delete_', '_get_', 'undelete_'][id % 13 + 1] || replace(name, ' ', '_') AS name FROM g_symbols) SELECT id, name, CASE WHEN regexp_matches(name, '^(?i:get|list|retrieve)_') THEN 'GET' WHEN regexp_matches(name, '^(?i:create|post)_') THEN 'POST' WHEN regexp_matches(name, '^(?i:update|put)_') THEN 'PUT' WHEN regexp_matches(name, '^(?i)patch_') THEN 'PATCH' WHEN regexp_matches(name, '^(?i)delete_') THEN 'DELETE' END AS method FROM n")
def x9_http_method(spark, sf_dir):
    """Names that begin with a verb, and names that only look so."""
    verb = F.get(F.array(*map(F.lit, VERBS)), (F.col("id") % 13).cast("int"))
    named = derived.symbols(spark, sf_dir).select("id", F.concat(verb, F.replace("name", F.lit(" "), F.lit("_"))).alias("name"))
    return named.select("id", "name", scalars.http_method(F.col("name")).alias("method"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN substring(text, 1, 80) || '...' ELSE text END AS short, split_part(text, '.', 1) AS sentence, substring(sha1(text), 1, 10) AS sha, CAST(floor(length(text) / 4) AS BIGINT) AS tokens FROM documents")
def x10_x13_shortened_and_hashed(spark, sf_dir):
    """X10, X11, X13, X17."""
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", scalars.shortened(t, 80).alias("short"), F.split(t, r"\.")[0].alias("sentence"), F.substring(F.sha1(t), 1, 10).alias("sha"), scalars.tokens_by_length(t).alias("tokens"))


@query(f"SELECT doc_id, CAST(floor(len({WORDS}) * 1.33) AS BIGINT) AS tokens, sha256(CASE WHEN length(text) > 400 THEN substring(text, 1, 397) || '...' ELSE text END) AS digest FROM documents")
def x17_x18_token_budget(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", scalars.tokens_by_words(t).alias("tokens"), F.sha2(scalars.truncated_to_tokens(t, 100), 256).alias("digest"))


@query("SELECT p_partkey AS id, CAST((SELECT x FROM (SELECT unnest([1, 2, 3, 5, 8, 13, 21]) AS x) ORDER BY abs(x - p_size), x LIMIT 1) AS INTEGER) AS points FROM part")
def x19_nearest_points(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), scalars.nearest_points(F.col("p_size")).alias("points"))


@query("SELECT id, regexp_replace(name, '[^A-Za-z0-9_]', '_', 'g') AS safe, split_part(name, ' ', 1) || upper(substring(split_part(name, ' ', 2), 1, 1)) || substring(split_part(name, ' ', 2), 2) AS camel FROM g_symbols")
def x12_x22_names(spark, sf_dir):
    """Safe ids, snake case to camel case."""
    safe = scalars.safe_id(F.col("name"))
    return derived.symbols(spark, sf_dir).select("id", safe.alias("safe"), scalars.camel_case(safe).alias("camel"))


@query("SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS owner, regexp_extract(url, '://[^/]*/([a-z]+)/', 1) AS slug FROM pages")
def x21_url_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("owner"), F.regexp_extract("url", "://[^/]*/([a-z]+)/", 1).alias("slug"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS c, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents), b AS (SELECT *, sum(CASE WHEN regexp_matches(c, '^[A-Z][a-z]*') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS block FROM l) SELECT doc_id, CAST(block AS BIGINT) AS block, CAST(min(line) AS INTEGER) AS start_line, CAST(max(line) AS INTEGER) AS end_line, sha256(string_agg(c, chr(10) ORDER BY line)) AS digest FROM b GROUP BY doc_id, block HAVING trim(regexp_replace(string_agg(c, chr(10) ORDER BY line), '\\s+', ' ', 'g')) <> ''")
def c3_c4_marked_blocks(spark, sf_dir):
    """Blocks that begin at marked lines; here a line with a capital first."""
    out = text.marked_blocks(docs(spark, sf_dir), "doc_id", "text", "^[A-Z][a-z]*")
    return out.select("doc_id", "block", "start_line", "end_line", F.sha2("content", 256).alias("digest"))


@query("WITH d AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents), p AS (SELECT doc_id, unnest(string_split(t, chr(10) || chr(10))) AS c, generate_subscripts(string_split(t, chr(10) || chr(10)), 1) AS n FROM d) SELECT doc_id, CAST(n - 1 AS INTEGER) AS place, CAST(2 * n - 1 AS INTEGER) AS start_line, CAST(2 * n - 1 AS INTEGER) AS end_line, sha256(c) AS digest FROM p WHERE trim(c) <> ''")
def c6_paragraphs(spark, sf_dir):
    """Paragraphs with line numbers; each newline is doubled first."""
    doubled = docs(spark, sf_dir).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return text.paragraphs(doubled, "doc_id", "text").select("doc_id", "place", "start_line", "end_line", F.sha2("content", 256).alias("digest"))


@query("WITH RECURSIVE l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, floor(length(unnest(string_split(text, chr(10)))) / 4) AS tokens FROM documents), r AS (SELECT doc_id, line, tokens AS used, 0 AS chunk FROM l WHERE line = 1 UNION ALL SELECT l.doc_id, l.line, CASE WHEN r.used > 0 AND r.used + l.tokens > 200 THEN l.tokens ELSE r.used + l.tokens END, CASE WHEN r.used > 0 AND r.used + l.tokens > 200 THEN r.chunk + 1 ELSE r.chunk END FROM r JOIN l ON l.doc_id = r.doc_id AND l.line = r.line + 1) SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(min(line) AS INTEGER) AS first_line, count(*) AS lines FROM r GROUP BY doc_id, chunk")
def c8_c9_packed_lines(spark, sf_dir):
    """Greedy packing of lines into chunks of at most 200 tokens."""
    rows = text.lines(docs(spark, sf_dir), "doc_id", "text").withColumn("tokens", text.tokens(F.col("content")))
    out = text.packed(rows.select("doc_id", "line", "tokens"), "doc_id", "line", 200)
    return out.groupBy("doc_id", "chunk").agg(F.min("line").alias("first_line"), F.count(F.lit(1)).alias("lines"))


@query(f"WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents), p AS (SELECT doc_id, ws, unnest(range(0, CAST(floor((len(ws) - 1) / 50) AS BIGINT) + 1)) AS part FROM w WHERE len(ws) > 0) SELECT doc_id, CAST(part AS INTEGER) AS part, sha256(array_to_string(ws[part * 50 + 1:part * 50 + 50], ' ')) AS digest FROM p")
def c10_token_windows(spark, sf_dir):
    return text.token_windows(docs(spark, sf_dir), "doc_id", "text", 50).select("doc_id", "part", F.sha2("content", 256).alias("digest"))


@query("SELECT doc_id, array_to_string(list_sort(list_intersect(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_]+')), ['token', 'Licensed', 'rights', 'idiot', 'clown'])), ',') AS found FROM documents")
def c12_references(spark, sf_dir):
    names = F.array(*map(F.lit, ("token", "Licensed", "rights", "idiot", "clown")))
    return docs(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(text.references(None, "", "text", names)), ",").alias("found"))


@query("WITH p AS (SELECT page_id, regexp_replace(html, '<h[1-6][^>]*>', chr(10) || '# ', 'g') AS t FROM pages), l AS (SELECT page_id, t, unnest(string_split(t, chr(10))) AS c, generate_subscripts(string_split(t, chr(10)), 1) AS line FROM p), o AS (SELECT *, sum(length(c) + 1) OVER (PARTITION BY page_id ORDER BY line ROWS UNBOUNDED PRECEDING) - length(c) - 1 AS first FROM l), h AS (SELECT * FROM o WHERE regexp_matches(c, '^#{1,6}\\s+[^\\s]')) SELECT page_id, CAST(first AS BIGINT) AS first, CAST(coalesce(lead(first) OVER (PARTITION BY page_id ORDER BY line), length(t)) AS BIGINT) AS last, CAST(1 AS INTEGER) AS level FROM h")
def c13_sections(spark, sf_dir):
    """Headings and where their sections end; all pages have a heading."""
    marked = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", "<h[1-6][^>]*>", "\n# ").alias("text"))
    return text.sections(marked, "page_id", "text").select("page_id", "first", "last", "level")


# others than the leading and key sentences stay while their running length fits; no fold is needed
SENTENCES = r"""WITH t AS (SELECT doc_id, text, string_split(regexp_replace(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), '\n\n+', chr(1), 'g'), chr(1)) AS parts FROM documents),
s AS (SELECT doc_id, text, trim(unnest(parts)) AS s, generate_subscripts(parts, 1) AS place FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS n FROM s WHERE s <> ''),
k AS (SELECT *, n <= 2 OR regexp_matches(s, '(?i)(^|[^A-Za-z0-9_])(interface|class|def|model|constraint|endpoint|schema|api|type|return|param|error|response|request)([^A-Za-z0-9_]|$)|(^|[^A-Za-z0-9_])(require|validat)') AS fixed FROM p),
u AS (SELECT *, -1 + sum(CASE WHEN fixed THEN length(s) + 1 ELSE 0 END) OVER (PARTITION BY doc_id) + sum(CASE WHEN fixed THEN 0 ELSE length(s) + 1 END) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS used FROM k),
e AS (SELECT doc_id, string_agg(s, ' ' ORDER BY n) AS summary FROM u WHERE fixed OR used <= floor(length(text) * 0.5) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN length(d.text) < 100 OR e.doc_id IS NULL THEN d.text ELSE e.summary END AS summary FROM documents d LEFT JOIN e USING (doc_id)"""


@query(SENTENCES)
def c14_extractive_summary(spark, sf_dir):
    """C14: leading and key sentences, and others while half of the length isn't used."""
    return docs(spark, sf_dir).select("doc_id", text.summary(F.col("text")).alias("summary"))


ASSEMBLED = """WITH s AS (SELECT source AS document, 'doc_' || doc_id AS section, doc_id, 'In ' || lang || ': {{ref:summary}}, {{ref:doc_' || (doc_id + 1) || '}} and {{ref:none}}.' AS body FROM documents),
t AS (SELECT source AS document, 'doc_' || doc_id AS section, -doc_id AS place, CASE WHEN n_chars % 2 = 0 THEN 'Number ' || doc_id END AS title, CAST(n_chars % 4 + 1 AS INTEGER) AS level FROM documents WHERE lang = 'en'),
j AS (SELECT s.*, t.place, coalesce(t.title, 'Doc ' || s.doc_id) AS title, coalesce(t.level, 2) AS level, EXISTS (SELECT 1 FROM documents d WHERE d.source = s.document AND d.doc_id = s.doc_id + 1) AS linked FROM s LEFT JOIN t USING (document, section))
SELECT document, row_number() OVER (PARTITION BY document ORDER BY place IS NULL, place, section) AS position, section, level, '- [' || title || '](#doc-' || doc_id || ')' AS entry,
repeat('#', level) || ' ' || title || chr(10) || chr(10) || CASE WHEN linked THEN replace(replace(body, '{{ref:summary}}', '[Summary](#summary)'), '{{ref:doc_' || (doc_id + 1) || '}}', '[Doc ' || (doc_id + 1) || '](#doc-' || (doc_id + 1) || ')') ELSE replace(body, '{{ref:summary}}', '[Summary](#summary)') END || chr(10) AS content FROM j"""


@query(ASSEMBLED)
def c15_assembled(spark, sf_dir):
    """Documents put together from sections: in the template's order, others last, with entries and links."""
    number = F.col("doc_id").cast("string")
    section = F.concat(F.lit("doc_"), number)
    after = (F.col("doc_id") + 1).cast("string")
    body = F.concat(F.lit("In "), "lang", F.lit(": {{ref:summary}}, {{ref:doc_"), after, F.lit("}} and {{ref:none}}."))
    rows = docs(spark, sf_dir)
    title = F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("Number "), number))
    template = rows.where("lang = 'en'").select(F.col("source").alias("document"), section.alias("section"), (-F.col("doc_id")).alias("place"), title.alias("title"), (F.col("n_chars") % 4 + 1).cast("int").alias("level"))
    absent = rows.select(F.col("source").alias("document"), F.lit("summary").alias("section"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("string").alias("title"), F.lit(1).alias("level")).distinct()
    out = text.assembled(rows.select(F.col("source").alias("document"), section.alias("section"), body.alias("content")), template.unionByName(absent))
    return out.select("document", "position", "section", "level", "entry", "content")


@query("SELECT source, doc_id, doc_id || ':' || lang AS entry FROM documents ORDER BY source, doc_id")
def c15_contents(spark, sf_dir):
    """The entries of each collection, in order."""
    entry = F.concat_ws(":", F.col("doc_id").cast("string"), "lang").alias("entry")
    return docs(spark, sf_dir).select("source", "doc_id", entry).orderBy("source", "doc_id")


@query("SELECT doc_id, sha256(CASE WHEN length(text) <= 2000 THEN text WHEN contains(substring(text, 1, 2000), chr(10)) THEN substring(text, 1, 2000 - strpos(reverse(substring(text, 1, 2000)), chr(10))) ELSE substring(text, 1, 2000) END) AS digest FROM documents")
def c16_cut_at_line(spark, sf_dir):
    """Cut at the last line end within the limit."""
    head = F.substring("text", 1, 2000)
    cut = F.when(F.instr(head, "\n") > 0, F.substring(head, F.lit(1), 2000 - F.locate("\n", F.reverse(head)))).otherwise(head)
    return docs(spark, sf_dir).select("doc_id", F.sha2(F.when(F.length("text") <= 2000, F.col("text")).otherwise(cut), 256).alias("digest"))


@query("SELECT CASE WHEN s > 0 OR c > 0 THEN CASE WHEN s >= c THEN 'snake_case' ELSE 'camelCase' END END AS style, count(*) AS n FROM (SELECT len(regexp_extract_all(' ' || text || ' ', '[^A-Za-z0-9_][a-z][a-z0-9]*(_[a-z0-9]+)+[^A-Za-z0-9_]')) AS s, len(regexp_extract_all(' ' || text || ' ', '[^A-Za-z0-9_][a-z][a-z0-9]*([A-Z][a-z0-9]*)+[^A-Za-z0-9_]')) AS c FROM documents) GROUP BY 1")
def a19_naming_styles(spark, sf_dir):
    return docs(spark, sf_dir).groupBy(text.naming_style(F.col("text")).alias("style")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT path, count(DISTINCT host) AS hosts FROM (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages) GROUP BY path HAVING count(DISTINCT host) > 1")
def a20_duplicate_endpoints(spark, sf_dir):
    """Paths that several hosts serve."""
    rows = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("path"))
    return rows.groupBy("path").agg(F.count_distinct("host").alias("hosts")).where("hosts > 1")


ENTRY_SQL = "SELECT id, CASE WHEN name = 'main' THEN 'main' WHEN regexp_matches(file, '(routes?|views?|api|endpoints?|handlers?|controllers?)[.]py$') AND regexp_matches(name, '^(get|post|put|patch|delete|create|update|list|retrieve)_') THEN 'http' WHEN regexp_matches(file, '(cli|__main__|main|commands?)[.]py$') AND regexp_matches(name, '^(main|cli|run|execute)$|^command_|_command$') THEN 'cli' WHEN regexp_matches(name, '^(on|handle|process)_|_(handler|callback|listener)$') THEN 'event' WHEN regexp_matches(name, '^(task|job|schedule|cron)_|_(task|job)$') THEN 'scheduled' END AS kind FROM (SELECT id, CASE split_part(name, ' ', 1) WHEN 'red' THEN 'get_' || split_part(name, ' ', 2) WHEN 'blue' THEN 'on_' || split_part(name, ' ', 2) WHEN 'hot' THEN split_part(name, ' ', 2) || '_job' WHEN 'old' THEN 'run' ELSE 'main' END AS name, CASE kind WHEN 'promo' THEN 'views.py' WHEN 'small' THEN 'cli.py' ELSE 'x.py' END AS file FROM g_symbols)"


@query(f"SELECT * FROM ({ENTRY_SQL}) WHERE kind IS NOT NULL")
def l1_entry_points(spark, sf_dir):
    """Names and files are made from part names and types."""
    word, noun = F.split("name", " ")[0], F.split("name", " ")[1]
    name = F.when(word == "red", F.concat(F.lit("get_"), noun)).when(word == "blue", F.concat(F.lit("on_"), noun)).when(word == "hot", F.concat(noun, F.lit("_job"))).when(word == "old", "run").otherwise("main")
    file = F.when(F.col("kind") == "promo", "views.py").when(F.col("kind") == "small", "cli.py").otherwise("x.py")
    return derived.symbols(spark, sf_dir).select("id", analysis.entry_type(name, file).alias("kind")).where("kind IS NOT NULL")


DOMAIN_SQL = "SELECT id, name, CASE WHEN regexp_matches(name, '(Repository|Repo|DAO|Store|Gateway)$') THEN 'repository' WHEN regexp_matches(name, '(Service|Manager|Handler|Controller|Processor|Provider)$') THEN 'service' WHEN regexp_matches(name, '(Config|Settings|Options)$') THEN 'value_object' WHEN regexp_matches(name, '(Utils?|Helpers?|Mixin)$') THEN 'utility' WHEN regexp_matches(name, '(Model|Entity)$|^Base[A-Z]') THEN 'entity' END AS category FROM (SELECT id, CASE kind WHEN 'promo' THEN name || 'Store' WHEN 'small' THEN name || 'Service' WHEN 'large' THEN name || 'Options' WHEN 'medium' THEN name || 'Helper' WHEN 'economy' THEN name || 'Entity' ELSE name END AS name FROM g_symbols)"


def concepts(spark, sf_dir):
    endings = F.create_map(*(F.lit(x) for kv in {"promo": "Store", "small": "Service", "large": "Options", "medium": "Helper", "economy": "Entity"}.items() for x in kv))
    name = F.concat("name", F.coalesce(endings[F.col("kind")], F.lit("")))
    category = analysis.domain_category(name, F.col("file_path"), F.array().cast("array<string>"))
    return derived.symbols(spark, sf_dir).select("id", name.alias("name"), category.alias("category")).where("category IS NOT NULL")


@query(f"SELECT * FROM ({DOMAIN_SQL}) WHERE category IS NOT NULL")
def l2_domain_concepts(spark, sf_dir):
    return concepts(spark, sf_dir)


@query(f"WITH c AS (SELECT * FROM ({DOMAIN_SQL}) WHERE category IS NOT NULL), e AS (SELECT src, dst, min(CASE edge_type WHEN 'EXTENDS' THEN 0 ELSE 1 END) AS rank FROM g_edges WHERE src <> dst GROUP BY src, dst) SELECT e.src, e.dst, CASE WHEN rank = 0 THEN 'extends' WHEN a.category = 'entity' AND b.category = 'entity' THEN CASE WHEN contains(lower(a.name), lower(b.name)) THEN 'belongs_to' ELSE 'has_many' END ELSE 'uses' END AS relation FROM e JOIN c a ON a.id = e.src JOIN c b ON b.id = e.dst")
def l3_concept_relations(spark, sf_dir):
    return analysis.concept_relations(concepts(spark, sf_dir), derived.edges(spark, sf_dir))


@query("SELECT id, CASE WHEN regexp_matches(lower(name), 'save|store|persist|write|insert|update|delete|create|put|commit|flush|add|remove|set|repository|dao|db|database|cache|redis|mongo') THEN 'persist' WHEN regexp_matches(lower(name), 'return|response|result|output|serialize|format|render|json|to_dict|to_json|encode|transform') THEN 'return' ELSE 'process' END AS step FROM g_symbols")
def l4_step_types(spark, sf_dir):
    return derived.symbols(spark, sf_dir).select("id", analysis.step_type(F.col("name"), F.lit(""), F.lit(None)).alias("step"))


@query("WITH q AS (SELECT conv_id, turn, text, lower(text) AS low FROM conversations), f AS (SELECT *, regexp_matches(text, '[A-Z][a-z]+[A-Z]') OR regexp_matches(low, '[a-z]+_[a-z]+') AS identifier, regexp_matches(low, '(^|[^a-z0-9_])(function|class|method|file|module)([^a-z0-9_]|$)') OR regexp_matches(low, '[.]py|[.]js|[.]java|[.]ts|[.]go|[.]rb|def |import |from |authenticate|calculate|process|validate|service|controller|model|handler|manager') AS specific, len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS words, regexp_matches(low, 'how|what|why|explain|tell me about|show me') AS vague, regexp_matches(low, 'this|that|it|the code|the system|here|there') AS generic, regexp_matches(low, 'architecture|overview|core functionality|data flow|end-to-end|end to end|how does the|how do the|how it works|explain the|describe the|communicate|integrate|platform|pipeline|workflow|infrastructure') AS broad FROM q) SELECT conv_id, turn, CASE WHEN identifier OR specific OR (words >= 5 AND NOT vague AND NOT generic) OR (broad AND words >= 6) THEN 'clear' ELSE 'vague' END AS clarity, CASE WHEN broad AND words >= 6 AND NOT identifier AND NOT specific THEN 'architectural' WHEN identifier OR specific THEN 'specific' ELSE 'general' END AS kind FROM f")
def l16_question_class(spark, sf_dir):
    clarity, kind = analysis.question_class(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", clarity.alias("clarity"), kind.alias("kind"))


@query("WITH h AS (SELECT doc_id, lower(text) AS t FROM documents), s AS (SELECT doc_id, unnest([0, 1, 2, 3, 4]) AS k, unnest([list_sum([CAST(contains(t, w) AS INTEGER) FOR w IN ['analyze', 'pattern', 'dependency', 'structure', 'tracing']]), list_sum([CAST(contains(t, w) AS INTEGER) FOR w IN ['write', 'create', 'generate', 'refactor', 'implement']]), list_sum([CAST(contains(t, w) AS INTEGER) FOR w IN ['document', 'explain', 'research', 'understand', 'investigate']]), list_sum([CAST(contains(t, w) AS INTEGER) FOR w IN ['design', 'architecture', 'structure', 'evaluate']]), list_sum([CAST(contains(t, w) AS INTEGER) FOR w IN ['security', 'vulnerability', 'safe', 'audit']])]) AS n FROM h), b AS (SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, k) AS place FROM s) SELECT doc_id, ['code_analyst', 'code_generator', 'researcher', 'architect', 'security'][k + 1] AS agent FROM b WHERE place = 1")
def l17_agent_for(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", analysis.agent_for(F.col("text")).alias("agent"))


@query(r"WITH q AS (SELECT conv_id, turn, ['@', '  @', '/', ' /', 'to @', '', '@ ', '/-', '@no-'][(conv_id + turn) % 9 + 1] || text AS said FROM conversations) SELECT conv_id, turn, nullif(regexp_extract(said, '^\s*@([-_a-zA-Z0-9]+)', 1), '') AS name, nullif(regexp_extract(said, '^\s*/([-_a-zA-Z0-9]+)', 1), '') AS command, CASE WHEN regexp_matches(said, '^\s*/[-_a-zA-Z0-9]') THEN trim(regexp_replace(said, '^\s*/[-_a-zA-Z0-9]+', '')) END AS arguments FROM q")
def l18_mentions(spark, sf_dir):
    """Texts that begin with a mention, with a command, or with what only looks so."""
    marks = F.array(*map(F.lit, ("@", "  @", "/", " /", "to @", "", "@ ", "/-", "@no-")))
    said = F.concat(F.get(marks, ((F.col("conv_id") + F.col("turn")) % 9).cast("int")), "text")
    name, command, arguments = analysis.mention(said)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", name.alias("name"), command.alias("command"), arguments.alias("arguments"))


@query("WITH e AS (SELECT DISTINCT source AS item, lang AS term FROM documents UNION SELECT DISTINCT source, CAST(length(text) % 7 AS VARCHAR) FROM documents) SELECT a.item AS a, b.item AS b, count(*) AS n, round(CAST(least(1.0, 0.7 + 0.1 * count(*)) AS DOUBLE), 6) AS confidence FROM e a JOIN e b ON a.term = b.term AND a.item < b.item GROUP BY a.item, b.item")
def l11_related_repositories(spark, sf_dir):
    """Pairs of repositories that share evidence, through the evidence."""
    evidence = docs(spark, sf_dir).select(F.col("source").alias("item"), F.col("lang").alias("term")).unionByName(docs(spark, sf_dir).select(F.col("source").alias("item"), (F.length("text") % 7).cast("string").alias("term")))
    items = docs(spark, sf_dir).select(F.col("source").alias("item")).distinct()
    return analysis.related_pairs(items, evidence).withColumn("confidence", F.round("confidence", 6))


@query("SELECT doc_id, round(CAST(greatest(0.1, least(1.0, 0.5 + 0.1 * CAST(quality = 1 AS INTEGER) + 0.1 * CAST(toxic = 0 AS INTEGER) + 0.1 * CAST(doc_id % 2 = 0 AS INTEGER) + 0.05 * CAST(doc_id % 3 = 0 AS INTEGER) - 0.1 * (doc_id % 4) - 0.05 * (doc_id % 5))) AS DOUBLE), 6) AS score FROM labels")
def l13_l15_confidence(spark, sf_dir):
    """Additive scores within bounds."""
    n = F.col("doc_id")
    score = analysis.research_confidence(F.col("quality") == 1, F.col("toxic") == 0, n % 2 == 0, n % 3 == 0, n % 4, n % 5)
    return table(spark, sf_dir, "labels").select("doc_id", F.round(score, 6).alias("score"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def n8_last_turns(spark, sf_dir):
    """The last three turns."""
    from weftgraph.operators import state

    return state.last_of(table(spark, sf_dir, "conversations"), "conv_id", [F.desc("turn")], 3).select("conv_id", "turn", "role")


@query(r"WITH w AS (SELECT conv_id, turn, regexp_extract(text, '([A-Za-z0-9_]+)', 1) AS w, (conv_id * 7 + turn) % 9 AS k FROM conversations), q AS (SELECT *, ['How does the ' || w || ' module work?', 'what is ' || w || ' folder for', 'Please EXPLAIN the ' || w || ' package', 'an overview of ' || w, 'architecture of the ' || w || ' part', 'how does ' || w || ' work', 'what is the ' || w, 'explain ' || w || ' ' || w || ' domain', w][k + 1] AS q FROM w) SELECT conv_id, turn, CASE WHEN k = 0 THEN nullif(regexp_extract(lower(q), 'does (?:the )?([0-9a-z_]+) module work', 1), '') WHEN k = 1 THEN nullif(regexp_extract(lower(q), 'is (?:the )?([0-9a-z_]+) folder', 1), '') WHEN k IN (2, 7) THEN nullif(regexp_extract(lower(q), 'explain (?:the )?([0-9a-z_]+) (?:package|domain)', 1), '') WHEN k IN (3, 4) THEN nullif(regexp_extract(lower(q), 'of (?:the )?([0-9a-z_]+)', 1), '') END AS domain FROM q")
def r19_asked_domains(spark, sf_dir):
    """Questions of all forms about the first word of each text, and some of no form."""
    w = F.regexp_extract("text", "([A-Za-z0-9_]+)", 1)
    forms = F.array(*(F.format_string(x, w) for x in ("How does the %s module work?", "what is %s folder for", "Please EXPLAIN the %s package", "an overview of %s", "architecture of the %s part", "how does %s work", "what is the %s", "explain %1$s %1$s domain", "%s")))
    asked = F.get(forms, ((F.col("conv_id") * 7 + F.col("turn")) % 9).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", retrieval.asked_domain(asked).alias("domain"))


@query("SELECT lang, doc_id, more FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n, CAST(greatest(0, count(*) OVER (PARTITION BY lang) - 10) AS BIGINT) AS more FROM documents) WHERE n <= 10")
def a18_top_of_type(spark, sf_dir):
    return analysis.top_of_type(docs(spark, sf_dir), "lang", ["doc_id"]).select("lang", "doc_id", F.col("more").cast("long").alias("more"))
