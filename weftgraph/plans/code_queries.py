"""Source files made of parts, and what is read from them: symbols, relations, chunks, modules, the index."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import scalars
from weftgraph.operators import code, index, resolve, retrieval
from weftgraph.operators.files import spread
from weftgraph.sources.tables import table

from .registry import query

#: Eleven lines for each part of a file, after a header of two.
HEADER = "import os.path\nfrom .mod{next} import thing\n"
BLOCK = '''class K{id}(K{base}):
    @wrap(1)
    def m{id}(self, a, b):
        """Doc of {name}."""
        if a and b:
            return _f{id}(a)
        return b

async def _f{id}(x):
    return [y for y in x]

'''
SCRIPT = """import { z } from './{size}';
export abstract class K{id} extends Base{size} implements Open {
  private async load{id}(a: string): Promise<void> {
    if (a) {
    }
  }
}
export interface I{id} extends Other { }
const enum E{id} { A }
type T{id} = string
export const g{id} = async (x) => x
function* h{id}() {
}
let not{id} = 3
"""

PARTS = "s AS (SELECT p_partkey AS id, p_name AS name, p_size AS size, 'pkg' || split_part(p_brand, '#', 2) || '/' || lower(p_type) || '/mod' || p_size || '.py' AS file_path FROM part), p AS (SELECT *, 3 + 11 * (row_number() OVER (PARTITION BY file_path ORDER BY id) - 1) AS pos, min(id) OVER (PARTITION BY file_path) AS base FROM s)"


def parts(spark, sf_dir):
    path = F.concat(F.lit("pkg"), F.element_at(F.split("p_brand", "#"), 2), F.lit("/"), F.lower("p_type"), F.lit("/mod"), F.col("p_size").cast("string"), F.lit(".py"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), path.alias("file_path"))


def filled(template: str, **values):
    text = F.lit(template)
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value.cast("string"))
    return text


def python_files(spark, sf_dir):
    """file_path, language, content: a file of the parts that share brand, type and size."""
    rows = parts(spark, sf_dir)
    base = rows.groupBy("file_path").agg(F.min("id").alias("base"))
    block = filled(BLOCK, id=F.col("id"), base=F.col("base"), name=F.col("name"))
    blocks = rows.join(base, "file_path").groupBy("file_path", "size").agg(F.array_sort(F.collect_list(F.struct("id", block.alias("block")))).alias("blocks"))
    content = F.concat(filled(HEADER, next=F.col("size") % 50 + 1), F.array_join(F.transform("blocks", lambda x: x["block"]), ""))
    return blocks.select("file_path", F.lit("python").alias("language"), content.alias("content"))


def script_files(spark, sf_dir):
    rows = spread(parts(spark, sf_dir), "id")  # texts are long to make, too
    return rows.select(F.concat(F.lit("web/"), F.col("id").cast("string"), F.lit(".ts")).alias("file_path"), filled(SCRIPT, id=F.col("id"), size=F.col("size")).alias("content"))


@query(f"WITH {PARTS} SELECT file_path, 'K' || id AS name, 'class' AS kind, NULL AS parent, pos AS start_line, pos + 6 AS end_line, 'public' AS visibility, 'K' || base AS bases, '' AS decorators, '' AS parameters, false AS is_async, 3 AS complexity, NULL AS doc FROM p UNION ALL SELECT file_path, 'm' || id, 'method', 'K' || id, pos + 1, pos + 6, 'public', '', 'wrap(1)', 'a,b', false, 3, 'Doc of ' || name || '.' FROM p UNION ALL SELECT file_path, '_f' || id, 'function', NULL, pos + 8, pos + 9, 'protected', '', '', 'x', true, 2, NULL FROM p")
def p1_p6_python_symbols(spark, sf_dir):
    """Classes, methods and functions with lines, visibility and complexity."""
    found = code.python_symbols(python_files(spark, sf_dir))
    lists = {c: F.array_join(c, ",") for c in ("bases", "decorators", "parameters")}
    return found.withColumns(lists | {"start_line": F.col("start_line").cast("long"), "end_line": F.col("end_line").cast("long")})


@query(f"WITH {PARTS}, f AS (SELECT DISTINCT file_path, size FROM p) SELECT file_path, NULL AS source, 'IMPORTS' AS relation, 'os.path' AS target, 1 AS line FROM f UNION ALL SELECT file_path, NULL, 'IMPORTS', '.mod' || (size % 50 + 1), 2 FROM f UNION ALL SELECT file_path, 'K' || id, 'EXTENDS', 'K' || base, pos FROM p UNION ALL SELECT file_path, 'm' || id, 'CALLS', 'wrap', pos + 1 FROM p UNION ALL SELECT file_path, 'm' || id, 'CALLS', '_f' || id, pos + 5 FROM p UNION ALL SELECT file_path, 'wrap', 'DECORATES', 'm' || id, pos + 1 FROM p")
def p3_python_relations(spark, sf_dir):
    return code.python_relations(python_files(spark, sf_dir)).withColumn("line", F.col("line").cast("long"))


CHUNKS = f"{PARTS}, c AS (SELECT file_path, CASE WHEN pos = 3 THEN 1 ELSE pos - 1 END AS start_line, pos AS end_line, NULL AS symbol, CASE WHEN pos = 3 THEN 'import os.path' || chr(10) || 'from .mod' || (size % 50 + 1) || ' import thing' || chr(10) ELSE chr(10) END || 'class K' || id || '(K' || base || '):' AS content FROM p UNION ALL SELECT file_path, pos + 1, pos + 6, 'm' || id, '    @wrap(1)' || chr(10) || '    def m' || id || '(self, a, b):' || chr(10) || '        \"\"\"Doc of ' || name || '.\"\"\"' || chr(10) || '        if a and b:' || chr(10) || '            return _f' || id || '(a)' || chr(10) || '        return b' FROM p UNION ALL SELECT file_path, pos + 8, pos + 9, '_f' || id, 'async def _f' || id || '(x):' || chr(10) || '    return [y for y in x]' FROM p)"


@query(f"WITH {CHUNKS} SELECT file_path || ':' || start_line || '-' || end_line || ':' || substring(sha1(content), 1, 10) AS chunk_id, symbol FROM c")
def c1_code_chunks(spark, sf_dir):
    """A chunk for each method and function, and for what lies between; the id holds a hash of the content."""
    files = python_files(spark, sf_dir)
    return code.code_chunks(files, code.python_symbols(files)).select("chunk_id", "symbol")


LONG = """WITH RECURSIVE s AS (SELECT p_partkey AS id, p_size AS n FROM part),
g AS (SELECT id, 0 AS k, 'def f' || id || '(a):' AS t FROM s UNION ALL SELECT id, k, '    if a == ' || k || ':' || chr(10) || '        ' || repeat('x', CASE WHEN k % 11 = 10 THEN 300 ELSE 1 + (k * 7) % 40 END) FROM (SELECT id, unnest(range(1, n + 1)) AS k FROM s)),
w AS (SELECT id, floor((sum(length(t) + 1) - 1) / 4) <= 50 AS fits FROM g GROUP BY id),
c AS (SELECT id, k, t, CASE WHEN fits THEN 0 ELSE length(t) + 1 END AS cost FROM g JOIN w USING (id)),
r AS (SELECT id, k, cost AS used, 0 AS part FROM c WHERE k = 0 UNION ALL SELECT c.id, c.k, CASE WHEN r.used + c.cost > 192 THEN c.cost ELSE r.used + c.cost END, CASE WHEN r.used + c.cost > 192 THEN r.part + 1 ELSE r.part END FROM r JOIN c ON c.id = r.id AND c.k = r.k + 1),
o AS (SELECT id, part, min(k) AS a, max(k) AS b, max(cost) > 192 AS alone, string_agg(t, chr(10) ORDER BY k) AS t FROM r JOIN c USING (id, k) GROUP BY id, part),
e AS (SELECT id, a = 0 AS opens, CASE WHEN a = 0 THEN 1 ELSE 2 * a END AS first, 2 * b + 1 AS last, t FROM o WHERE NOT alone
UNION ALL SELECT id, false, 2 * a, 2 * a, split_part(t, chr(10), 1) FROM o WHERE alone
UNION ALL SELECT id, false, 2 * a + 1, 2 * a + 1, substring(split_part(t, chr(10), 2), x, 188) FROM o, (SELECT unnest([1, 189]) AS x) WHERE alone)
SELECT 'f' || id || '.py' AS file_path, CAST(first AS INTEGER) AS start_line, CAST(last AS INTEGER) AS end_line, CASE WHEN opens THEN 'f' || id END AS symbol, sha256(t) AS digest FROM e"""


@query(LONG)
def c7_split_functions(spark, sf_dir):
    """Functions over the budget are split at control flow; what is still too large by lines, and such lines in pieces."""
    part = lambda k: F.concat(F.lit("\n    if a == "), k.cast("string"), F.lit(":\n        "), F.repeat(F.lit("x"), F.when(k % 11 == 10, 300).otherwise(1 + (k * 7) % 40)))
    body = F.array_join(F.transform(F.sequence(F.lit(1), "p_size"), part), "")
    rows = table(spark, sf_dir, "part").where("p_size IS NOT NULL").select(F.col("p_partkey").cast("string").alias("id"), body.alias("body"))
    files = rows.select(F.concat(F.lit("f"), "id", F.lit(".py")).alias("file_path"), F.concat(F.lit("def f"), "id", F.lit("(a):"), "body").alias("content"))
    out = code.fitted_chunks(code.code_chunks(files, code.python_symbols(files)), 50)
    return out.select("file_path", "start_line", "end_line", "symbol", F.sha2("content", 256).alias("digest"))


@query(f"WITH {CHUNKS} SELECT c.file_path, count(*) AS chunks FROM c JOIN (SELECT DISTINCT file_path, size FROM s) f USING (file_path) WHERE size % 2 = 0 GROUP BY c.file_path")
def w29_regenerated_chunks(spark, sf_dir):
    """Chunks of the files that are marked as indexed, made again without a graph."""
    size = F.regexp_extract("file_path", r"mod(\d+)\.py$", 1).cast("int")
    files = python_files(spark, sf_dir).where(size % 2 == 0)
    return index.chunks_of(files, code.python_symbols(files), 512).groupBy("file_path").agg(F.count(F.lit(1)).alias("chunks"))


@query("WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders), b AS (SELECT k || '.md' AS file_path, unnest([1, 3, 5]) AS start_line, unnest([2, 4, 6]) AS end_line, unnest(['intro ' || k || chr(10), '# ' || p || chr(10) || 'Order ' || k, '## Status' || chr(10) || s]) AS content FROM o WHERE k % 4 = 0 UNION ALL SELECT k || '.yaml', unnest([1, 2]), unnest([1, 4]), unnest(['order: ' || k, 'items:' || chr(10) || '  - ' || p || chr(10) || '  - x: 1']) FROM o WHERE k % 4 = 1 UNION ALL SELECT k || '.json', 1, 1, '{\"order\": ' || k || '}' FROM o WHERE k % 4 = 2 UNION ALL SELECT k || '.txt', unnest([1, 3]), unnest([1, 4]), unnest(['one ' || s, 'two ' || p || chr(10) || 'three']) FROM o WHERE k % 4 = 3) SELECT file_path, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, content FROM b")
def c2_c5_text_chunks(spark, sf_dir):
    """Markdown by headings, YAML by keys, JSON whole, texts by paragraphs."""
    k, s, p = F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority")
    forms = (
        (".md", F.concat(F.lit("intro "), k, F.lit("\n\n# "), p, F.lit("\nOrder "), k, F.lit("\n## Status\n"), s)),
        (".yaml", F.concat(F.lit("order: "), k, F.lit("\nitems:\n  - "), p, F.lit("\n  - x: 1"))),
        (".json", F.concat(F.lit('{"order": '), k, F.lit("}"))),
        (".txt", F.concat(F.lit("one "), s, F.lit("\n\ntwo "), p, F.lit("\nthree"))),
    )
    n = F.col("o_orderkey") % 4
    path, content = (F.coalesce(*(F.when(n == i, x[side] if side else F.concat(k, F.lit(x[0]))) for i, x in enumerate(forms))) for side in (0, 1))
    files = table(spark, sf_dir, "orders").select(path.alias("file_path"), content.alias("content"))
    return code.text_chunks(files, 1000).select("file_path", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), "content")


@query("WITH s AS (SELECT p_partkey AS id, p_size AS size, 'web/' || p_partkey || '.ts' AS file_path FROM part), r AS (SELECT file_path, unnest(['K', 'load', 'I', 'E', 'T', 'g', 'h']) || id AS name, unnest(['class', 'method', 'interface', 'enum', 'type_alias', 'function', 'function']) AS kind, unnest([2, 3, 8, 9, 10, 11, 12]) AS start_line, unnest(['public', 'private', 'public', 'public', 'public', 'public', 'public']) AS visibility, unnest([false, true, false, false, false, true, false]) AS is_async, unnest(['Base' || size, '', 'Other', '', '', '', '']) AS bases FROM s) SELECT file_path, name, kind, CAST(start_line AS INTEGER) AS start_line, visibility, is_async, bases FROM r")
def p4_p5_script_symbols(spark, sf_dir):
    """Classes, methods, interfaces, enums, types and functions of scripts."""
    found = code.script_symbols(script_files(spark, sf_dir)).select("file_path", "name", "kind", "start_line", "visibility", "is_async", "bases")
    return found.withColumn("bases", F.array_join("bases", ","))


#: What line patterns get wrong: texts, templates and comments that look like code, nested functions, values with arrows.
NESTED = """// class No{id} {}
import a, { b } from './{size}'; /* import './no' */
export class C{id}<T> extends ns.Base{size}<T> implements I{id}, J {
  text = `class X {} ${helper{id}(`in ${deep{id}()}`)}`;
  handle = async (e: Event): Promise<void> => this.go{id}(e);
  static run(x: { a: string }): { b: number } {
    const re = /[}"]call\\(/g, s = "call(";
    function inner{id}() { return new Other{id}(); }
    return x.call{id}(inner{id}());
  }
}
const add{id} = a => b => plus{id}(a, b),
  more = 1;
"""


def nested_files(spark, sf_dir):
    rows = spread(parts(spark, sf_dir), "id")
    return rows.select(F.concat(F.lit("web/n"), F.col("id").cast("string"), F.lit(".ts")).alias("file_path"), filled(NESTED, id=F.col("id"), size=F.col("size")).alias("content"))


@query("WITH s AS (SELECT p_partkey AS id, 'web/n' || p_partkey || '.ts' AS file_path FROM part) SELECT file_path, unnest(['C' || id, 'handle', 'run', 'inner' || id, 'add' || id]) AS name, unnest(['class', 'method', 'method', 'function', 'function']) AS kind, unnest([NULL, 'C' || id, 'C' || id, 'run', NULL]) AS parent, CAST(unnest([3, 5, 6, 8, 12]) AS INTEGER) AS start_line, CAST(unnest([11, 5, 10, 8, 12]) AS INTEGER) AS end_line, unnest([false, false, true, false, false]) AS is_static, unnest([false, true, false, false, false]) AS is_async FROM s")
def p4_p5_nested_symbols(spark, sf_dir):
    """Spans and nesting, with texts, templates, comments and regular expressions that look like code."""
    return code.script_symbols(nested_files(spark, sf_dir)).select("file_path", "name", "kind", "parent", "start_line", "end_line", "is_static", "is_async")


@query("WITH s AS (SELECT p_partkey AS id, p_size AS size, 'web/n' || p_partkey || '.ts' AS file_path FROM part) SELECT file_path, unnest([NULL, 'C' || id, 'C' || id, 'C' || id, 'handle', 'inner' || id, 'run', 'run', 'add' || id]) AS source, unnest(['IMPORTS', 'EXTENDS', 'IMPLEMENTS', 'IMPLEMENTS', 'CALLS', 'CALLS', 'CALLS', 'CALLS', 'CALLS']) AS relation, unnest(['./' || size, 'ns.Base' || size, 'I' || id, 'J', 'go' || id, 'Other' || id, 'call' || id, 'inner' || id, 'plus' || id]) AS target, CAST(unnest([2, 3, 3, 3, 5, 8, 9, 9, 12]) AS INTEGER) AS line FROM s")
def p4_p5_script_relations(spark, sf_dir):
    """Imports, calls of the innermost function, base classes and interfaces."""
    return code.script_relations(nested_files(spark, sf_dir)).select("file_path", "source", "relation", "target", "line")


@query("WITH s AS (SELECT DISTINCT 'pkg' || split_part(p_brand, '#', 2) AS a, lower(p_type) AS b, p_size AS n FROM part), f AS (SELECT *, a || '/' || b || '/mod' || n || ['.ts', '.jsx', '/index.js', '.py'][n % 4 + 1] AS file_path FROM s), w AS (SELECT file_path AS importer, './mod' || (n % 50 + 1) AS module, a || '/' || b || CASE WHEN n % 4 = 2 THEN '/mod' || n ELSE '' END || '/mod' || (n % 50 + 1) AS base FROM f UNION ALL SELECT file_path, '../promo/mod' || n || '.ts', a || CASE WHEN n % 4 = 2 THEN '/' || b ELSE '' END || '/promo/mod' || n || '.ts' FROM f UNION ALL SELECT file_path, 'react', NULL FROM f), t AS (SELECT w.importer, w.module, f.file_path AS target, row_number() OVER (PARTITION BY w.importer, w.module ORDER BY e.rank) AS k FROM w, (SELECT unnest(['', '.ts', '.tsx', '.js', '.jsx', '/index.ts', '/index.tsx', '/index.js', '/index.jsx']) AS ending, unnest(range(9)) AS rank) e JOIN f ON f.file_path = w.base || e.ending) SELECT w.importer, w.module, t.target, t.target IS NULL AS is_external FROM w LEFT JOIN t ON t.importer = w.importer AND t.module = w.module AND t.k = 1")
def p9_script_modules(spark, sf_dir):
    """Relative imports of scripts, by the endings in their order; others are external."""
    rows = parts(spark, sf_dir).select(F.regexp_replace("file_path", r"\.py$", "").alias("stem"), F.col("size").alias("n")).distinct()
    endings = F.array(*map(F.lit, (".ts", ".jsx", "/index.js", ".py")))
    files = rows.select(F.concat("stem", F.get(endings, F.col("n") % 4)).alias("file_path"), "n")
    modules = F.array(F.concat(F.lit("./mod"), (F.col("n") % 50 + 1).cast("string")), F.concat(F.lit("../promo/mod"), F.col("n").cast("string"), F.lit(".ts")), F.lit("react"))
    wanted = files.select(F.col("file_path").alias("importer"), F.explode(modules).alias("module"), F.lit("typescript").alias("language"))
    return resolve.resolve_modules(wanted, files).select("importer", "module", "target", "is_external")


@query(r"""WITH t AS (SELECT p_partkey AS id, 'File "lib/' || replace(p_name, ' ', '_') || '.py", line ' || p_size || chr(10) || '  at run (src/m' || p_partkey || '.js:' || p_size || ':7)' || chr(10) || 'lib/y.c:12 and lib/y.c:13' AS t FROM part), z AS (SELECT id, list_concat(list_concat(list_zip(regexp_extract_all(t, 'File "([^"]+)", line (\d+)', 1), regexp_extract_all(t, 'File "([^"]+)", line (\d+)', 2)), list_zip(regexp_extract_all(t, 'at\s+(?:\S+\s+\()?([^:]+):(\d+)', 1), regexp_extract_all(t, 'at\s+(?:\S+\s+\()?([^:]+):(\d+)', 2))), list_zip(regexp_extract_all(t, '([^\s:]+):(\d+)', 1), regexp_extract_all(t, '([^\s:]+):(\d+)', 2))) AS z FROM t), u AS (SELECT id, unnest(z) AS f, generate_subscripts(z, 1) AS k FROM z), g AS (SELECT id, f[1] AS file, min(k) AS k, arg_min(f[2], k) AS line FROM u GROUP BY id, f[1]) SELECT id, string_agg(file || ':' || line, ',' ORDER BY k) AS frames FROM g GROUP BY id""")
def r4_error_frames(spark, sf_dir):
    """Files and lines of error stacks of three forms, the first of each file."""
    n = F.col("size").cast("string")
    stack = F.concat(F.lit('File "lib/'), F.replace("name", F.lit(" "), F.lit("_")), F.lit('.py", line '), n, F.lit("\n  at run (src/m"), F.col("id").cast("string"), F.lit(".js:"), n, F.lit(":7)\nlib/y.c:12 and lib/y.c:13"))
    found = F.transform(retrieval.frames(stack), lambda x: F.concat_ws(":", x["file"], x["line"].cast("string")))
    return parts(spark, sf_dir).select("id", F.array_join(found, ",").alias("frames"))


@query("WITH q AS (SELECT id, replace(['a/b/N', '../N', 'a/../../N', '/abs/N', './a/./../N', 'a//b/../..', 'a/b/../../../N', 'N', 'a/..', 'x/../../x/N/y'][id % 10 + 1], 'N', CAST(id AS VARCHAR)) AS path FROM g_symbols), u AS (SELECT id, path, unnest(string_split(path, '/')) AS x, generate_subscripts(string_split(path, '/'), 1) AS k FROM q), w AS (SELECT id, path, sum(CASE WHEN x IN ('', '.') THEN 0 WHEN x = '..' THEN -1 ELSE 1 END) OVER (PARTITION BY id ORDER BY k) AS depth FROM u) SELECT id, NOT starts_with(path, '/') AND min(depth) >= 0 AS inside FROM w GROUP BY id, path")
def f19_inside_root(spark, sf_dir):
    """paths that stay below their root, and paths that leave it."""
    forms = F.array(*map(F.lit, ("a/b/N", "../N", "a/../../N", "/abs/N", "./a/./../N", "a//b/../..", "a/b/../../../N", "N", "a/..", "x/../../x/N/y")))
    path = F.replace(F.get(forms, (F.col("id") % 10).cast("int")), F.lit("N"), F.col("id").cast("string"))
    return parts(spark, sf_dir).select("id", scalars.inside(path).alias("inside"))


@query("SELECT kind, count(*) AS n, min(name) AS first FROM g_symbols WHERE name LIKE 'r%' GROUP BY kind ORDER BY n DESC, kind LIMIT 4")
def f20_guarded_query(spark, sf_dir):
    """A reading statement on named views, with a limit on its rows."""
    from weftgraph.engine import guarded
    from weftgraph.sources import derived

    views = {"nodes": derived.symbols(spark, sf_dir)}
    return guarded(spark, "WITH r AS (SELECT * FROM nodes WHERE name LIKE 'r%') SELECT kind, count(*) AS n, min(name) AS first FROM r GROUP BY kind ORDER BY n DESC, kind", 4, views)


INDEXED = f"""WITH {PARTS}, f AS (SELECT DISTINCT file_path, size, regexp_replace(file_path, '/[^/]*$', '') AS folder FROM p), d AS (SELECT DISTINCT folder FROM f UNION SELECT DISTINCT split_part(folder, '/', 1) FROM f)
SELECT 'node' AS what, 'file' AS kind, count(*) AS n FROM f UNION ALL SELECT 'node', 'directory', count(*) FROM d UNION ALL SELECT 'node', unnest(['class', 'method', 'function']), count(*) FROM p
UNION ALL SELECT 'edge', 'CONTAINS', (SELECT count(*) FROM d) + (SELECT count(*) FROM f) + 3 * (SELECT count(*) FROM p) UNION ALL SELECT 'edge', 'CALLS', count(*) FROM p UNION ALL SELECT 'edge', 'EXTENDS', count(*) FROM p WHERE id <> base
UNION ALL SELECT 'edge', 'IMPORTS', count(*) FROM f a JOIN f b ON b.folder = a.folder AND b.size = a.size % 50 + 1 UNION ALL SELECT 'link', 'symbol', 3 * count(*) FROM p"""


@query(INDEXED)
def p13_p14_index_job(spark, sf_dir):
    """Files to nodes, edges, chunks and links, by kind and type."""
    made = index.index_files(python_files(spark, sf_dir))
    counts = [made.nodes.select(F.lit("node").alias("what"), "kind"), made.edges.select(F.lit("edge").alias("what"), F.col("edge_type").alias("kind")), made.links.select(F.lit("link").alias("what"), F.lit("symbol").alias("kind"))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).groupBy("what", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(INDEXED.replace("FROM part)", "FROM part WHERE p_size % 10 <> 3)", 1))
def p14_reindexed(spark, sf_dir):
    """Files that change, come and go after an index was made; the result is that of the files as they are in the end."""
    files = python_files(spark, sf_dir)
    size = F.regexp_extract("file_path", r"mod(\d+)\.py$", 1).cast("int")
    first = files.where(size % 10 != 5).withColumn("content", F.when(size % 10 == 7, F.lit("import os\n\ndef gone():\n    m1()\n")).otherwise(F.col("content")))
    changed = files.where((size % 10).isin(1, 5, 7))  # those of 1 are as they were
    made = index.reindexed(index.index_files(first), changed, removed=files.where(size % 10 == 3).select("file_path"))
    counts = [made.nodes.select(F.lit("node").alias("what"), "kind"), made.edges.select(F.lit("edge").alias("what"), F.col("edge_type").alias("kind")), made.links.select(F.lit("link").alias("what"), F.lit("symbol").alias("kind"))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).groupBy("what", "kind").agg(F.count(F.lit(1)).alias("n"))
