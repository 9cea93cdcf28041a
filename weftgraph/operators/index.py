"""The index job: from source files to nodes, edges and chunks of a property graph, and its maintenance.

What is read from a file alone (symbols, references by name, imports by module, chunks) is kept apart from what needs
all files (the targets of references and imports). When files change, only these are read again, and only references
whose target may have changed are resolved again: those of the changed files, those whose name has gained or lost a
symbol, and imports that may mean a file that came or went.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.sources.tables import written

from . import code, resolve

SCRIPTS = ("javascript", "typescript")


class Index(NamedTuple):
    """nodes (id, name, kind, file_path, summary), edges (src, dst, edge_type), chunks (chunk_id,
    file_path, start_line, end_line, symbol, content), links (chunk_id, id), files (file_path, language, digest),
    symbols (id, name, kind, file_path, start_line, end_line, parent, summary), references (file_path, src, relation,
    target_name, target) and imports (file_path, module, language, target), of which targets may be null."""

    nodes: DataFrame
    edges: DataFrame
    chunks: DataFrame
    links: DataFrame
    files: DataFrame
    symbols: DataFrame
    references: DataFrame
    imports: DataFrame


class _Read(NamedTuple):
    """What files hold, each by itself."""

    symbols: DataFrame
    references: DataFrame
    imports: DataFrame
    chunks: DataFrame
    links: DataFrame


def symbol_id(path: Column, name: Column, kind: Column, line: Column) -> Column:
    return F.concat_ws(":", path, name, kind, line.cast("string"))


def symbols(files: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """id, name, kind, file_path, start_line, end_line, parent, summary of all symbols of ``files``.

    ``contents``: what ``code.python_contents`` gives for them, if that has been read.
    """
    python = code.python_symbols(files.where("language = 'python'")) if contents is None else contents
    python = python.where(F.col("kind") != code.UNPARSED)  # a relation's is null
    scripts = code.script_symbols(files.where(F.col("language").isin(*SCRIPTS)))
    both = python.select("file_path", "name", "kind", "parent", "start_line", "end_line", "doc", F.array_join("parameters", ", ").alias("said"))
    both = both.unionByName(scripts.select("file_path", "name", "kind", "parent", "start_line", "end_line", F.lit(None).cast("string").alias("doc"), F.array_join(F.concat("bases", "interfaces"), ", ").alias("said")))
    summary = F.concat_ws(" | ", F.concat_ws(" ", "kind", "name"), F.nullif("said", F.lit("")), F.substring_index("doc", "\n", 1))
    return both.select(symbol_id(F.col("file_path"), F.col("name"), F.col("kind"), F.col("start_line")).alias("id"), "name", "kind", "file_path", "start_line", "end_line", "parent", summary.alias("summary"))


def chunks_of(files: DataFrame, found: DataFrame, budget: int) -> DataFrame:
    """Chunks of indexed files without a graph being written: code by symbols, those over the budget
    split at control flow, other files as texts."""
    read = F.col("language").isin("python", *SCRIPTS)
    spans = found.join(files.where(read).select("file_path").distinct(), "file_path", "left_semi")
    made = written(code.code_chunks(files.where(read), spans)).drop("chunk_id")
    large = F.floor(F.length("content") / 4) > budget
    # most fit, and go to no task that would split them
    parts = made.where(~large).unionByName(code.fitted_chunks(made.where(large), budget))
    texts = code.text_chunks(files.where(~F.coalesce(read, F.lit(False))), budget).select("file_path", "start_line", "end_line", F.lit(None).cast("string").alias("symbol"), "content")
    every = parts.unionByName(texts)
    return every.select(code.chunk_id(F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("content")).alias("chunk_id"), *every.columns)


def _read(rows: DataFrame, budget: int) -> _Read:
    python, scripts = rows.where("language = 'python'"), rows.where(F.col("language").isin(*SCRIPTS))
    contents = written(code.python_contents(python))
    found = written(symbols(rows, contents))
    relations = contents.where("relation IS NOT NULL")
    of_scripts = written(code.script_relations(scripts))

    named = found.select("file_path", F.col("name").alias("source"), F.col("id").alias("src"))
    said = relations.where("relation IN ('CALLS', 'EXTENDS')").join(named, ["file_path", "source"]).select("file_path", "src", "relation", F.col("target").alias("target_name"))
    own = symbol_id(F.col("file_path"), F.col("source"), F.col("source_kind"), F.col("source_line"))
    said = said.unionByName(of_scripts.where("relation <> 'IMPORTS'").select("file_path", own.alias("src"), "relation", F.element_at(F.split("target", r"\."), -1).alias("target_name")))

    wanted = relations.where("relation = 'IMPORTS'").select("file_path", F.col("target").alias("module"), F.lit("python").alias("language"))
    wanted = wanted.unionByName(of_scripts.where("relation = 'IMPORTS'").select("file_path", F.col("target").alias("module"), F.lit("typescript").alias("language")))

    chunks = written(chunks_of(rows, found, budget))
    inside = found.select(F.col("file_path").alias("of_file"), "id", F.col("start_line").alias("at"))
    links = chunks.join(inside, (F.col("file_path") == F.col("of_file")) & F.col("at").between(F.col("start_line"), F.col("end_line"))).select("chunk_id", "id", "file_path")
    return _Read(found, written(said.distinct()), written(wanted.distinct()), chunks, links)


def _resolved(references: DataFrame, found: DataFrame) -> DataFrame:
    asked = references.select("src", F.lit(None).cast("string").alias("target_id"), "target_name", F.col("file_path").alias("target_file"), "relation")
    return resolve.resolve_targets(asked, found.select("id", "name", "file_path")).select(F.col("target_file").alias("file_path"), "src", "relation", "target_name", "target")


def _imported(imports: DataFrame, files: DataFrame) -> DataFrame:
    asked = imports.select(F.col("file_path").alias("importer"), "module", "language")
    return resolve.resolve_modules(asked, files).select(F.col("importer").alias("file_path"), "module", "language", "target")


def _assembled(files: DataFrame, found: DataFrame, references: DataFrame, imports: DataFrame, chunks: DataFrame, links: DataFrame) -> Index:
    file_nodes = files.select(F.concat(F.lit("file:"), "file_path").alias("id"), F.element_at(F.split("file_path", "/"), -1).alias("name"), F.lit("file").alias("kind"), "file_path", F.concat_ws(" | ", "file_path", "language").alias("summary"))
    held = resolve.containment(files, "file_path")
    folders = held.select(F.col("dst").alias("id")).where("id LIKE 'dir:%'").distinct()
    folder_nodes = folders.select("id", F.element_at(F.split("id", "[:/]"), -1).alias("name"), F.lit("directory").alias("kind"), F.substring_index("id", ":", -1).alias("file_path"), F.col("id").alias("summary"))
    nodes = file_nodes.unionByName(folder_nodes).unionByName(found.select("id", "name", "kind", "file_path", "summary"))
    edges = held.withColumn("edge_type", F.lit("CONTAINS"))
    edges = edges.unionByName(found.select(F.concat(F.lit("file:"), "file_path").alias("src"), F.col("id").alias("dst"), F.lit("CONTAINS").alias("edge_type")))
    edges = edges.unionByName(imports.where("target IS NOT NULL").select(F.concat(F.lit("file:"), "file_path").alias("src"), F.concat(F.lit("file:"), "target").alias("dst"), F.lit("IMPORTS").alias("edge_type")))
    edges = edges.unionByName(references.where("target IS NOT NULL AND src <> target").select("src", F.col("target").alias("dst"), F.col("relation").alias("edge_type")))
    return Index(nodes, edges.distinct(), chunks, links.select("chunk_id", "id"), files.select("file_path", "language", "digest"), found, references, imports)


def _rows(files: DataFrame) -> DataFrame:
    return files.select("file_path", "language", F.coalesce("content", F.lit("")).alias("content")).withColumn("digest", F.sha2("content", 256))


def index_files(files: DataFrame, *, done: DataFrame | None = None, budget: int = 512) -> Index:
    """Indexes ``files`` (file_path, language, content).

    ``done`` (file_path, digest) are files that are passed over if their content hasn't changed;
    what links the others with them is left out, so to go on from an earlier index use
    ``reindexed``. Files that don't parse have a node and text chunks are not made of them.
    Symbols and chunks are written once and read by all that follows; edges are joins of ids
    and names.

    Edges: CONTAINS from folders to files and from files to symbols, IMPORTS between
    files, CALLS, EXTENDS and IMPLEMENTS where a name resolves to one symbol. Null contents are empty files.
    """
    rows = _rows(files)
    if done is not None:
        rows = rows.join(done.select("file_path", "digest"), ["file_path", "digest"], "left_anti")
    rows = written(rows.select("file_path", "language", "content", "digest"))
    new = _read(rows, budget)
    return _assembled(rows.drop("content"), new.symbols, written(_resolved(new.references, new.symbols)), written(_imported(new.imports, rows)), new.chunks, new.links)


def reindexed(old: Index, files: DataFrame, *, removed: DataFrame | None = None, budget: int = 512) -> Index:
    """``old`` after ``files`` (file_path, language, content) came or changed and ``removed`` (file_path) went.

    The same as ``index_files`` of all files as they are now. Files whose content is what it
    was are passed over, so a run that broke off can be made again whole. A file that is both
    changed and removed is removed.
    """
    given = _rows(files)
    gone = removed.select("file_path").distinct() if removed is not None else files.select("file_path").where("false")
    rows = written(given.join(gone, "file_path", "left_anti").join(old.files.select("file_path", "language", "digest"), ["file_path", "language", "digest"], "left_anti").select("file_path", "language", "content", "digest"))
    retracted = written(rows.select("file_path").unionByName(gone).distinct())
    new = _read(rows, budget)

    def kept(df: DataFrame) -> DataFrame:
        return df.join(retracted, "file_path", "left_anti")

    held = written(kept(old.files).unionByName(rows.select("file_path", "language", "digest")))
    found = written(kept(old.symbols).unionByName(new.symbols))
    # names that have gained or lost a symbol may mean another one now, or none
    moved = old.symbols.join(retracted, "file_path", "left_semi").select("name").unionByName(new.symbols.select("name")).select(F.col("name").alias("target_name")).distinct()
    moved = written(moved)
    references = kept(old.references)
    again = references.join(moved, "target_name", "left_semi").drop("target").unionByName(new.references)
    references = written(references.join(moved, "target_name", "left_anti").unionByName(_resolved(again, found)))

    # paths that came or went: imports that could mean one of them
    paths = written(old.files.select("file_path").exceptAll(held.select("file_path")).unionByName(held.select("file_path").exceptAll(old.files.select("file_path"))))
    imports = kept(old.imports)
    key = ["file_path", "module", "language"]
    touched = resolve.candidates(imports.select(F.col("file_path").alias("importer"), "module", "language")).join(paths, "file_path", "left_semi")
    touched = written(touched.select(F.col("importer").alias("file_path"), "module", "language").distinct())
    again = imports.join(touched, key, "left_semi").drop("target").unionByName(new.imports)
    imports = written(imports.join(touched, key, "left_anti").unionByName(_imported(again, held)))

    chunks = kept(old.chunks).unionByName(new.chunks)
    of_file = old.chunks.select("chunk_id", "file_path").distinct()
    links = kept(old.links.join(of_file, "chunk_id")).unionByName(new.links)
    return _assembled(held, found, references, imports, written(chunks), written(links))
