"""Names to symbols, modules to files, and the containment of files in directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a relative JavaScript or TypeScript import may stand for, in this order.
SCRIPT_ENDINGS = (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
PYTHON_ENDINGS = (".py", "/__init__.py")


def prefixes(path: Column) -> Column:
    """All ancestor directories of a path, shortest first; none for a file at the root."""
    segments = F.split(path, "/")
    n = F.size(segments) - 1
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(segments, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def containment(files: DataFrame, path: str) -> DataFrame:
    """src, dst of the edges repo to directory, directory to directory, and directory to file."""
    paths = files.where(F.col(path).isNotNull()).select(F.col(path).alias("path")).distinct()

    def above(node: Column) -> Column:
        return F.when(node.contains("/"), F.concat(F.lit("dir:"), F.regexp_replace(node, "/[^/]*$", ""))).otherwise("repo")

    folders = paths.select(F.explode(prefixes(F.col("path"))).alias("folder")).distinct()
    return folders.select(above(F.col("folder")).alias("src"), F.concat(F.lit("dir:"), "folder").alias("dst")).unionByName(paths.select(above(F.col("path")).alias("src"), F.concat(F.lit("file:"), "path").alias("dst")))


def unique_names(symbols: DataFrame, name: str = "name", symbol_id: str = "id") -> DataFrame:
    """name, target: names that exactly one symbol has; ambiguous ones resolve to nothing."""
    return symbols.groupBy(F.col(name).alias("name")).agg(F.count_distinct(symbol_id).alias("n"), F.min(symbol_id).alias("target")).where("n = 1").select("name", "target")


def normalised(path: Column) -> Column:
    """The path without empty, ``.`` and ``..`` segments; ``..`` at the root is dropped."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    start = F.array().cast("array<string>")
    step = F.aggregate(parts, start, lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))))
    return F.array_join(step, "/")


def candidates(imports: DataFrame) -> DataFrame:
    """``imports`` (importer, module, language) with each file_path that a module may mean, and its rank.

    Python modules are dotted, with leading dots relative to the importer; in scripts only
    ``./`` and ``../`` mean files.
    """
    importer, module = F.col("importer"), F.col("module")
    folder = F.when(importer.contains("/"), F.regexp_replace(importer, "/[^/]*$", "")).otherwise("")
    dots = F.length(F.regexp_extract(module, r"^\.*", 0))
    ups = F.when(dots > 1, F.repeat(F.lit("../"), dots - 1)).otherwise("")
    named = F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/"))
    python = F.when(dots > 0, F.concat(folder, F.lit("/"), ups, named)).otherwise(named)
    script = F.when(module.startswith("."), F.concat(folder, F.lit("/"), module))
    is_python = F.col("language") == "python"
    base = normalised(F.when(is_python, python).otherwise(script))
    endings = F.when(is_python, F.array(*map(F.lit, PYTHON_ENDINGS))).otherwise(F.array(*map(F.lit, ("", *SCRIPT_ENDINGS))))
    rows = imports.withColumn("base", base).withColumn("ending", endings)
    tried = rows.where("base IS NOT NULL").select("importer", "module", "language", F.posexplode("ending").alias("rank", "ending"), "base")
    return tried.withColumn("file_path", F.concat("base", "ending"))


def resolve_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` (importer, module, language) with target and is_external.

    Of several files that a module may mean the first ending wins; what is not found is external.
    """
    found = candidates(imports).join(files.select("file_path").distinct(), "file_path")
    best = found.groupBy("importer", "module", "language").agg(F.min_by("file_path", "rank").alias("target"))
    return imports.join(best, ["importer", "module", "language"], "left").withColumn("is_external", F.col("target").isNull())


def resolve_targets(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """``references`` (src, target_id, target_name, target_file) with target and outcome.

    In this order: an id that is known, a name that is unique in the module's file, a name
    that is unique at all; else ``external`` if the file is unknown, ``unresolved`` otherwise.
    """
    known = symbols.select(F.col("id").alias("target_id"), F.col("id").alias("by_id")).distinct()
    in_file = symbols.groupBy(F.col("file_path").alias("target_file"), F.col("name").alias("target_name")).agg(F.count_distinct("id").alias("n"), F.min("id").alias("by_file")).where("n = 1").drop("n")
    anywhere = unique_names(symbols).select(F.col("name").alias("target_name"), F.col("target").alias("by_name"))
    out = references.join(known, "target_id", "left").join(in_file, ["target_file", "target_name"], "left").join(anywhere, "target_name", "left")
    target = F.coalesce("by_id", "by_file", "by_name")
    outcome = F.when(target.isNotNull(), "created").when(F.col("target_file").isNull(), "external").otherwise("unresolved")
    return out.withColumn("target", target).withColumn("outcome", outcome).drop("by_id", "by_file", "by_name")
