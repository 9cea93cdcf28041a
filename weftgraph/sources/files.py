"""Source files from a folder: filters, text, language."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import scalars

#: What is left out beside a folder's own ignore patterns.
EXCLUDED = ("**/node_modules/**", "node_modules/**", "**/dist/**", "dist/**", "**/*.min.js", "**/.venv/**", ".venv/**")


def decoded(content: Column) -> Column:
    """UTF-8 where the bytes are valid, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def read_folder(spark: SparkSession, folder: str, ignore: Sequence[str] = (), extensions: Sequence[str] = scalars.INDEXED, largest: int = scalars.LARGEST) -> DataFrame:
    """file_path (relative), language and content of the files below ``folder`` that are indexed.

    The size filter reaches the file listing, so large files are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.col("length") <= largest)
    root = "/" + folder.split(":", 1)[-1].strip("/") + "/"
    path = F.substring_index(F.col("path"), root, -1)
    rows = files.select(path.alias("file_path"), "content")
    path = F.col("file_path")
    keep = scalars.extension(path).isin(*extensions) & ~scalars.hidden(path) & ~scalars.ignored(path, [*EXCLUDED, *ignore])
    text = decoded(F.col("content"))
    return rows.where(keep).select("file_path", scalars.language(path, F.substring(text, 1, 200)).alias("language"), text.alias("content"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """file_path and change between two snapshots (file_path, content), by content hash."""
    from weftgraph.operators.state import snapshot_diff

    hashed = [df.select("file_path", F.sha2(F.col("content").cast("binary"), 256).alias("digest")) for df in (before, after)]
    return snapshot_diff(*hashed, "file_path", "digest")
