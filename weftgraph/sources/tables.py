"""Input tables, and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Shuffle files of a finished write are of no use: what it wrote cuts the lineage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_fallback: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local master, as in tests, may leave that unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _fallback:
        _fallback[application] = tempfile.mkdtemp(prefix="weftgraph-")
    return _fallback[application]


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, with no lineage behind it; ``dropped`` deletes it."""
    spark = df.sparkSession
    path = fresh_path(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Deletes tables that ``written`` made and nothing reads any more; others and None are left alone."""
    for df in tables:
        if path := getattr(df, "written_path", None):
            _delete(df.sparkSession, path)


def fresh_path(spark: SparkSession) -> str:
    """A name in the shared folder that nothing has; ``forget`` deletes what is there."""
    return f"{_own_tables(spark)}/{uuid.uuid4().hex}"


def _own_tables(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def forget(spark: SparkSession) -> None:
    """Deletes the tables that ``written`` left for this application; results that read them are gone too."""
    _delete(spark, _own_tables(spark))
