"""A table of immutable parts that writes land in: upserts, appends and deletions, each one atomic, with older versions.

Rows are dealt to a fixed number of buckets, by a hash of the key or by a column of the caller. A version is a
manifest, a small file that lists the parts of each bucket. A change writes new parts beside the old ones, and becomes
visible when its manifest is renamed to the next number, which fails if another writer was first; the change is then
made again on what that one wrote. Whatever breaks off before the rename leaves files that no version names.
A manifest also keeps the last batch of each stream, so a batch that comes again changes nothing.

The rename must fail if its target exists: HDFS and local folders do so; an object store needs a committer that does.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from .tables import dropped, written

BUCKET = "bucket_number"


class Conflict(RuntimeError):
    """Another writer was first, again and again."""


@dataclass(frozen=True)
class Version:
    number: int
    schema: StructType
    #: Of each bucket that has rows the folders of its parts.
    parts: dict[int, list[str]] = field(default_factory=dict)
    #: Of each stream the last batch that landed.
    batches: dict[str, int] = field(default_factory=dict)
    #: What the owner of the store keeps beside the rows.
    notes: dict = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"number": self.number, "schema": self.schema.json(), "parts": self.parts, "batches": self.batches, "notes": self.notes})

    @classmethod
    def of_text(cls, text: str) -> Version:
        found = json.loads(text)
        return cls(found["number"], StructType.fromJson(json.loads(found["schema"])), {int(k): v for k, v in found["parts"].items()}, found["batches"], found["notes"])


class Store:
    """``Store.create`` makes one, ``Store(spark, path)`` opens it.

    ``key`` names the columns that tell rows apart; ``by`` is a column that holds the bucket's
    number (from 0), else the hash of the key decides. Rows with a null in the key are rows of
    their own to ``append``, and equal ones are one row to ``upsert``.
    """

    def __init__(self, spark: SparkSession, path: str, tries: int = 5) -> None:
        self.spark, self.path, self.tries = spark, path.rstrip("/"), tries
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        how = json.loads(self._read_text("table.json"))
        self.key, self.buckets, self.by = how["key"], how["buckets"], how["by"]

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType | str, key: Sequence[str], *, buckets: int = 64, by: str | None = None, notes: dict | None = None) -> Store:
        """An empty table as version 0; an error if there is one already."""
        schema = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
        made = cls.__new__(cls)
        made.spark, made.path, made.tries, made._hadoop = spark, path.rstrip("/"), 5, spark._jvm.org.apache.hadoop.fs
        made.key, made.buckets, made.by = list(key), buckets, by
        if not made._put("table.json", json.dumps({"key": made.key, "buckets": buckets, "by": by})) or not made._commit(Version(0, schema, notes=notes or {})):
            raise FileExistsError(path)
        return made

    # files

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read_text(self, name: str) -> str:
        stream = self._files().open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> bool:
        """Writes a file under another name and renames it; False if there is one of this name."""
        draft = f"drafts/{uuid.uuid4().hex}"
        stream = self._files().create(self._path(draft))
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        target = self._path(name)
        self._files().mkdirs(target.getParent())
        rename = getattr(self._hadoop, "Options$Rename")
        how = self.spark._sc._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            self._hadoop.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(self._path(draft), target, how)
        except Py4JJavaError as why:
            if "FileAlreadyExistsException" in why.java_exception.getClass().getName():
                return False
            raise
        return True

    def _commit(self, version: Version) -> bool:
        return self._put(f"versions/{version.number:020d}.json", version.text())

    def versions(self) -> list[int]:
        return sorted(int(f.getPath().getName()[:20]) for f in self._files().listStatus(self._path("versions")))

    def version(self, number: int | None = None) -> Version:
        """The newest version, or that of a number."""
        number = self.versions()[-1] if number is None else number
        return Version.of_text(self._read_text(f"versions/{number:020d}.json"))

    # reading

    def read(self, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows of a version, of all buckets or of some; only the files of these are touched."""
        return self._rows(self.version(version), buckets).drop(BUCKET)

    def _rows(self, at: Version, buckets: Sequence[int] | None = None) -> DataFrame:
        wanted = at.parts if buckets is None else {b: at.parts[b] for b in buckets if b in at.parts}
        paths = [f"{self.path}/{p}" for parts in wanted.values() for p in parts]
        schema = StructType([*at.schema.fields]).add(BUCKET, IntegerType())
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    # writing

    def _bucket(self) -> Column:
        return (F.col(self.by) if self.by else F.pmod(F.xxhash64(*self.key), F.lit(self.buckets))).cast("int")

    def _written(self, rows: DataFrame, schema: StructType) -> dict[int, list[str]]:
        """Writes parts of rows that have their bucket; the folders by bucket."""
        folder = f"data/{uuid.uuid4().hex}"
        # small buckets share tasks, large ones are split
        rows = rows.select(*schema.names, BUCKET).hint("rebalance", BUCKET)
        rows.withColumn("at_bucket", F.col(BUCKET)).write.partitionBy("at_bucket").parquet(f"{self.path}/{folder}")
        made = self._files().listStatus(self._path(folder))
        return {int(name.split("=")[1]): [f"{folder}/{name}"] for name in (f.getPath().getName() for f in made) if name.startswith("at_bucket=")}

    def _change(self, make: Callable[[Version], tuple[dict[int, list[str]], dict] | None], batch: tuple[str, int] | None) -> int:
        """Commits what ``make`` gives on the newest version: parts of the buckets that change, and notes. The version's number."""
        for _ in range(self.tries):
            now = self.version()
            if batch and now.batches.get(batch[0], -1) >= batch[1]:
                return now.number
            made = make(now)
            if made is None:
                return now.number
            parts, notes = made
            kept = {b: p for b, p in (now.parts | parts).items() if p}
            batches = now.batches | ({batch[0]: batch[1]} if batch else {})
            if self._commit(Version(now.number + 1, now.schema, kept, batches, notes)):
                return now.number + 1
        raise Conflict(self.path)

    def _shaped(self, rows: DataFrame, schema: StructType) -> DataFrame:
        missing = [f for f in schema.fields if f.name not in rows.columns]
        rows = rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}) if missing else rows
        return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields)).withColumn(BUCKET, self._bucket())

    def append(self, rows: DataFrame, *, batch: tuple[str, int] | None = None, notes: dict | None = None) -> int:
        """Adds rows; nothing that is there is read or written again."""

        def make(now: Version):
            made = self._written(self._shaped(rows, now.schema), now.schema)
            return {b: [*now.parts.get(b, []), *p] for b, p in made.items()}, now.notes if notes is None else notes

        return self._change(make, batch)

    def _old(self, now: Version, keys: DataFrame, buckets: set[int]) -> tuple[DataFrame, set[int]]:
        """The rows of all buckets that have one of the keys, or are in ``buckets``, and the numbers of these buckets."""
        if self.by:  # an old row may be in any bucket: only the key's columns are read to find it
            found = self._rows(now).select(*self.key, BUCKET).join(keys, self._same(keys), "left_semi").select(BUCKET).distinct()
            buckets = buckets | {b for (b,) in found.collect()}
        return self._rows(now, sorted(buckets)), buckets

    def _same(self, keys: DataFrame) -> Column:
        out = F.lit(True)
        for k in self.key:
            out = out & F.col(k).eqNullSafe(keys[f"new_{k}"])
        return out

    def upsert(self, rows: DataFrame, *, batch: tuple[str, int] | None = None, order: Sequence[Column] = (), notes: Callable[[dict], dict] = dict) -> int:
        """Rows take the place of those with their key; of several new ones with one key the first in ``order``, then by all columns.

        Only buckets with a new row, or an old one of the same key, are written again. ``notes``
        makes the new notes from the old ones, in the same step.
        """
        now = self.version()
        if batch and now.batches.get(batch[0], -1) >= batch[1]:
            return now.number
        schema = now.schema
        place = F.row_number().over(Window.partitionBy(*self.key).orderBy(*order, F.to_json(F.struct(*schema.names))))
        # made once, whatever it takes: the rows are read for their buckets, for their keys and for the parts
        new = written(self._shaped(rows, schema).withColumn("place_in_key", place).where("place_in_key = 1").drop("place_in_key"))
        touched_by_new = {b for (b,) in new.select(BUCKET).distinct().collect()}  # as many as there are buckets at most
        keys = new.select(*(F.col(k).alias(f"new_{k}") for k in self.key))

        def make(now: Version):
            if not touched_by_new:
                return {}, notes(now.notes)
            old, touched = self._old(now, keys, touched_by_new)
            made = self._written(old.join(keys, self._same(keys), "left_anti").unionByName(new), now.schema)
            return {b: made.get(b, []) for b in touched}, notes(now.notes)

        try:
            return self._change(make, batch)
        finally:
            dropped(new)

    def delete(self, keys: DataFrame, *, batch: tuple[str, int] | None = None) -> int:
        """Takes away the rows with these keys."""

        def make(now: Version):
            gone = keys.select(*(F.col(k).cast(now.schema[k].dataType).alias(k) for k in self.key)).distinct()
            touched = set() if self.by else {b for (b,) in gone.select(self._bucket().alias("b")).distinct().collect()}
            gone = gone.select(*(F.col(k).alias(f"new_{k}") for k in self.key))
            old, touched = self._old(now, gone, touched)
            touched &= set(now.parts)
            if not touched:
                return None if batch is None else ({}, now.notes)
            made = self._written(old.join(gone, self._same(gone), "left_anti"), now.schema)
            return {b: made.get(b, []) for b in touched}, now.notes

        return self._change(make, batch)

    def delete_where(self, condition: Column) -> int:
        """Takes away the rows that fit; buckets without one stay as they are."""

        def make(now: Version):
            touched = {b for (b,) in self._rows(now).where(condition).select(BUCKET).distinct().collect()}
            if not touched:
                return None
            made = self._written(self._rows(now, sorted(touched)).where(~F.coalesce(condition, F.lit(False))), now.schema)
            return {b: made.get(b, []) for b in touched}, now.notes

        return self._change(make, None)

    def replace(self, rows: DataFrame, *, notes: dict | None = None) -> int:
        """All rows anew, in one version."""

        def make(now: Version):
            made = self._written(self._shaped(rows, now.schema), now.schema)
            return {b: [] for b in now.parts} | made, now.notes if notes is None else notes

        return self._change(make, None)

    def sink(self, stream: str, how: str = "upsert") -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: each batch lands once, however often it comes."""
        land = {"upsert": self.upsert, "append": self.append, "delete": self.delete}[how]

        def write(rows: DataFrame, batch: int) -> None:
            land(rows, batch=(stream, batch))

        return write

    def vacuum(self, keep: int = 1) -> int:
        """Deletes versions older than the last ``keep``, and all files that none of these names; how many parts went.

        Not to run beside a writer or a reader of an older version: parts that are just being written have no name yet.
        """
        numbers = self.versions()
        for number in numbers[:-keep]:
            self._files().delete(self._path(f"versions/{number:020d}.json"), False)
        named = {p for n in numbers[-keep:] for parts in self.version(n).parts.values() for p in parts}
        gone = 0
        files = self._files()
        for folder in files.listStatus(self._path("data")) if files.exists(self._path("data")) else ():
            for part in files.listStatus(folder.getPath()):
                name = f"data/{folder.getPath().getName()}/{part.getPath().getName()}"
                if part.isDirectory() and name not in named:
                    files.delete(part.getPath(), True)
                    gone += 1
        files.delete(self._path("drafts"), True)
        return gone
