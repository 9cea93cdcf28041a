"""An inverted index of texts: postings by term, kept up to date by document.

Two stores: postings (term, document, count), dealt to buckets by a hash of the term and only ever appended to, and
documents with their generation. An update appends the postings of a new generation, then, in one step, makes that
generation known and marks the documents' earlier ones as gone; until then nothing of it is seen. A search reads the
buckets of its terms alone, and drops postings of documents that are marked. ``compact`` rewrites what is left.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.sources.store import Store
from weftgraph.sources.tables import dropped, written

#: Fixed value: one word of a text, after lower-casing.
TERM = "([a-z0-9_]+)"
#: So many documents' terms are counted at a time.
DOCUMENTS = 200
#: Parameters of the BM25 measure.
SATURATION, LENGTH_SHARE = 1.2, 0.75


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(1))


def counted_terms(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """key, length, term and n of each term of each row (key, length, words).

    A row is a whole document, so nothing has to be kept or met beyond it.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, DOCUMENTS):
            part = batch.slice(at, DOCUMENTS)
            words = part.column("words")
            terms = words.flatten().dictionary_encode()
            if not len(terms):
                continue
            row = np.repeat(np.arange(len(words)), pa.compute.list_value_length(words).to_numpy())
            held, n = np.unique(row * len(terms.dictionary) + terms.indices.to_numpy(), return_counts=True)
            row, term = (pa.array(x) for x in np.divmod(held, len(terms.dictionary)))
            columns = [part.column(key).take(row), part.column("length").take(row), terms.dictionary.take(term), pa.array(n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [key, "length", "term", "n"])


class TextIndex:
    """``TextIndex.create`` makes an empty one, ``TextIndex(spark, path)`` opens it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.postings, self.documents = Store(spark, f"{path}/postings"), Store(spark, f"{path}/documents")
        self.key = self.documents.key[0]

    @classmethod
    def create(cls, spark: SparkSession, path: str, key: str = "doc_id", kind: str = "bigint", buckets: int = 64) -> TextIndex:
        Store.create(spark, f"{path}/postings", f"part int, term string, `{key}` {kind}, generation bigint, n int, length int", ["part", "term", key, "generation"], buckets=buckets, by="part")
        Store.create(spark, f"{path}/documents", f"`{key}` {kind}, generation bigint, length int, alive boolean", [key, "generation"], buckets=buckets, notes={"generations": []})
        return cls(spark, path)

    def update(self, rows: DataFrame, text: str, *, removed: DataFrame | None = None) -> None:
        """Indexes ``rows`` (key, ``text``), in the place of what was there of these documents, and takes ``removed`` (key) away.

        A null text has no terms; of rows that repeat a key the one with the greatest text counts; null keys are left out.
        """
        generation = uuid.uuid4().int >> 65
        words = terms_of(F.coalesce(F.col(text), F.lit("")))
        one = rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max(text).alias(text))
        new = written(one.select(self.key, words.alias("words")).withColumn("length", F.size("words")))
        kind, key = new.schema[self.key].dataType.simpleString(), self.key
        counted = new.select(key, "length", "words").mapInArrow(lambda batches: counted_terms(batches, key), f"`{key}` {kind}, length int, term string, n int")
        self.postings.append(counted.withColumns({"generation": F.lit(generation), "part": self._part(F.col("term"))}))
        touched = new.select(self.key) if removed is None else new.select(self.key).unionByName(removed.select(self.key)).distinct()
        gone = self.documents.read().where("alive").join(touched, self.key, "left_semi").withColumn("alive", F.lit(False))
        fresh = new.select(self.key, F.lit(generation).alias("generation"), "length", F.lit(True).alias("alive"))
        marked = written(gone.unionByName(fresh))
        self.documents.upsert(marked, notes=lambda notes: notes | {"generations": [*notes["generations"], generation]})
        dropped(new, marked)

    def _part(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.postings.buckets)).cast("int")

    def _alive(self, terms: Sequence[str]) -> DataFrame:
        parts = [p for (p,) in self.spark.createDataFrame([(t,) for t in terms], "term string").select(self._part(F.col("term"))).distinct().collect()] if terms else []
        known = self.documents.version()
        rows = self.postings.read(buckets=parts).where(F.col("term").isin(*terms) & F.col("generation").isin(*known.notes["generations"]))
        gone = self.documents.read(known.number).where("NOT alive").select(self.key, "generation")
        return rows.join(gone, [self.key, "generation"], "left_anti")

    def search(self, terms: Sequence[str], *, measure: str = "tfidf") -> DataFrame:
        """key and score of the documents that have one of the terms.

        ``tfidf``: the sum of count * ln(1 + documents / documents with the term), which is
        ``retrieval.lexical_scores``; ``bm25`` saturates counts and weighs by length.
        """
        terms = sorted({t.lower() for t in terms})
        rows = self._alive(terms)
        having = rows.groupBy("term").agg(F.count(F.lit(1)).alias("having"))
        total = self.documents.read().where("alive").agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean"))
        both = rows.join(F.broadcast(having.join(total)), "term")  # a row for each term
        if measure == "bm25":
            weight = F.log(1 + (F.col("docs") - F.col("having") + 0.5) / (F.col("having") + 0.5))
            held = F.col("n") * (SATURATION + 1) / (F.col("n") + SATURATION * (1 - LENGTH_SHARE + LENGTH_SHARE * F.col("length") / F.col("mean")))
        else:
            weight, held = F.log(1 + F.col("docs") / F.col("having")), F.col("n")
        return both.groupBy(self.key).agg(F.sum(held * weight).alias("score"))

    def compact(self) -> None:
        """Rewrites the postings without those that are gone, then forgets the documents that are."""
        known = self.documents.version()
        rows = self.postings.read().where(F.col("generation").isin(*known.notes["generations"]))
        gone = self.documents.read(known.number).where("NOT alive").select(self.key, "generation")
        left = written(rows.join(gone, [self.key, "generation"], "left_anti"))
        self.postings.replace(left)
        self.documents.delete_where(~F.col("alive"))
        dropped(left)
