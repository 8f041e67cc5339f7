"""Full-text search in a stored index (H7).

``TextIndex`` keeps, for every distinct word of every document, a row (token, id, length, positions) in Parquet folders
by a hash of the token, sorted by token and id. A query lists the folders of its words and Parquet's statistics of row
groups skip other tokens in them, so what it reads grows with its words' rows, not with the texts. Rows are cut into files by
ranges of (bucket, token, id): a word that every document has is written by as many tasks as its share asks for.

A batch is added as a segment of its own; earlier segments aren't rewritten. Documents of a batch that are there already
replace the older ones: their ids are written beside the segment, and older rows of these ids are void. The table of
documents (``KeyedTable``) names segments and totals in the manifest by which it publishes a batch, so a batch is seen
whole or not at all; folders of a failed attempt are named nowhere. ``compact`` rewrites all segments as one.

Words are those of ``token_index``: folded to lower case, cut at white space, in the order title, body. Rows
with a null id aren't indexed; a document without words counts in the totals only; of rows with one id in a batch that
with the largest (version, text) stays. A query without words finds nothing; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsline.functions.text import tokens, tr_lower
from newsline.plans.live import KeyedTable
from newsline.plans.storage import bounded_batches, partitions, remove, scratch

BUCKETS = 64
#: Saturation and length weights of the ranking.
K1, B = 1.2, 0.75
_ROWS = "token string, id string, length int, positions array<int>, _bucket int"


#: Documents whose words are ordered together.
_TOGETHER = 256


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, id, length, positions): a row for each distinct word of each of the rows (id, words), whose ids are unique."""
    for whole in batches:
        for begin in range(0, whole.num_rows, _TOGETHER):
            batch = whole.slice(begin, _TOGETHER)
            lengths = np.diff(batch.column("words").offsets.to_numpy())
            said = batch.column("words").flatten().dictionary_encode()
            code, starts = said.indices.to_numpy(), np.cumsum(lengths) - lengths
            doc = np.repeat(np.arange(batch.num_rows), lengths)
            key = doc * max(1, len(said.dictionary)) + code
            order = np.argsort(key, kind="stable")  # positions of a word stay in order
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            at = (np.arange(len(code)) - starts[doc])[order].astype(np.int32)
            positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(code)), pa.int32()), pa.array(at))
            of, word = doc[order][first], code[order][first]
            columns = [said.dictionary.take(pa.array(word)), batch.column("id").take(pa.array(of)), pa.array(lengths[of].astype(np.int32)), positions]
            yield pa.RecordBatch.from_arrays(columns, ["token", "id", "length", "positions"])


def query_words(query: str) -> list[str]:
    """The words of a query, folded like those of the texts, in order."""
    return query.replace("İ", "i").replace("I", "ı").lower().split()


class TextIndex:
    """An index of documents (id, title, body, version) below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.documents = KeyedTable(spark, f"{self.path}/documents")

    @classmethod
    def create(cls, articles: DataFrame, path: str, version: str = "published_at", buckets: int = BUCKETS) -> TextIndex:
        """A new index of ``articles``."""
        out = cls(articles.sparkSession, path)
        empty = articles.sparkSession.createDataFrame([], "id string, segment string, length int")
        KeyedTable.create(empty, f"{out.path}/documents", ["id"], "segment", buckets, notes={"segments": [], "replaced": [], "documents": 0, "words": 0, "buckets": buckets})
        out.add(articles, version)
        return out

    def add(self, articles: DataFrame, version: str = "published_at") -> int:
        """Index a batch; how many of its documents replaced older ones. Raises if another batch was published meanwhile."""
        m = self.documents.manifest()
        notes, segment = m["notes"], f"{m['number'] + 1:09d}-{uuid.uuid4().hex[:8]}"
        said = F.struct(F.col(version).alias("v"), F.concat_ws(" ", "title", "body").alias("text"))
        last = articles.where("id IS NOT NULL").groupBy(F.col("id").cast("string").alias("id")).agg(F.max(said).getField("text").alias("text"))
        path = scratch(self.spark, "words")
        last.select("id", tokens(tr_lower("text")).alias("words")).write.parquet(path)
        words = self.spark.read.schema("id string, words array<string>").parquet(path)
        batch = words.select("id", F.lit(segment).alias("segment"), F.size("words").alias("length"))
        self.documents.lookup(batch).select("id", "length").write.parquet(f"{self.path}/replaced/{segment}")
        old = self.spark.read.schema("id string, length int").parquet(f"{self.path}/replaced/{segment}")
        count = lambda df: df.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        (new_n, new_words), (old_n, old_words) = count(batch), count(old)
        if not new_n:
            return 0
        with bounded_batches(self.spark):  # words of a text are put together where it is: only finished rows move
            self._write(words.mapInArrow(_postings, "token string, id string, length int, positions array<int>"), segment, notes["buckets"])
        notes |= {
            "segments": [*notes["segments"], segment], "replaced": [*notes["replaced"], *([segment] if old_n else [])],
            "documents": notes["documents"] + new_n - old_n, "words": notes["words"] + new_words - old_words,
        }
        self.documents.upsert(batch, notes, m["number"])
        remove(self.spark, path)
        return old_n

    def _write(self, rows: DataFrame, segment: str, buckets: int) -> None:
        placed = rows.select("token", "id", "length", "positions", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int").alias("_bucket"))
        placed = placed.repartitionByRange(partitions(self.spark), "_bucket", "token", "id").sortWithinPartitions("_bucket", "token", "id")
        placed.write.partitionBy("_bucket").parquet(f"{self.path}/segments/{segment}")

    def _live(self, notes: dict, words: list[str] | None = None) -> DataFrame:
        """Rows of the words (all, if none are given) whose documents weren't replaced later."""
        parts = []
        for segment in notes["segments"]:
            rows = self.spark.read.schema(_ROWS).parquet(f"{self.path}/segments/{segment}")
            parts.append(rows.withColumn("segment", F.lit(segment)))
        if not parts:
            return self.spark.createDataFrame([], f"{_ROWS}, segment string")
        rows = reduce(DataFrame.union, parts)
        if words is not None:
            asked = self.spark.range(1).select(F.explode(F.array(*map(F.lit, sorted(set(words))))).alias("w"))
            own = [r[0] for r in asked.select(F.pmod(F.xxhash64("w"), F.lit(notes["buckets"])).cast("int")).distinct().collect()]  # a row a word
            rows = rows.where(F.col("_bucket").isin(own) & F.col("token").isin(sorted(set(words))))
        if not notes["replaced"]:
            return rows
        void = reduce(DataFrame.union, [self.spark.read.schema("id string").parquet(f"{self.path}/replaced/{s}").withColumn("at", F.lit(s)) for s in notes["replaced"]])
        void = void.groupBy("id").agg(F.max("at").alias("at"))
        return rows.join(void.select(F.col("id").alias("_id"), "at"), (F.col("id") == F.col("_id")) & (F.col("segment") < F.col("at")), "left_anti")

    def _notes(self) -> dict:
        return self.documents.manifest()["notes"]

    def holding(self, query: str) -> DataFrame:
        """(id) of the documents that hold every word."""
        words = set(query_words(query))
        if not words:
            return self.spark.createDataFrame([], "id string")
        return self._live(self._notes(), list(words)).groupBy("id").count().where(F.col("count") == len(words)).select("id")

    def phrase(self, query: str) -> DataFrame:
        """(id, n_hits) of the documents that hold the words one after the other, and at how many places."""
        words = query_words(query)
        if not words:
            return self.spark.createDataFrame([], "id string, n_hits long")
        rows = self._live(self._notes(), words)
        places = F.create_map(*[x for w in set(words) for x in (F.lit(w), F.array(*[F.lit(i) for i, v in enumerate(words) if v == w]))])
        starts = rows.select("id", "positions", F.explode(places[F.col("token")]).alias("place")).select("id", F.explode("positions").alias("at"), "place")
        whole = starts.groupBy("id", (F.col("at") - F.col("place")).alias("start")).count().where(F.col("count") == len(words))
        return whole.groupBy("id").agg(F.count("*").alias("n_hits"))

    def ranked(self, query: str, k: int | None = None) -> DataFrame:
        """(id, score) of the documents that hold any of the words, by BM25; the first ``k`` by (score, id), all without ``k``."""
        words, notes = sorted(set(query_words(query))), self._notes()
        if not words or not notes["words"]:
            return self.spark.createDataFrame([], "id string, score double")
        rows = self._live(notes, words).select("id", "token", "length", F.size("positions").alias("tf"))
        n, mean = notes["documents"], notes["words"] / notes["documents"]
        have = rows.groupBy("token").agg(F.count("*").alias("df"))  # a row a word of the query
        rarity = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        share = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
        scored = rows.join(F.broadcast(have), "token").groupBy("id").agg(F.sum(rarity * share).alias("score"))
        return scored if k is None else scored.orderBy(F.desc("score"), "id").limit(k)

    def compact(self) -> None:
        """All live rows as one segment; older ones stay for readers of earlier manifests."""
        m = self.documents.manifest()
        segment = f"{m['number'] + 1:09d}-{uuid.uuid4().hex[:8]}"
        self._write(self._live(m["notes"]), segment, m["notes"]["buckets"])
        self.documents.note(m["notes"] | {"segments": [segment], "replaced": []}, m["number"])
