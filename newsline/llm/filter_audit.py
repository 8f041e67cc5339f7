"""How filters interact: what each of five filters removes in every order, kept up to date by a stream.

All files of a folder are read as micro-batches of one stream that ends when none is left; run again with the
same checkpoint it takes the files that came since. A document's mask says which filters it fails by itself (A to
D) and what ``labels`` says of it. E, identical to a smaller id's text, depends on rows that may come
later: a keyed state holds each text's smallest id with its masks, and when a smaller one
arrives the masks counted for the earlier holder are retracted and counted again with E. So the counters of (part,
mask) are right after every batch, and they, not the documents, give the audit of all 120 orders.

Before the state each task keeps only the smallest id of a text and counts the rest right away, so a text that a
third of the rows share reaches its key once a task. States are in RocksDB with their log in the checkpoint
folder; each batch's counters are a folder of its own, which a repeated batch replaces.

Words are maximal runs of anything but U+0020 and U+0009 to U+000D. Null texts are empty ones; a null source is
the part ''. Rows with a null doc_id are smaller than none, larger than none, and have no labels; rows that repeat
an id and its text are no copies of each other; several labels of one id count if any is 1. Further columns are
ignored, and an empty table has no part.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from newsline.llm.common import released
from newsline.plans.storage import remove, scratch, table

LETTERS = "ABCDE"
COPY, GOOD, TOXIC = 16, 32, 64
#: Micro-batches that a first run is cut into; labels are read once a batch.
BATCHES = 4
#: Keys that a task holds before it hands them on.
HELD = 1 << 16
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    # A stream that ends needs no store between batches; an open one holds some MB on its executor's disk.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}

_UPPER, _ODD, _INNER = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))


def mask(text: bytes) -> int:
    """The filters A to D that a UTF-8 text fails, as bits 1, 2, 4, 8."""
    words = text.split()  # of bytes: exactly at U+0020 and U+0009 to U+000D
    points = len(text.translate(None, _INNER))
    upper = len(text) - len(text.translate(None, _UPPER))
    bits = 1 * (len(words) < 50) | 2 * (100 * len(set(words)) < 65 * len(words))
    return bits | 4 * (100 * upper > 5 * points) | 8 * (len(text.translate(None, _ODD)) < len(text))


def _light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, label_key, part, key, bits, n): a document without its text; equal rows of a batch are one."""
    for batch in batches:
        ids, parts = batch.column("doc_id").to_pylist(), batch.column("source").to_pylist()
        rows: dict[tuple, int] = {}
        for i, part, text in zip(ids, parts, batch.column("text").cast(pa.binary())):
            data = text.as_py() or b""
            row = (i, part or "", hashlib.sha256(data).digest(), mask(data))
            rows[row] = rows.get(row, 0) + 1
        ids, parts, keys, bits = zip(*rows) if rows else ((), (), (), ())
        # Rows without id find no label; a name of their own keeps them from meeting in one task.
        names = [f"~{k.hex()}" if i is None else str(i) for i, k in zip(ids, keys)]
        columns = [pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(parts, pa.string()), pa.array(keys, pa.binary())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(bits, pa.int32()), pa.array(rows.values(), pa.int64())], ["doc_id", "label_key", "part", "key", "bits", "n"])


def _smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc_id, part, bits, n): the smallest ids of each text; rows with null doc_id are counts that no later row changes."""
    held: dict[bytes, tuple[int, dict]] = {}
    settled: dict[tuple, int] = {}

    def add(counts: dict, at: tuple, n: int) -> None:
        counts[at] = counts.get(at, 0) + n

    def flush() -> Iterator[pa.RecordBatch]:
        rows = [(k, i, p, b, n) for k, (i, own) in held.items() for (p, b), n in own.items()]
        rows += [(hashlib.sha256(f"{p}|{b}|{len(held)}".encode()).digest() + b"=", None, p, b, n) for (p, b), n in settled.items()]
        held.clear()
        settled.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.int64()))], ["key", "doc_id", "part", "bits", "n"])

    for batch in batches:
        for key, i, part, bits, n in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "part", "bits", "n"))):
            if i is None:
                add(settled, (part, bits), n)
                continue
            low, own = held.get(key, (i, None))
            if own is None or i < low:
                for (p, b), m in (own or {}).items():
                    add(settled, (p, b | COPY), m)
                held[key] = (i, {(part, bits): n})
            elif i == low:
                add(own, (part, bits), n)
            else:
                add(settled, (part, bits | COPY), n)
        if len(held) >= HELD:
            yield from flush()
    yield from flush()


class SmallestId(StatefulProcessor):
    """State of a text: its smallest id and the counts of (part, bits) of the rows with it. Gives changes (part, bits, n)."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("smallest", "doc_id bigint, counts string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        low, own, changed, out = None, {}, False, {}
        rows = list(rows)
        if rows[0].doc_id is not None and self.state.exists():
            low, packed = self.state.get()
            own = {(p, b): n for p, b, n in json.loads(packed)}

        def add(at: tuple, n: int) -> None:
            out[at] = out.get(at, 0) + n

        for r in rows:
            at = (r.part, r.bits)
            if r.doc_id is None:
                add(at, r.n)
            elif low is None or r.doc_id < low:
                for (p, b), n in own.items():  # the earlier holder was counted without E
                    add((p, b), -n)
                    add((p, b | COPY), n)
                low, own, changed = r.doc_id, {at: r.n}, True
                add(at, r.n)
            elif r.doc_id == low:
                own[at], changed = own.get(at, 0) + r.n, True
                add(at, r.n)
            else:
                add((r.part, r.bits | COPY), r.n)
        if changed:
            self.state.update((low, json.dumps([[p, b, n] for (p, b), n in own.items()])))
        for (p, b), n in out.items():
            if n:
                yield Row(part=p, bits=b, n=n)

    def close(self) -> None:
        pass


def audit_stream(docs: DataFrame, labels: DataFrame, counters: str, checkpoint: str) -> StreamingQuery:
    """Starts a stream that keeps (part, bits, n) changes below ``counters``, a folder a batch.

    ``docs``: a stream of (doc_id, text, source); ``labels``: (doc_id, quality, toxic), a table.
    """
    spark = docs.sparkSession
    one = lambda c, bit: F.max(F.when(F.col(c) == 1, bit).otherwise(0))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("label_key"))
    known = known.agg((one("quality", GOOD) + one("toxic", TOXIC)).alias("said"))
    light = docs.select("doc_id", "text", "source").mapInArrow(released(_light), "doc_id long, label_key string, part string, key binary, bits int, n long")
    told = light.join(known, "label_key", "left")
    bits = F.col("bits").bitwiseOR(F.coalesce("said", F.lit(0))).cast("int").alias("bits")
    small = told.select("key", "doc_id", "part", bits, "n").mapInArrow(_smallest, "key binary, doc_id long, part string, bits int, n long")
    changes = small.groupBy("key").transformWithState(SmallestId(), "part string, bits int, n bigint", "Update", "None")

    def land(batch: DataFrame, number: int) -> None:
        batch.groupBy("part", "bits").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{counters}/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        return changes.writeStream.foreachBatch(land).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def orders(spark: SparkSession) -> DataFrame:
    """(filter_order, step, filter, earlier): the 600 steps of all orders; earlier has the bits of the filters applied before."""
    rows = []
    for order in itertools.permutations(LETTERS):
        earlier = 0
        for step, letter in enumerate(order, 1):
            rows.append(("".join(order), step, letter, earlier))
            earlier |= 1 << LETTERS.index(letter)
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, earlier int")


def interactions(counts: DataFrame) -> DataFrame:
    """The audit of (part, bits, n): a row for each part, order and step.

    Of the earlier filters only their set matters, so 80 cases a part are counted and then looked up.
    """
    spark = counts.sparkSession
    has = lambda bit: F.col("bits").bitwiseAND(F.lit(bit)) != 0
    n = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    masks = counts.groupBy("part", F.col("bits").bitwiseAND(F.lit(31)).alias("m"))
    masks = masks.agg(F.sum("n").alias("n"), n(has(GOOD)).alias("good"), n(has(TOXIC)).alias("toxic"))
    case = F.explode(F.sequence(F.lit(0), F.lit(159)))
    cases = masks.select("*", case.alias("case")).select("*", F.expr("case div 32").cast("int").alias("i"), (F.col("case") % 32).alias("earlier"))
    own = F.expr("shiftleft(1, i)")
    cases = cases.select("*", own.alias("bit")).where("(earlier & bit) = 0")
    fails, before = F.col("m").bitwiseAND(F.col("bit")) != 0, F.col("m").bitwiseAND(F.col("earlier")) != 0
    letter = F.substring(F.lit(LETTERS), F.col("i") + 1, F.lit(1)).alias("filter")
    found = cases.groupBy("part", letter, "earlier").agg(
        n(~fails & ~before).alias("kept"), n(fails & ~before).alias("removed"), n(fails & before).alias("redundant"),
        n(F.col("m") == F.col("bit")).alias("unique_fails"),
        F.sum(F.when(fails & ~before, F.col("good")).otherwise(0)).alias("good_lost"),
        F.sum(F.when(fails & ~before, F.col("toxic")).otherwise(0)).alias("toxic_lost"),
    )
    steps = F.broadcast(orders(spark))  # 600 rows
    often = orders(spark).groupBy("filter", "earlier").agg(F.count("*").alias("times"))
    shares = found.join(F.broadcast(often), ["filter", "earlier"]).groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("times")).alias("shapley"))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return found.join(shares, ["part", "filter"]).join(steps, ["filter", "earlier"]).select("part", "filter_order", "step", *(F.col(c).cast("long").alias(c) for c in names))


def audit(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The audit of all files below ``path``, read in about so many micro-batches."""
    there = spark.read.parquet(path)
    files = there.inputFiles()
    stream = spark.readStream.schema(there.schema).option("maxFilesPerTrigger", max(1, -(-len(files) // batches)))
    folder, _, name = path.rstrip("/").rpartition("/")
    if len(files) == 1 and files[0].rpartition("/")[2] == name:  # a stream reads folders
        docs = stream.option("pathGlobFilter", name).parquet(folder)
    else:
        docs = stream.parquet(path)
    counters, checkpoint = scratch(spark, "audit_counters"), scratch(spark, "audit_stream")
    audit_stream(docs, labels, counters, checkpoint).awaitTermination()
    remove(spark, checkpoint)
    counts = spark.read.schema("part string, bits int, n long").option("recursiveFileLookup", "true").parquet(counters)
    return interactions(counts.groupBy("part", "bits").agg(F.sum("n").alias("n")).where("n != 0"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters over every document, in all orders."""
    return audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS low FROM d),
l AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT)
  + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
  + 16 * CAST(coalesce(w.doc_id > low, false) AS INT) AS m, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, m),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, b)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, unnest([1, 2, 3, 4, 5]) AS step, unnest([a.b, b.b, c.b, d.b, e.b]) AS bit,
  unnest([0, a.b, a.b + b.b, a.b + b.b + c.b, a.b + b.b + c.b + d.b]) AS earlier FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
r AS (SELECT part, filter_order, step, bit,
  coalesce(sum(n) FILTER (WHERE m & (earlier | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE m & bit > 0 AND m & earlier = 0), 0) AS removed,
  coalesce(sum(n) FILTER (WHERE m & bit > 0 AND m & earlier > 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE m = bit), 0) AS unique_fails,
  coalesce(sum(good) FILTER (WHERE m & bit > 0 AND m & earlier = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE m & bit > 0 AND m & earlier = 0), 0) AS toxic_lost
  FROM c, o GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""
