"""Streams of landed articles and fetch results."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from newsline.functions.text import article_id
from newsline.plans.live import folders


def stream_ingest(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """First arrival of each (source_id, url) within the watermark of fetched_at."""
    keyed = stream.withColumn("id", article_id(F.col("source_id"), F.col("url"))).where("id is not null")
    return keyed.withColumn("fetched_at", F.col("fetched_at").cast("timestamp")).withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["id"])


#: Keys live in RocksDB on the executors' disks, their changes in the checkpoint; a store is open only while a batch runs.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """While it lasts, streams that start keep their state as STATE says."""
    before = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


#: Keys that a task holds before it hands them on.
HELD = 200_000


def _earliest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The earliest row of each id among a task's rows, over as many Arrow batches as HELD keys last."""
    first = lambda pdf: pdf.sort_values(["fetched_at", "url"], kind="stable").drop_duplicates("id")
    held, n = [], 0
    for pdf in batches:
        held.append(first(pdf))
        n += len(held[-1])
        if n >= HELD:
            whole = first(pd.concat(held))
            held, n = [whole], len(whole)
            if 2 * n >= HELD:  # mostly different keys
                yield whole
                held, n = [], 0
    if held:
        yield first(pd.concat(held))


class FirstArrival(StatefulProcessor):
    """Gives a key's earliest row of the first batch that has the key, and nothing from then on."""

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = min(rows, key=lambda r: (r.fetched_at is None, r.fetched_at, r.url))
        if not self.seen.exists():
            self.seen.update((True,))
            yield first

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((True,))

    def close(self) -> None:
        pass


def first_arrivals(stream: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """First arrival of each (source_id, url) over any horizon, with its id.

    A micro-batch looks up its own keys in the state and reads nothing else of the history. Rows
    without source or url are dropped, those without time come last. ``known``: (id) rows that count as arrived when the stream first starts.
    """
    keyed = stream.withColumn("id", article_id(F.col("source_id"), F.col("url"))).where("id is not null")
    small = keyed.mapInPandas(_earliest, keyed.schema)  # a URL that comes again and again reaches its key once a batch of rows
    start = known.select("id").distinct().groupBy("id") if known is not None else None
    return small.groupBy("id").transformWithState(FirstArrival(), keyed.schema, "Append", "None", initialState=start)


def ingest_into(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append first arrivals to a table over any horizon.

    A batch is written to a folder of its own number, so a batch that is run again replaces itself. With a new
    checkpoint what the table holds counts as arrived, and batches go on behind its last.
    """
    spark = stream.sparkSession
    there, begun = folders(spark, path), folders(spark, checkpoint)
    known, base = None, 0
    if begun:
        base = int(_base(spark, checkpoint))
    else:
        batches = [int(n.partition("=")[2]) for n in there if n.startswith("batch=")]
        known, base = spark.read.parquet(path) if batches else None, max(batches, default=-1) + 1
        spark.createDataFrame([(str(base),)], "base string").coalesce(1).write.text(f"{checkpoint}/newsline-base")

    def land(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={base + number}")

    with keyed_state(spark):
        return first_arrivals(stream, known).writeStream.foreachBatch(land).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _base(spark: SparkSession, checkpoint: str) -> str:
    return spark.read.text(f"{checkpoint}/newsline-base").first()[0]


def stream_source_health(stream: DataFrame, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """OK and failed fetches by source and window; rows later than the watermark are dropped."""
    ok = F.col("status") == "OK"
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", window), "source_id").agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed")).select(F.col("window.start").alias("start"), "source_id", "n_ok", "n_failed")
