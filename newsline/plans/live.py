"""Tables that are changed in place: merged by key, or cut by date.

``KeyedTable`` keeps its rows in buckets by a hash of the key. A merge reads and rewrites only the buckets that the
batch touches, as new folders; a manifest names the folder of each bucket. A merge becomes visible when its manifest
is renamed into place, which fails if another one was faster, so readers see all of a merge or nothing, and a
reader of an older manifest keeps its files until ``vacuum``. What is written grows with the batch: at most the
buckets that its keys fall into.

Dated tables are folders of one day each; retention drops folders and rewrites nothing.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsline.plans.storage import materialize, partitions, remove


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it isn't there."""
    fs, where = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def _read_text(spark: SparkSession, path: str) -> str:
    fs, where = _fs(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, text: str) -> None:
    """Write a file that isn't there yet, whole or not at all; raises if it is there."""
    fs, _ = _fs(spark, path)
    draft = f"{path}.{uuid.uuid4().hex}"
    _, place = _fs(spark, draft)
    stream = fs.create(place, False)
    stream.write(bytearray(text, "utf-8"))
    stream.close()
    jvm = spark._jvm
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration()).rename(place, _fs(spark, path)[1], how)
    except Exception:
        fs.delete(place, False)
        raise


class KeyedTable:
    """A table with one row a key below ``path`` (A3)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, df: DataFrame, path: str, keys: list[str], version: str, buckets: int = 256, notes: dict | None = None) -> KeyedTable:
        """A new table of ``df``; of rows with one key that with the largest version. ``buckets`` never changes later; ``notes`` are kept in the manifest."""
        out = cls(df.sparkSession, path)
        first = {"keys": keys, "order": version, "buckets": buckets, "schema": df.schema.jsonValue(), "number": 0, "folders": {}, "notes": notes or {}}
        out._write(first, out._newest(out._placed(df.withColumn("_new", F.lit(1)), first), first))
        return out

    def manifest(self) -> dict:
        """The newest one."""
        numbers = [int(n) for n in folders(self.spark, f"{self.path}/manifests") if n.isdigit()]
        if not numbers:
            raise FileNotFoundError(f"no table at {self.path}")
        return json.loads(_read_text(self.spark, f"{self.path}/manifests/{max(numbers)}"))

    def _rows(self, m: dict, buckets: list[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(m["schema"])
        some = [f"{self.path}/data/{d}" for b, d in m["folders"].items() if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*some) if some else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """All rows, as of now."""
        return self._rows(self.manifest())

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of these keys, from their buckets alone."""
        m = self.manifest()
        asked = self._placed(keys.select(*m["keys"]).distinct(), m)
        return self._rows(m, self._touched(asked)).join(asked.drop("_bucket"), m["keys"], "left_semi")

    def _placed(self, df: DataFrame, m: dict) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(*m["keys"]), F.lit(m["buckets"])).cast("int"))

    @staticmethod
    def _touched(placed: DataFrame) -> list[str]:
        return [str(r[0]) for r in placed.select("_bucket").distinct().collect()]  # at most the number of buckets

    @staticmethod
    def _newest(rows: DataFrame, m: dict) -> DataFrame:
        best = Window.partitionBy("_bucket", *m["keys"]).orderBy(F.col("_new").desc(), F.col(m["order"]).desc_nulls_last())
        return rows.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank", "_new")

    def _write(self, m: dict, rows: DataFrame) -> None:
        name = f"v{m['number']}-{uuid.uuid4().hex[:8]}"
        n = min(partitions(self.spark), m["buckets"])
        rows.repartition(n, "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{name}")
        new = {d.partition("=")[2]: f"{name}/{d}" for d in folders(self.spark, f"{self.path}/data/{name}") if d.startswith("_bucket=")}
        _publish(self.spark, f"{self.path}/manifests/{m['number']}", json.dumps(m | {"folders": m["folders"] | new}))

    def _next(self, notes: dict | None, number: int | None) -> dict:
        m = self.manifest()
        if number is not None and m["number"] != number:
            raise RuntimeError(f"version {m['number']} of {self.path} was published after {number}")
        return m | {"number": m["number"] + 1} | ({} if notes is None else {"notes": notes})

    def note(self, notes: dict, number: int | None = None) -> None:
        """Publish other notes with the same rows; raises if the newest version isn't ``number`` any more."""
        m = self._next(notes, number)
        _publish(self.spark, f"{self.path}/manifests/{m['number']}", json.dumps(m))

    def upsert(self, updates: DataFrame, notes: dict | None = None, number: int | None = None) -> list[str]:
        """Merge a batch: its rows win over what is there, and of rows with one key that with the largest version. Returns the buckets rewritten.

        Raises if another merge was published meanwhile, or the newest version isn't ``number`` (if given); the table is then as that one left it.
        ``notes`` replace those in the manifest.
        """
        m = self._next(notes, number)
        schema = StructType.fromJson(m["schema"])
        batch = self._placed(updates.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema)), m)
        batch = materialize(self._newest(batch.withColumn("_new", F.lit(1)), m), "batch")
        touched = self._touched(batch)
        if touched:
            there = self._placed(self._rows(m, touched), m).withColumn("_new", F.lit(0))
            self._write(m, self._newest(there.unionByName(batch.withColumn("_new", F.lit(1))), m))
        return touched

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove the folders that none of the last ``keep`` manifests names, and older manifests."""
        numbers = sorted(int(n) for n in folders(self.spark, f"{self.path}/manifests") if n.isdigit())
        kept = [json.loads(_read_text(self.spark, f"{self.path}/manifests/{n}")) for n in numbers[-keep:]]
        named, gone = {d for m in kept for d in m["folders"].values()}, []
        for version in folders(self.spark, f"{self.path}/data"):
            for bucket in folders(self.spark, f"{self.path}/data/{version}"):
                if bucket.startswith("_bucket=") and f"{version}/{bucket}" not in named:
                    remove(self.spark, f"{self.path}/data/{version}/{bucket}")
                    gone.append(f"{version}/{bucket}")
        for n in numbers[:-keep]:
            remove(self.spark, f"{self.path}/manifests/{n}")
        return gone


def write_dated(df: DataFrame, path: str, at: str, mode: str = "append") -> None:
    """Write rows as a folder a day of ``at``, column day; rows without time go to a folder of their own."""
    df.withColumn("day", F.to_date(at)).write.mode(mode).partitionBy("day").parquet(path)


def drop_days(spark: SparkSession, path: str, before: dt.date) -> list[str]:
    """Drop the folders of the days before a date; the days dropped. Kept folders aren't touched, nor is that of rows without time."""
    days = [name.partition("=")[2] for name in folders(spark, path) if name.startswith("day=")]
    old = [d for d in days if d[:4].isdigit() and dt.date.fromisoformat(d) < before]
    for d in old:
        remove(spark, f"{path}/day={d}")
    return old
