"""Tables that are merged by key or cut by date, and streams that know every key they have seen."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from newsline.operators import ledger
from newsline.plans import live
from newsline.streaming.ingest import ingest_into

SCHEMA = "k string, g int, v int, note string, _bucket2 int"


def frame(spark, rows):
    return spark.createDataFrame([(k, g, v, n, 0) for k, g, v, n in rows], SCHEMA)


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def got(table):
    return sorted((str(r.k), r.g, r.v, r.note) for r in table.read().collect())


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(f"k{i}", i % 3, i, "old") for i in range(900)] + [("k1", 1, 5000, "newer"), (None, 0, 1, "null key")]
    table = live.KeyedTable.create(frame(spark, rows), path, ["k", "g"], "v", buckets=64)
    assert ("k1", 1, 5000, "newer") in got(table) and len(got(table)) == 901
    before = files(path)
    held = table.read()  # a reader of the first manifest
    touched = table.upsert(frame(spark, [("k7", 1, 0, "update wins"), ("k7", 1, -1, "older of the batch"), ("new", 0, 1, "added"), (None, 0, 2, "null key again")]))
    assert 1 <= len(touched) <= 3
    after = files(path)
    assert before.items() <= after.items() and sum(os.path.getsize(f) for f in after.keys() - before.keys()) < 0.2 * sum(os.path.getsize(f) for f in before)
    want = {(str(k), g, v, n) for k, g, v, n in rows if (k, g) not in {("k7", 1), (None, 0)} and (k, v) != ("k1", 1)} | {("k7", 1, 0, "update wins"), ("new", 0, 1, "added"), ("None", 0, 2, "null key again")}
    assert set(got(table)) == want and len(got(live.KeyedTable(spark, path))) == 902
    assert held.count() == 901  # still whole
    gone = table.vacuum()
    assert 0 < len(gone) <= len(touched) and set(got(table)) == want  # a bucket that was empty had no folder
    assert table.upsert(frame(spark, [])) == [] and set(got(table)) == want
    keys = spark.createDataFrame([("k7", 1), ("absent", 0)], "k string, g int")
    assert [r.note for r in table.lookup(keys).collect()] == ["update wins"]


def test_slower_merge_raises(spark, tmp_path, monkeypatch):
    """A merge that another one overtook changes nothing."""
    table = live.KeyedTable.create(frame(spark, [("a", 1, 1, "x")]), str(tmp_path / "t"), ["k", "g"], "v", buckets=4)
    old = table.manifest()
    table.upsert(frame(spark, [("a", 1, 2, "first")]))
    monkeypatch.setattr(live.KeyedTable, "manifest", lambda self: old)
    with pytest.raises(Exception, match="(?i)exist"):
        table.upsert(frame(spark, [("a", 1, 3, "second")]))
    monkeypatch.undo()
    assert got(table) == [("a", 1, 2, "first")]


def test_empty_table(spark, tmp_path):
    table = live.KeyedTable.create(frame(spark, []), str(tmp_path / "t"), ["k"], "v")
    assert got(table) == []
    table.upsert(frame(spark, [("a", 1, 1, "x")]))
    assert got(table) == [("a", 1, 1, "x")]


def test_retention_drops_folders(spark, tmp_path):
    path = str(tmp_path / "dated")
    start = dt.datetime(2024, 1, 1, 12)
    rows = [(i, start + dt.timedelta(days=i)) for i in range(10)] + [(99, None)]
    live.write_dated(spark.createDataFrame(rows, "id int, fetched_at timestamp"), path, "fetched_at")
    before = files(path)
    now = dt.datetime(2024, 1, 4) + dt.timedelta(days=90)
    assert ledger.expire_days(spark, path, "raw_articles", now) == ["2024-01-01", "2024-01-02", "2024-01-03"]
    assert {r.id for r in spark.read.parquet(path).collect()} == {3, 4, 5, 6, 7, 8, 9, 99}
    assert files(path).items() <= before.items()
    assert ledger.expire_days(spark, path, "raw_articles", now) == [] and ledger.expire_days(spark, path, "clusters", now) == []


def test_stream_over_any_horizon_and_restarts(spark, tmp_path):
    """A key seen once never returns: in later batches, after a restart, and with a new checkpoint over the same table."""
    kind = "source_id string, url string, fetched_at timestamp, note string"
    t0 = dt.datetime(2024, 1, 1)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def put(rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)

    def run(checkpoint):
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
        ingest_into(stream, out, str(tmp_path / checkpoint)).awaitTermination(200)
        return sorted((r.url, r.note) for r in spark.read.parquet(out).collect())

    put([("s", "u1", t0 + dt.timedelta(hours=2), "late"), ("s", "u1", t0, "first"), ("s", "u1", None, "no time"), ("s", "u2", None, "only"), (None, "u9", t0, "no source")])
    put([("s", "u1", t0 - dt.timedelta(days=900), "earlier, but a later batch"), ("s", "u3", t0, "third")])
    want = [("u1", "first"), ("u2", "only"), ("u3", "third")]
    assert run("c") == want
    put([("s", "u2", t0, "again"), ("s", "u4", t0, "fourth")])
    want.append(("u4", "fourth"))
    assert run("c") == want
    assert run("other") == want  # all files once more
    put([("s", "u3", t0, "again"), ("s", "u5", t0, "fifth")])
    assert run("other") == [*want, ("u5", "fifth")]
    assert spark.read.parquet(out).groupBy("id").count().where(F.col("count") > 1).count() == 0
