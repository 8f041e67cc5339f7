import gzip
import hashlib

import pytest

from newsline.llm import warc
from newsline.plans.storage import scratch

BIG = "é" * 600
ROWS = [(1, "http://a b/\n", BIG), (5, None, BIG), (3, "u", BIG), (4, "v", None), (6, "w", "small"), (7, "w", "small"), (8, "x", "y\r\n\r\nWARC/1.1\r\n" * 900)]
SCHEMA = "page_id long, url string, html string, record_type int"


def rows_of(df):
    return sorted([tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.collect()], key=str)


def test_query(spark, write):
    folder = write("pages", [(*r, 0) for r in ROWS], SCHEMA)
    got = {r.page_id: r for r in warc.op1_warc(spark, folder).collect()}
    assert len(got) == len(ROWS)
    for i, _, html in ROWS:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert {i: r.refers_to for i, r in got.items()} == {1: 5, 5: None, 3: 5, 4: None, 6: None, 7: None, 8: None}
    assert {i for i, r in got.items() if r.record_type == "revisit"} == {1, 3}


def test_empty(spark, write):
    assert warc.op1_warc(spark, write("pages", [], SCHEMA)).count() == 0


def test_both_forms_and_filters(spark):
    warc.register(spark)
    made = warc.with_revisits(spark.createDataFrame([(*r, 0) for r in ROWS], SCHEMA))
    paths = {}
    for form in ("true", "false"):
        paths[form] = scratch(spark, "warc")
        made.write.format("warc").mode("append").option("gzip", form).save(paths[form])
    packed, plain = (spark.read.format("warc").load(paths[x]) for x in ("true", "false"))
    assert rows_of(packed) == rows_of(plain)
    for df in (packed, plain):
        assert {r.record_id for r in df.where("record_type = 'revisit' and target_uri like 'h%'").collect()} == {"urn:page:1"}
        assert df.where("record_id in ('urn:page:8', 'urn:page:3')").count() == 2
        assert "EqualTo" not in df.where("record_type = 'x'")._jdf.queryExecution().toString()
    light = spark.read.format("warc").option("payload", "false").load(paths["false"])
    assert [(r.payload, r.payload_bytes) for r in light.where("target_uri = 'x'").collect()] == [(None, len(ROWS[-1][2]))]
    spark.read.format("warc").load(scratch(spark, "none"))  # a folder that isn't there


def test_foreign_members_and_lost_files(spark, tmp_path):
    warc.register(spark)
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:a>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record.replace(b"urn:a", b"urn:b")))
    got = spark.read.format("warc").load(str(tmp_path)).collect()
    assert [(r.record_id, bytes(r.payload)) for r in got] == [("urn:a", b"abc"), ("urn:b", b"abc")]
    (tmp_path / "_committed-1").write_text('{"files": [], "replaces": []}')
    assert spark.read.format("warc").load(str(tmp_path)).count() == 0


def test_appends_and_overwrites(spark):
    """Every write's records are read; overwriting leaves only its own."""
    warc.register(spark)
    path = scratch(spark, "warc")
    one = lambda i: warc.with_revisits(spark.createDataFrame([(i, "u", f"page {i}", 0)], SCHEMA))
    read = lambda: sorted(r.record_id for r in spark.read.format("warc").load(path).collect())
    one(1).write.format("warc").mode("append").save(path)
    one(2).write.format("warc").mode("append").save(path)
    assert read() == ["urn:page:1", "urn:page:2"]
    one(3).write.format("warc").mode("overwrite").save(path)
    assert read() == ["urn:page:3"]
    one(4).write.format("warc").mode("append").save(path)
    assert read() == ["urn:page:3", "urn:page:4"]


def test_files_roll(spark, tmp_path):
    warc.register(spark)
    path = f"{tmp_path}/rolled"
    rows = warc.with_revisits(spark.createDataFrame([(i, "u", f"page {i}" * 50, 0) for i in range(40)], SCHEMA)).coalesce(1)
    rows.write.format("warc").mode("append").option("fileBytes", "500").save(path)
    assert len(list((tmp_path / "rolled").glob("*.warc.gz"))) > 5 and spark.read.format("warc").load(path).count() == 40


@pytest.mark.parametrize("form", ["true", "false"])
def test_long_http_headers_and_cut_off_records(spark, tmp_path, form):
    warc.register(spark)
    http = b"HTTP/1.1 200 OK\r\nX-Long: " + b"x" * 50_000 + b"\r\n\r\n" + b"p" * 20_000
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:a>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(http), http)
    name, data = ("x.warc.gz", gzip.compress(record)) if form == "true" else ("x.warc", record)
    (tmp_path / name).write_bytes(data + data)
    for payload in ("true", "false"):
        got = spark.read.format("warc").option("payload", payload).load(str(tmp_path)).collect()
        assert [r.payload_bytes for r in got] == [20_000] * 2
    (tmp_path / name).write_bytes(data + data[:-20])
    with pytest.raises(Exception, match="cut off"):
        spark.read.format("warc").load(str(tmp_path)).collect()


def test_members_with_many_records(spark, tmp_path):
    """Foreign archives may pack any number of records in one member, and members of both forms in one file."""
    warc.register(spark)

    def record(i, size, kind="response"):
        http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + b"%d " % i * size
        return b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:%d>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind.encode(), i, len(http), http)

    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(record(1, 5) + record(2, 90_000) + record(3, 0)) + gzip.compress(record(4, 7)) + gzip.compress(record(5, 1, "metadata") + record(6, 40_000)))
    got = sorted((r.record_id, r.payload_bytes, len(r.payload)) for r in spark.read.format("warc").load(str(tmp_path)).collect())
    assert got == [("urn:1", 10, 10), ("urn:2", 180_000, 180_000), ("urn:3", 0, 0), ("urn:4", 14, 14), ("urn:5", 2, 2), ("urn:6", 80_000, 80_000)]
    some = spark.read.format("warc").option("payload", "false").load(str(tmp_path)).where("record_type = 'response'").select("record_id", "payload_bytes").collect()
    assert sorted((r.record_id, r.payload_bytes) for r in some) == [(i, n) for i, n, _ in got if i != "urn:5"]
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(record(1, 5) + record(2, 90)[:-60]))
    with pytest.raises(Exception, match="cut off"):
        spark.read.format("warc").load(str(tmp_path)).collect()


def test_null_ids_and_repeated_rows(spark, write):
    """A row without page_id is a response of its own; repeated rows of one page are all responses or all revisits."""
    rows = [(None, "u", BIG, 0), (9, "u", BIG, 0), (9, "u", BIG, 0), (2, "u", BIG, 0), (2, "u", BIG, 0), (None, None, None, 0)]
    got = warc.op1_warc(spark, write("pages", rows, SCHEMA)).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == [("2", "revisit", 9)] * 2 + [("9", "response", None)] * 2 + [("None", "response", None)] * 2
