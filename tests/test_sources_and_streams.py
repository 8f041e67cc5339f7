import datetime as dt

from pyspark.sql import functions as F

from newsline.operators import ledger, report
from newsline.operators.ingest import ingest_summary
from newsline.sources import feeds, pages
from newsline.streaming.ingest import ingest_into, stream_ingest, stream_source_health

FEED = """<rss><channel>
<item><title>One</title><link>http://x/1</link><guid>g1</guid><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate><description>d1</description></item>
<item><title>Again</title><link>http://x/2</link><guid>g1</guid></item>
<item><title>No link</title><guid>g3</guid></item>
<item><title>Three</title><link>http://x/3</link><updated>2024-01-02T00:00:00Z</updated><published>2024-01-03T00:00:00Z</published><content>c3</content></item>
</channel></rss>"""


def test_feed(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(FEED)
    got = sorted((r.entry_id, r.url, r.ts, r.body) for r in feeds.read_feed_items(spark, str(tmp_path / "feed.xml")).collect())
    assert got == [("g1", "http://x/1", dt.datetime(2024, 1, 1, 10), "d1"), ("http://x/3", "http://x/3", dt.datetime(2024, 1, 2), "c3")]


def test_posts(spark):
    rows = [("a", "t" * 600, None, ["x" * 300, " ", "y", "z"], "/r/1", True, "http://u"), ("b", "t", "s", None, "http://p", False, "http://u")]
    df = spark.createDataFrame(rows, "id string, title string, selftext string, comments array<string>, permalink string, is_self boolean, url string")
    got = {r.id: r for r in feeds.normalize_posts(df).collect()}
    assert (len(got["a"].title), got["a"].comments, got["a"].permalink, got["a"].external_url) == (500, ["x" * 200, "y"], "https://www.example.com/r/1", None)
    assert (got["b"].comments, got["b"].external_url, got["b"].permalink) == ([], "http://u", "http://p")


def test_gazette(spark):
    text = [(1, 1, "Resmî\nYÜRÜTME VE İDARE BÖLÜMÜ\nönsöz\nKANUN\n\nBir Kanun\nKanun No: 7123\nmetin"), (1, 2, "devam\nTEBLİĞ\nBir Tebliğ\nYARGI BÖLÜMÜ\nara\nYÖNETMELİK\nSon")]
    got = feeds.gazette_keys(feeds.segment_gazette(spark.createDataFrame(text, "edition int, page int, text string"))).orderBy("item").collect()
    assert [(r.section, r.kind, r.title, r.reference, r.first_page, r.last_page) for r in got] == [
        ("YÜRÜTME VE İDARE BÖLÜMÜ", "KANUN", "Bir Kanun", "7123", 1, 2), ("YÜRÜTME VE İDARE BÖLÜMÜ", "TEBLİĞ", "Bir Tebliğ", "", 2, 2), ("YARGI BÖLÜMÜ", "YÖNETMELİK", "Son", "", 2, 2)
    ]
    assert [r.entry_id for r in got] == ["7123", "item-1-p2", "item-2-p2"]
    assert [r.body for r in got] == ["Bir Kanun\nKanun No: 7123\nmetin\ndevam", "Bir Tebliğ", "Son"]
    early = feeds.segment_gazette(spark.createDataFrame([(1, 1, "KANUN\nErken")], "edition int, page int, text string")).first()
    assert (early.section, early.title) == ("YÜRÜTME VE İDARE BÖLÜMÜ", "Erken")


def test_streams_equal_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"s{i % 3}", f"u{i % 20}", t0 + dt.timedelta(minutes=i)) for i in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20] + rows[:5], "source_id string, url string, fetched_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("source_id string, url string, fetched_at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    want = {(r[0], r[1]) for r in rows}
    query = stream_ingest(read()).writeStream.format("memory").queryName("first_seen").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("first_seen").collect()
    assert len(got) == len(want) and {(r.source_id, r.url) for r in got} == want
    ingest_into(read(), str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == len(want) and {(r.source_id, r.url) for r in got} == want


def test_stream_health_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"s{i % 3}", "OK" if i % 4 else "TIMEOUT", t0 + dt.timedelta(hours=i)) for i in range(72)]
    spark.createDataFrame(rows, "source_id string, status string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source_id string, status string, ts timestamp").parquet(str(tmp_path / "in"))
    query = stream_source_health(stream).writeStream.format("memory").outputMode("complete").queryName("health").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.start, r.source_id): (r.n_ok, r.n_failed) for r in spark.table("health").collect()}
    batch = {}
    for s, status, ts in rows:
        key = (dt.datetime(ts.year, ts.month, ts.day), s)
        a, b = batch.get(key, (0, 0))
        batch[key] = (a + (status == "OK"), b + (status != "OK"))
    assert got == batch


def test_summary_of_nothing(spark):
    assert ingest_summary(spark.createDataFrame([], "run_id string, source_id string, status string, articles_fetched long")).count() == 0


def test_report_round(spark):
    lines = [("r1", 0, "a", "### x"), ("r1", 2, "a", "### Öne Çıkanlar"), ("r1", 2, "b", "- old · `arc_20240101_0001` · 3 gün önce"), ("r1", 2, "c", report.OVERFLOW), ("r1", 2, "d", "- hidden · bugün"), ("r1", 1, "a", "Kaynaklar: y")]
    df = report.assemble_report(spark.createDataFrame(lines, "run_id string, section int, rank string, line string"))
    assert report.validate_reports(df).first().errors == []
    text = df.first().report
    assert text.count("## ❯") == 8 and text.index("DEFCON 1-2") < text.index("SİSTEM LOG")
    spoken = report.speech_text(report.voiced_scope(df)).first().text
    assert report.DORMANT_NOTE in spoken and "hidden" not in spoken and "Kaynaklar" not in spoken and "old" not in spoken and "Öne" not in spoken


def test_reports_with_leftovers(spark):
    df = report.assemble_report(spark.createDataFrame([("r1", 0, "a", "x")], "run_id string, section int, rank string, line string"))
    broken = df.withColumn("report", F.replace(F.replace("report", F.lit(report.SECTIONS[3]), F.lit("## plain")), F.lit(report.SECTIONS[5]), F.lit(f"{report.SECTIONS[5]}\n Adım 2: x\nGÖREV · y\n[içerik buraya")))
    assert report.validate_reports(broken).first().errors == ["missing:3", "placeholder:5", "prompt_echo:5", "reasoning:5", "unexpected", "unmarked"]


def test_speech(spark):
    text = "### Eski\n\n- a · `arc_20240101_0012` · 5 gün önce\n- b · `arc_20240101_0013` · 2 gün önce\n\n### Yeni\n- c · `arc_20240101_0002` · dün\n- d · `arc_20240101_0003` · 9 gün önce\n**Güncelleme** · 3 gün önce\n**Kaynaklar** · x\n## ❯ DEFCON 1-2\n[bağ](http://x) *eğik* DEFCON · 3 DEFCON\n---\nTBMM CHPX"
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(text.split("\n"))], "run_id string, pos int, line string")
    got = report.speech_text(df).first().text
    assert got == f"{report.DORMANT_NOTE}\n\nYeni\n- c · hikaye 2 · dün\nGüncelleme · 3 gün önce\n\nDefkon Bir-2\nbağ eğik Defkon Üç Defkon\n\nTe Be Me Me CHPX"


def test_links_of_containers(spark):
    page = "<ul class='a list'><li><a href='/x'>x</a><a href=y>y</a></ul><nav><a href=\"/n\">n</a></nav>"
    df = spark.createDataFrame([(1, "http://h/p/q", page, "s1"), (2, "http://h/p/q", page, "s2")], "page_id int, url string, html string, source_id string")
    containers = spark.createDataFrame([("s1", "ul", "list")], "source_id string, tag string, class string")
    got = sorted((r.page_id, r.pos, r.url) for r in pages.extract_links(df, containers).collect())
    assert got == [(1, 0, "http://h/x"), (1, 1, "http://h/p/y"), (2, 0, "http://h/n")]


def test_merge_circles_are_void(spark):
    clusters = spark.createDataFrame([(f"c{i}", 3, f"a{i}") for i in range(1, 7)], "cluster_id string, final_severity int, arc_id string")
    arcs = spark.createDataFrame([(f"a{i}", "OPEN", "h") for i in range(1, 7)], "id string, state string, headline string")
    log = [(dt.datetime(2024, 1, 1), "MERGE", x, y) for x, y in (("a1", "a2"), ("a2", "a3"), ("a3", "a1"), ("a4", "a1"), ("a5", "a6"))]
    c, a = ledger.apply_overrides(clusters, arcs, spark.createDataFrame(log, "at timestamp, action string, target_id string, new_value string"))
    assert {r.cluster_id: r.arc_id for r in c.collect()} == {"c1": "a1", "c2": "a2", "c3": "a3", "c4": "a4", "c5": "a6", "c6": "a6"}
    assert {r.id for r in a.where("state = 'RESOLVED'").collect()} == {"a5"}


def test_override_chains(spark):
    clusters = spark.createDataFrame([("c1", 0, "a1"), ("c2", 3, "a2"), ("c3", 0, "a9")], "cluster_id string, final_severity int, arc_id string")
    arcs = spark.createDataFrame([(f"a{i}", "OPEN", "h") for i in (1, 2, 3, 4, 9)], "id string, state string, headline string")
    at = lambda n: dt.datetime(2024, 1, n)
    log = [(at(1), "MERGE", "a1", "a2"), (at(2), "MERGE", "a2", "a3"), (at(3), "MERGE", "a3", "a4"), (at(1), "PROMOTE", "c3", "0"), (at(1), "RENAME", "a9", "new"), (at(1), "RESOLVE", "a9", None), (at(2), "REOPEN", "a9", None), (at(4), "SPLIT", "c2", "a77")]
    c, a = ledger.apply_overrides(clusters, arcs, spark.createDataFrame(log, "at timestamp, action string, target_id string, new_value string"))
    assert {r.cluster_id: (r.final_severity, r.arc_id) for r in c.collect()} == {"c1": (1, "a4"), "c2": (3, "a77"), "c3": (0, "a9")}
    assert {r.id: (r.state, r.headline) for r in a.collect()} == {"a1": ("RESOLVED", "h"), "a2": ("RESOLVED", "h"), "a3": ("RESOLVED", "h"), "a4": ("OPEN", "h"), "a9": ("OPEN", "new"), "a77": ("OPEN", None)}


def test_report_title_and_empty_reports(spark):
    """The title is the first line with text, to the letter; an empty report has one error; words in brackets are no leftovers."""
    full = report.assemble_report(spark.createDataFrame([("r", 0, "a", "x <yer> {ad}")], "run_id string, section int, rank string, line string")).first().report
    rows = [("blank first", "\n \n" + full), ("other title", full.replace(report.TITLE, report.TITLE + "!")), ("text first", "x\n" + full), ("empty", ""), ("blank", " \n\t\n"), ("null", None)]
    got = {r.run_id: r.errors for r in report.validate_reports(spark.createDataFrame(rows, "run_id string, report string")).collect()}
    assert got == {"blank first": [], "other title": ["no_title"], "text first": ["no_title"], "empty": ["empty"], "blank": ["empty"], "null": ["empty"]}
