"""Queries on sources, landing and fetches."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from newsline.functions import text as t
from newsline.operators import ingest as op
from newsline.plans.live import KeyedTable
from newsline.plans.storage import scratch
from newsline.registry import register
from newsline.sources import feeds, pages
from newsline.streaming import ingest as streams

REGISTRY = """
SELECT id, CASE WHEN id LIKE '%7' THEN '' ELSE concat('http://', id) END AS url, CAST(substr(id,4) AS INT) - 2 AS rate_limit_seconds FROM sources
UNION ALL SELECT id, 'x', 1 FROM sources WHERE id LIKE '%5' UNION ALL SELECT concat('Bad ', id), 'x', 1 FROM sources WHERE band = 'centrist'"""


@register("registry_violations", f"""
, r AS ({REGISTRY})
SELECT id, 'duplicate_id' AS reason FROM r GROUP BY id HAVING count(*) > 1
UNION ALL SELECT id, 'bad_id' FROM r WHERE NOT regexp_full_match(id, '[a-z0-9_]+')
UNION ALL SELECT id, 'empty_url' FROM r WHERE trim(url) = '' UNION ALL SELECT id, 'bad_rate' FROM r WHERE rate_limit_seconds <= 0""")
def registry_violations(spark: SparkSession):
    return op.registry_violations(spark.sql(REGISTRY))


@register("sources_where", "SELECT id, band, kind FROM sources WHERE band = 'opposition'")
def sources_where(spark: SparkSession):
    return op.sources_where(spark.table("sources"), band="opposition").select("id", "band", "kind")


@register("upsert_latest_event", """
, r AS (SELECT user_id, event_type, event_id AS version, event_id % 2 AS fresh FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY fresh DESC, version DESC) AS n FROM r)
SELECT user_id, event_type, version FROM k WHERE n = 1""")
def upsert_latest_event(spark: SparkSession):
    rows = spark.table("events").select("user_id", "event_type", F.col("event_id").alias("version"))
    return op.upsert(rows.where("version % 2 = 0"), rows.where("version % 2 = 1"), ["user_id", "event_type"], "version")


@register("merged_latest_event", """
, r AS (SELECT user_id, event_type, event_id AS version, CASE event_id % 4 WHEN 3 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS batch FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY batch DESC, version DESC) AS n FROM r)
SELECT user_id, event_type, version, batch FROM k WHERE n = 1""")
def merged_latest_event(spark: SparkSession):
    """The latest event of each user and kind, kept in a table that two batches are merged into."""
    batch = F.when(F.col("event_id") % 4 == 3, 2).when(F.col("event_id") % 4 == 1, 1).otherwise(0).alias("batch")
    rows = spark.table("events").select("user_id", "event_type", F.col("event_id").alias("version"), batch)
    table = KeyedTable.create(rows.where("batch = 0"), scratch(spark, "merged"), ["user_id", "event_type"], "version", buckets=32)
    for n in (1, 2):
        table.upsert(rows.where(F.col("batch") == n))
    table.vacuum()
    return table.read()


@register("insert_ignore_new", """
, b AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM (SELECT user_id, event_type, event_id FROM events WHERE event_id % 3 = 0))
SELECT user_id, event_type, event_id FROM b WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id % 3 = 1 AND e.user_id = b.user_id AND e.event_type = b.event_type)""")
def insert_ignore_new(spark: SparkSession):
    rows = spark.table("events").select("user_id", "event_type", "event_id")
    return op.insert_ignore(rows.where("event_id % 3 = 1"), rows.where("event_id % 3 = 0"), ["user_id", "event_type"], ["event_id"])


@register("article_ids", "SELECT doc_id, sha256(source || '|' || 'http://' || CAST(doc_id % 900 AS STRING)) AS article_id FROM documents")
def article_ids(spark: SparkSession):
    url = F.concat(F.lit("http://"), (F.col("doc_id") % 900).cast("string"))
    return spark.table("documents").select("doc_id", t.article_id(F.col("source"), url).alias("article_id"))


CONTAINERS = "SELECT 's0' AS source_id, 'nav' AS tag, CAST(NULL AS STRING) AS class UNION ALL SELECT 's1', 'ul', NULL UNION ALL SELECT 's2', 'div', 'ad'"


@register("page_links", """
, n AS (SELECT page_id, url AS base, CASE page_id % 4 WHEN 1 THEN regexp_extract(html, '(?is)<ul\\b[^>]*>(.*?)</ul>', 1) WHEN 2 THEN regexp_extract(html, '(?is)<div\\b[^>]*\\bclass="ad"[^>]*>(.*?)</div>', 1) ELSE regexp_extract(html, '(?is)<nav\\b[^>]*>(.*?)</nav>', 1) END AS nav FROM pages),
h AS (SELECT page_id, base, unnest(regexp_extract_all(nav, '(?i)<a\\b[^>]*?\\bhref="([^"]+)"', 1)) AS href, generate_subscripts(regexp_extract_all(nav, '(?i)<a\\b[^>]*?\\bhref="([^"]+)"', 1), 1) - 1 AS pos FROM n)
SELECT page_id, CAST(min(pos) AS INT) AS pos, regexp_extract(base, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || replace(replace(replace(replace(href, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS url FROM h WHERE href LIKE '/%' GROUP BY 1, 3""")
def page_links(spark: SparkSession):
    """Each source lists its links in an element of its own; hrefs come in all three forms of quotes."""
    html = F.when(F.col("page_id") % 3 == 1, F.regexp_replace("html", 'href="([^"]*)"', "href='$1'")).when(F.col("page_id") % 3 == 2, F.regexp_replace("html", 'href="([^"\\s>]*)"', "href=$1")).otherwise(F.col("html"))
    rows = spark.table("pages").select("page_id", "url", html.alias("html"), F.concat(F.lit("s"), (F.col("page_id") % 4).cast("string")).alias("source_id"))
    return pages.extract_links(rows, spark.sql(CONTAINERS))


@register("page_titles", """
, x AS (SELECT page_id, trim(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) AS h,
trim(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) AS t FROM pages)
SELECT page_id, coalesce(nullif(h, ''), nullif(t, '')) AS title FROM x""")
def page_titles(spark: SparkSession):
    return pages.extract_title(spark.table("pages"))


# The pages carry no times; some get one of each form, from their own id.
DATED = """
SELECT page_id, CASE page_id % 5 WHEN 0 THEN replace(html, '</head>', concat('<script type="application/ld+json">{"a": {"datePublished": "2024-01-1', CAST(page_id % 9 AS STRING), 'T10:00:00"}}</script></head>'))
WHEN 1 THEN replace(html, '</head>', concat('<meta property="article:published_time" content="2024-02-1', CAST(page_id % 9 AS STRING), 'T11:00:00"></head>'))
WHEN 2 THEN replace(html, '<article>', concat('<article> 1', CAST(page_id % 9 AS STRING), ' Mart 2024 '))
WHEN 3 THEN replace(html, '<article>', concat('<article> 1', CAST(page_id % 9 AS STRING), '.04.2024 ')) ELSE html END AS html, TIMESTAMP '2024-06-01 00:00:00' AS fetched_at FROM pages"""


@register("page_times", """
SELECT page_id, CASE page_id % 5 WHEN 0 THEN '2024-01-1' || CAST(page_id % 9 AS STRING) || ' 10:00:00' WHEN 1 THEN '2024-02-1' || CAST(page_id % 9 AS STRING) || ' 11:00:00'
WHEN 2 THEN '2024-03-1' || CAST(page_id % 9 AS STRING) || ' 00:00:00' WHEN 3 THEN '2024-04-1' || CAST(page_id % 9 AS STRING) || ' 00:00:00' ELSE '2024-06-01 00:00:00' END AS ts,
CASE page_id % 5 WHEN 0 THEN 'json-ld' WHEN 1 THEN 'meta' WHEN 4 THEN 'fetched-at' ELSE 'turkish-regex' END AS method FROM pages""")
def page_times(spark: SparkSession):
    return pages.canonical_timestamp(spark.sql(DATED)).select("page_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "method")


POSTS = "SELECT event_id, ts AS created, CAST(value AS INT) AS score, user_id AS comments, event_type AS channel, event_type AS flair, props AS title FROM events"


@register("recent_popular_posts", """
SELECT event_id, CAST(trunc(value) AS INT) AS score, user_id AS comments FROM events
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOURS AND (trunc(value) >= 50 OR user_id >= 25)""")
def recent_popular_posts(spark: SparkSession):
    posts = spark.sql(POSTS)
    now = posts.agg(F.max("created").alias("now"))
    return feeds.filter_recent_popular(posts.crossJoin(F.broadcast(now)), F.col("now")).select("event_id", "score", "comments")


@register("channel_posts", """
SELECT event_id, event_type AS channel FROM events WHERE event_type IN ('view', 'click') AND (event_type = 'view' OR contains(lower(props), '1'))""")
def channel_posts(spark: SparkSession):
    rules = spark.sql("SELECT 'view' AS channel, array('VIEW') AS flair_any, CAST(array() AS array<string>) AS title_any UNION ALL SELECT 'click', CAST(array() AS array<string>), array('1')")
    return feeds.filter_by_channel_rules(spark.sql(POSTS), rules).select("event_id", "channel")


@register("normalized_posts", """
, c AS (SELECT doc_id, text, source, list_filter(list_transform(string_split(text, chr(10))[1:3], lambda x: substr(trim(x), 1, 200)), lambda x: x <> '') AS comments FROM documents)
SELECT CAST(doc_id AS STRING) AS id, substr(text, 1, 500) AS title, substr(text, 1, 200) AS body, array_to_string(comments, '|') AS comments, 'https://www.example.com/r/' || CAST(doc_id AS STRING) AS permalink, CASE WHEN doc_id % 2 <> 0 THEN 'http://' || source END AS external_url FROM c""")
def normalized_posts(spark: SparkSession):
    posts = spark.sql("SELECT CAST(doc_id AS STRING) AS id, text AS title, text AS selftext, split(text, '\n') AS comments, concat('/r/', doc_id) AS permalink, doc_id % 2 = 0 AS is_self, concat('http://', source) AS url FROM documents")
    return feeds.normalize_posts(posts).withColumn("comments", F.array_join("comments", "|"))


@register("feed_items", """
, i AS (SELECT source, doc_id, CASE WHEN doc_id % 7 > 0 THEN 'http://' || source || '/' || CAST(doc_id % 700 AS STRING) END AS url, CASE WHEN doc_id % 3 = 0 THEN 'g' || CAST(doc_id % 500 AS STRING) END AS guid FROM documents),
k AS (SELECT *, coalesce(guid, url) AS entry_id FROM i WHERE url IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY source, entry_id ORDER BY doc_id) AS n FROM k)
SELECT source, entry_id, url, 'no ' || CAST(doc_id AS STRING) AS title, strftime(TIMESTAMP '2024-01-02 00:00:00' + to_minutes(CAST(doc_id % 1000 AS INT)) - CASE WHEN doc_id % 2 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END, '%Y-%m-%d %H:%M:%S') AS ts,
CASE WHEN doc_id % 5 = 0 THEN 'content' ELSE 'description' END AS body FROM r WHERE n = 1""")
def feed_items(spark: SparkSession):
    """The documents as feeds, one XML file a source, read back."""
    at = "timestampadd(MINUTE, doc_id % 1000, TIMESTAMP '2024-01-02 00:00:00')"
    rows = spark.sql(f"""
SELECT source, doc_id, concat('no ', doc_id) AS title, CASE WHEN doc_id % 7 > 0 THEN concat('http://', source, '/', doc_id % 700) END AS link, CASE WHEN doc_id % 3 = 0 THEN concat('g', doc_id % 500) END AS guid,
date_format({at}, "yyyy-MM-dd'T'HH:mm:ss") AS published, CASE WHEN doc_id % 2 = 0 THEN date_format({at} - INTERVAL 1 DAY, "yyyy-MM-dd'T'HH:mm:ss") END AS updated,
'description' AS description, CASE WHEN doc_id % 5 = 0 THEN 'content' END AS content FROM documents""")
    path = scratch(spark, "feeds")
    rows.repartition("source").sortWithinPartitions("source", "doc_id").drop("doc_id").write.partitionBy("source").format("xml").option("rootTag", "rss").option("rowTag", "item").save(path)
    found = feeds.read_feed_items(spark, path)
    return found.select(F.regexp_extract("feed", "source=([^/]*)", 1).alias("source"), "entry_id", "url", "title", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "body")


GAZETTE = """
SELECT source AS edition, doc_id AS page, concat(CASE doc_id % 5 WHEN 3 THEN concat('T.C. YARGI BÖLÜMÜ', chr(10)) ELSE '' END, 'cover ', doc_id, chr(10), CASE WHEN doc_id % 3 = 0 THEN concat('  KANUN ', chr(10), chr(10), 'title ', doc_id, chr(10), 'Kanun No: ', doc_id % 900 + 1, chr(10), 'Sayı: 7') ELSE 'more' END) AS text FROM documents"""


@register("gazette_items", """
, x AS (SELECT doc_id, source, string_split(CASE doc_id % 5 WHEN 3 THEN 'T.C. YARGI BÖLÜMÜ' || chr(10) ELSE '' END || 'cover ' || CAST(doc_id AS STRING) || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'KANUN' || chr(10) || 'title ' || CAST(doc_id AS STRING) || chr(10) || 'Kanun No: ' || CAST(doc_id % 900 + 1 AS STRING) || chr(10) || 'Sayı: 7' ELSE 'more' END, chr(10)) AS a FROM documents),
p AS (SELECT doc_id, source, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM x),
o AS (SELECT *, sum(CASE WHEN line = 'KANUN' OR line LIKE '%YARGI BÖLÜMÜ' THEN 1 ELSE 0 END) OVER w AS g, sum(CASE WHEN line LIKE '%YARGI BÖLÜMÜ' THEN 1 ELSE 0 END) OVER w AS s FROM p WINDOW w AS (PARTITION BY source ORDER BY doc_id, i)),
t AS (SELECT source, g, min(CASE WHEN line = 'KANUN' THEN doc_id END) AS page, max(doc_id) AS last_page, max(s) AS s, string_agg(line, chr(10) ORDER BY doc_id, i) FILTER (WHERE line <> 'KANUN') AS body FROM o GROUP BY source, g HAVING count(*) FILTER (WHERE line = 'KANUN') = 1)
SELECT source AS edition, CAST(row_number() OVER (PARTITION BY source ORDER BY g) - 1 AS INT) AS item, CASE WHEN s > 0 THEN 'YARGI BÖLÜMÜ' ELSE 'YÜRÜTME VE İDARE BÖLÜMÜ' END AS section, 'title ' || CAST(page AS STRING) AS title,
CAST(page % 900 + 1 AS STRING) AS reference, body, page AS first_page, last_page, CAST(page % 900 + 1 AS STRING) AS entry_id, sha256('gazette|https://www.example.gov/eskiler/' || source || '#' || CAST(page % 900 + 1 AS STRING)) AS article_id FROM t""")
def gazette_items(spark: SparkSession):
    items = feeds.gazette_keys(feeds.segment_gazette(spark.sql(GAZETTE)))
    return items.select("edition", "item", "section", "title", "reference", "body", "first_page", "last_page", "entry_id", "article_id")


@register("ingest_summary", """
SELECT run_id, CAST(coalesce(sum(CASE WHEN status = 'OK' THEN articles_fetched END), 0) AS BIGINT) AS articles, count(*) FILTER (WHERE status = 'OK') AS n_ok, count(*) FILTER (WHERE status <> 'OK') AS n_failed FROM ingest_log GROUP BY run_id""")
def ingest_summary(spark: SparkSession):
    return op.ingest_summary(spark.table("ingest_log"))


@register("fetch_status", """
SELECT event_id, CASE WHEN user_id % 11 = 0 THEN 'SKIPPED' WHEN event_id % 7 = 0 THEN 'TIMEOUT' WHEN event_id % 13 = 0 OR event_type = 'error' THEN 'HTTP_ERROR' WHEN event_id % 5 = 0 AND user_id % 3 = 0 THEN 'PARSE_ERROR' ELSE 'OK' END AS status FROM events""")
def fetch_status(spark: SparkSession):
    rows = spark.sql("SELECT event_id, user_id % 11 <> 0 AS has_handler, event_id % 7 = 0 AS timed_out, event_id % 13 = 0 AS transport_error, CASE WHEN event_type = 'error' THEN 503 ELSE 200 END AS http_status, event_id % 5 <> 0 AS parsed, CAST(user_id % 3 AS INT) AS entries FROM events")
    return op.classify_fetch(rows).select("event_id", "status")


@register("pending_articles", """
SELECT a.id, a.source_id FROM articles a WHERE a.source_id IN (SELECT source_id FROM ingest_log WHERE run_id = 'run_20240103') AND CAST(a.id AS BIGINT) % 4 <> 0""")
def pending_articles(spark: SparkSession):
    rows = spark.table("articles").select("id", "source_id")
    return op.pending(rows, spark.table("ingest_log"), rows.where("CAST(id AS BIGINT) % 4 = 0"), "run_20240103").select("id", "source_id")


ARRIVALS = "SELECT event_id, concat('src', user_id % 20) AS source_id, concat('http://', event_id % 4000) AS url, ts AS fetched_at, ts, CASE WHEN event_type = 'error' THEN 'HTTP_ERROR' ELSE 'OK' END AS status FROM events"


def _stream(spark: SparkSession):
    """The fetches as a stream of files, some of them twice."""
    rows, path = spark.sql(ARRIVALS), scratch(spark, "arrivals")
    rows.union(rows.where("event_id % 5 = 0")).repartition(6, "event_id").write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)


@register("streamed_articles", "SELECT DISTINCT sha256('src' || CAST(user_id % 20 AS STRING) || '|' || 'http://' || CAST(event_id % 4000 AS STRING)) AS id FROM events")
def streamed_articles(spark: SparkSession):
    """Each article that arrives on a stream, once, over several micro-batches."""
    path = scratch(spark, "articles")
    streams.ingest_into(_stream(spark), path, scratch(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(path).select("id")


@register("streamed_source_health", """
, a AS (SELECT event_id, 'src' || CAST(user_id % 20 AS STRING) AS source_id, date_trunc('day', ts) AS day, event_type = 'error' AS bad FROM events),
b AS (SELECT * FROM a UNION ALL SELECT * FROM a WHERE event_id % 5 = 0)
SELECT strftime(day, '%Y-%m-%d') AS day, source_id, count(*) FILTER (WHERE NOT bad) AS n_ok, count(*) FILTER (WHERE bad) AS n_failed FROM b GROUP BY day, source_id""")
def streamed_source_health(spark: SparkSession):
    """Fetches by source and day, kept up to date on a stream; a month's delay, so nothing is late."""
    path = scratch(spark, "health")
    counts = streams.stream_source_health(_stream(spark), delay="40 days")

    def land(batch, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    counts.writeStream.outputMode("update").foreachBatch(land).option("checkpointLocation", scratch(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(path).groupBy("start", "source_id").agg(F.max(F.struct("batch", "n_ok", "n_failed")).alias("m"))
    return last.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "source_id", "m.n_ok", "m.n_failed")
