"""Queries on runs, overrides, search and integrity."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from newsline.operators import ledger as op
from newsline.operators.fulltext import TextIndex
from newsline.plans.adapters import articles_with
from newsline.plans.live import write_dated
from newsline.plans.storage import scratch
from newsline.queries.news import LINKED, NOW
from newsline.registry import register

STAGE = "list_extract(['ingest','normalize','cluster','score','arcs','write','tts'], CAST(event_id % 7 AS INT) + 1)"
EVENTS = "SELECT concat('run_', CAST(user_id % 40 AS STRING)) AS run_id, ts AS at, element_at(array('ingest','normalize','cluster','score','arcs','write','tts'), CAST(event_id % 7 AS INT) + 1) AS stage, CASE WHEN event_type = 'error' AND event_id % 9 = 0 THEN 'failed' ELSE 'done' END AS outcome, event_type AS reason FROM events"
RAN = f", v AS (SELECT 'run_' || CAST(user_id % 40 AS STRING) AS run_id, ts AS at, {STAGE} AS stage, CASE WHEN event_type = 'error' AND event_id % 9 = 0 THEN 'failed' ELSE 'done' END AS outcome FROM events)"


@register("run_status", RAN + """
SELECT run_id, count(DISTINCT CASE WHEN outcome = 'done' THEN stage END) AS n_done, count(*) FILTER (WHERE outcome = 'failed') AS n_failed,
CASE WHEN count(*) FILTER (WHERE outcome = 'failed') > 0 THEN 'FAILED' WHEN count(DISTINCT CASE WHEN outcome = 'done' THEN stage END) = 7 THEN 'DONE' ELSE 'RUNNING' END AS status FROM v GROUP BY run_id""")
def run_status(spark: SparkSession):
    return op.run_status(spark.sql(EVENTS)).select("run_id", F.size("stages_done").cast("long").alias("n_done"), F.size("failed_stages").cast("long").alias("n_failed"), "status")


@register("merged_counts", """
, k AS (SELECT user_id, event_type, arg_max(event_id, ts) AS n, max(event_id) AS m FROM events GROUP BY user_id, event_type)
SELECT 'run_' || CAST(user_id AS STRING) AS run_id, string_agg(event_type || '=' || CAST(n AS STRING), ',' ORDER BY event_type) AS counts FROM k GROUP BY user_id""")
def merged_counts(spark: SparkSession):
    rows = spark.sql("SELECT concat('run_', CAST(user_id AS STRING)) AS run_id, event_type AS name, ts AS at, event_id AS n FROM events")
    text = F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), ",")
    return op.merge_counts(rows).select("run_id", text.alias("counts"))


@register("stuck_runs", RAN + """
, d AS (SELECT run_id, count(DISTINCT CASE WHEN outcome = 'done' AND stage <> 'tts' THEN stage END) AS n, CAST(substr(run_id, 5) AS INT) % 2 = 0 AS full_run FROM v GROUP BY run_id)
SELECT run_id, full_run AND n = 6 AS stuck, CASE WHEN full_run THEN 6 - n ELSE 7 - n END AS n_missing FROM d""")
def stuck_runs(spark: SparkSession):
    full = F.substring("run_id", 5, 9).cast("int") % 2 == 0
    done = op.run_status(spark.sql(EVENTS)).withColumn("stages_done", F.array_except("stages_done", F.array(F.lit("tts"))))
    rows = done.withColumn("stages_done", F.when(full, F.array_union("stages_done", F.array(F.lit("tts")))).otherwise(F.col("stages_done"))).withColumn("marked", F.lit("RUNNING"))
    return op.stuck_runs(rows).select("run_id", "stuck", F.size("missing").cast("long").alias("n_missing"))


@register("slow_stages", f"SELECT event_id, CASE WHEN value > 2 * (20 + 5 * (event_id % 7)) THEN 'timeout' WHEN value > 20 + 5 * (event_id % 7) THEN 'slow' ELSE 'ok' END AS verdict FROM events")
def slow_stages(spark: SparkSession):
    stages = spark.sql("SELECT event_id, element_at(array('ingest','normalize','cluster','score','arcs','write','tts'), CAST(event_id % 7 AS INT) + 1) AS stage, value AS seconds FROM events")
    budgets = spark.createDataFrame([(s, 20.0 + 5 * i) for i, s in enumerate(op.STAGES)], "stage string, budget_seconds double")
    return op.slow_stages(stages, budgets).select("event_id", "verdict")


@register("retained_rows", f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-04-10 00:00:00' - INTERVAL 90 DAYS")
def retained_rows(spark: SparkSession):
    return op.apply_retention(spark.table("events"), "raw_articles", "ts", F.expr("TIMESTAMP '2024-04-10 00:00:00'")).select("event_id")


@register("retained_days", """
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, min(event_id) AS first_id FROM events WHERE CAST(ts AS DATE) >= CAST(TIMESTAMP '2024-04-10 06:00:00' - INTERVAL 90 DAYS AS DATE) GROUP BY 1""")
def retained_days(spark: SparkSession):
    """What a table of one folder a day holds after retention has dropped folders."""
    path = scratch(spark, "dated")
    write_dated(spark.table("events").select("event_id", "ts"), path, "ts")
    op.expire_days(spark, path, "raw_articles", dt.datetime(2024, 4, 10, 6))
    rows = spark.read.parquet(path)
    return rows.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


CLUSTERS = "SELECT cluster_id, CAST(raw_severity AS INT) AS final_severity, concat('arc_', CAST(CAST(substr(cluster_id, 4, 4) AS INT) AS STRING)) AS arc_id FROM clusters"
#: Merges in a chain (arcs 0 to 3), in a circle (5 to 7) and into that (4).
OVERRIDES = """
SELECT created_at AS at, CASE WHEN raw_severity = 1 THEN 'PROMOTE' ELSE 'DISMISS' END AS action, cluster_id AS target_id, CASE WHEN raw_severity = 1 THEN '0' END AS new_value FROM clusters WHERE raw_severity IN (1, 3)
UNION ALL SELECT TIMESTAMP '2024-01-05 00:00:00', 'MERGE', concat('arc_', CAST(n AS STRING)), concat('arc_', CAST(CASE WHEN n = 7 THEN 5 ELSE n + 1 END AS STRING)) FROM (SELECT DISTINCT CAST(substr(cluster_id, 4, 4) AS INT) AS n FROM clusters) x WHERE n < 3 OR n BETWEEN 4 AND 7"""


@register("overridden_clusters", """
SELECT cluster_id, CAST(CASE raw_severity WHEN 1 THEN 0 WHEN 3 THEN 5 WHEN 0 THEN 1 ELSE raw_severity END AS INT) AS final_severity,
'arc_' || CAST(CASE WHEN CAST(substr(cluster_id, 4, 4) AS INT) < 3 THEN 3 ELSE CAST(substr(cluster_id, 4, 4) AS INT) END AS STRING) AS arc_id, raw_severity = 3 AS dismissed FROM clusters""")
def overridden_clusters(spark: SparkSession):
    clusters = spark.sql(CLUSTERS)
    arcs = clusters.select(F.col("arc_id").alias("id"), F.lit("OPEN").alias("state"), F.lit("h").alias("headline")).distinct()
    return op.apply_overrides(clusters, arcs, spark.sql(OVERRIDES))[0]


@register("overridden_arcs", "SELECT DISTINCT 'arc_' || CAST(CAST(substr(cluster_id, 4, 4) AS INT) AS STRING) AS id, CASE WHEN CAST(substr(cluster_id, 4, 4) AS INT) < 3 THEN 'RESOLVED' ELSE 'OPEN' END AS state FROM clusters")
def overridden_arcs(spark: SparkSession):
    clusters = spark.sql(CLUSTERS)
    arcs = clusters.select(F.col("arc_id").alias("id"), F.lit("OPEN").alias("state"), F.lit("h").alias("headline")).distinct()
    return op.apply_overrides(clusters, arcs, spark.sql(OVERRIDES))[1].select("id", "state")


@register("found_articles", """
, w AS (SELECT id, string_split_regex(lower(translate(title || ' ' || body, 'İI', 'iı')), '\\s+') AS w, published_at, language FROM articles)
SELECT id FROM w WHERE list_contains(w, 'the') AND list_contains(w, 'of') AND published_at < TIMESTAMP '2024-01-03 00:00:00' AND language = 'en'""")
def found_articles(spark: SparkSession):
    rows = spark.table("articles")
    return op.search(op.token_index(rows), rows, "the of", until="2024-01-03 00:00:00", language="en").select("id")


@register("found_in_stories", """
, w AS (SELECT id, source_id, string_split_regex(lower(translate(title || ' ' || body, 'İI', 'iı')), '\\s+') AS w FROM articles),
s AS (SELECT ca.article_id FROM cluster_articles ca JOIN clusters c USING (cluster_id) WHERE c.raw_severity IN (2, 3))
SELECT id FROM w WHERE list_contains(w, 'the') AND source_id IN ('src0', 'src1', 'src9') AND source_id <> 'src1' AND id IN (SELECT article_id FROM s)""")
def found_in_stories(spark: SparkSession):
    """Articles with a word, an entity, and a story of a category and a severity."""
    rows = spark.table("articles")
    names = rows.select("id", F.when(F.col("source_id").isin("src0", "src9"), "Oda").otherwise("Kurul").alias("entity"))
    told = spark.sql("SELECT ca.article_id AS id, CASE WHEN raw_severity > 1 THEN 'TOPLUM' ELSE 'YARGI' END AS category, raw_severity AS severity FROM cluster_articles ca JOIN clusters USING (cluster_id)")
    return op.search(op.token_index(rows), rows, "the", entity=(names, "Oda"), clusters=told, category="TOPLUM", worst=3).select("id")


SPOKEN = "string_split_regex(trim(lower(translate(title || ' ' || body, 'İI', 'iı')), chr(32) || chr(9) || chr(10) || chr(13)), '\\s+')"


def _text_index(spark: SparkSession) -> TextIndex:
    """An index of all articles in two batches; the second replaces a third of them, which the first has with a word more."""
    rows = articles_with(spark).select("id", "title", "body", "published_at", (F.col("id").cast("long") % 3).alias("part"))
    early = rows.where("part < 2").withColumn("body", F.when(F.col("part") == 0, F.concat(F.lit("of the "), "body")).otherwise(F.col("body")))
    index = TextIndex.create(early, scratch(spark, "fulltext"))
    index.add(rows.where("part <> 1"))
    return index


@register("phrase_articles", f"""
, w AS (SELECT id, {SPOKEN} AS w FROM articles),
h AS (SELECT id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS n_hits FROM w)
SELECT id, CAST(n_hits AS BIGINT) AS n_hits FROM h WHERE n_hits > 0""")
def phrase_articles(spark: SparkSession):
    return _text_index(spark).phrase("Of the")


@register("ranked_articles", f"""
, w AS (SELECT id, list_filter({SPOKEN}, lambda x: x <> '') AS w FROM articles),
n AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS mean FROM w),
t AS (SELECT id, token, len(w) AS length, len(list_filter(w, lambda x: x = token)) AS tf FROM w, (SELECT unnest(['the', 'time', 'haus', 'maison']) AS token)),
d AS (SELECT token, count(*) AS df FROM t WHERE tf > 0 GROUP BY token)
SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM t JOIN d USING (token), n WHERE tf > 0 GROUP BY id""")
def ranked_articles(spark: SparkSession):
    return _text_index(spark).ranked("the time haus maison").select("id", F.round("score", 6).alias("score"))


@register("arc_timelines", f"SELECT cluster_id, CAST(row_number() OVER (ORDER BY created_at DESC, cluster_id) AS INT) AS n FROM ({LINKED}) WHERE arc_id = 'arc_0003'")
def arc_timelines(spark: SparkSession):
    from newsline.queries.report import sources

    return op.arc_timeline(spark.sql(LINKED), sources(spark), "arc_0003").select("cluster_id", "n")


@register("source_health", f"SELECT source_id, epoch_us(max(CASE WHEN status = 'OK' THEN completed_at END)) AS last_ok, count(*) FILTER (WHERE status <> 'OK' AND completed_at >= {NOW} - INTERVAL 7 DAYS) AS n_failed FROM ingest_log GROUP BY source_id")
def source_health(spark: SparkSession):
    return op.source_health(spark.table("ingest_log"), F.expr(NOW)).select("source_id", F.unix_micros(F.col("last_ok").cast("timestamp")).alias("last_ok"), "n_failed")


@register("run_history", f"SELECT r.run_id, count(l.run_id) AS n_sources, count(*) FILTER (WHERE l.status <> 'OK') AS n_failed, CAST(sum(l.articles_fetched) AS BIGINT) AS articles FROM pipeline_runs r JOIN ingest_log l USING (run_id) WHERE r.started_at >= TIMESTAMP '2024-02-05 00:00:00' - INTERVAL 30 DAYS GROUP BY r.run_id")
def run_history(spark: SparkSession):
    return op.run_history(spark.table("pipeline_runs"), spark.table("ingest_log"), F.expr("TIMESTAMP '2024-02-05 00:00:00'")).select("run_id", "n_sources", "n_failed", "articles")


@register("failure_report", f"""
, v AS (SELECT 'run_' || strftime(ts, '%Y%m%d') AS run_id, ts AS seen, {STAGE} AS stage, event_type AS name, event_id AS n, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS outcome FROM events),
k AS (SELECT run_id, string_agg(name || '=' || CAST(n AS STRING), ',' ORDER BY name) AS counts FROM (SELECT run_id, name, arg_max(n, seen) AS n FROM v GROUP BY run_id, name) GROUP BY run_id),
z AS (SELECT run_id, arg_max(stage, (seen, stage)) AS last_stage FROM v WHERE outcome = 'done' GROUP BY run_id)
SELECT l.run_id, coalesce(string_agg(CASE WHEN status = 'OK' THEN source_id END, ',' ORDER BY source_id), '') AS ok_sources, coalesce(string_agg(CASE WHEN status <> 'OK' THEN source_id END, ',' ORDER BY source_id), '') AS failed_sources, any_value(last_stage) AS last_stage, any_value(counts) AS counts
FROM ingest_log l JOIN k ON k.run_id = l.run_id JOIN z ON z.run_id = l.run_id WHERE l.run_id = 'run_20240103' GROUP BY l.run_id""")
def failure_report(spark: SparkSession):
    events = spark.sql("SELECT concat('run_', date_format(ts, 'yyyyMMdd')) AS run_id, ts AS at, element_at(array('ingest','normalize','cluster','score','arcs','write','tts'), CAST(event_id % 7 AS INT) + 1) AS stage, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS outcome, event_type AS name, event_id AS n FROM events")
    text = F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), ",")
    return op.failure_report(spark.table("ingest_log"), "run_20240103", events, events).drop("last_completed").withColumn("counts", text)


@register("override_rate", "SELECT strftime(date_trunc('week', created_at), '%Y-%m-%d') AS week, count(*) AS n, count(*) > 3 AS alert FROM clusters WHERE raw_severity IN (1, 3) GROUP BY 1")
def override_rate(spark: SparkSession):
    return op.override_rate(spark.table("clusters").where("raw_severity in (1, 3)").withColumnRenamed("created_at", "at")).withColumn("week", F.date_format("week", "yyyy-MM-dd"))


@register("report_index", """
, d AS (SELECT strftime(ts, '%Y-%m-%d') AS date, coalesce(max(event_id) FILTER (WHERE event_id % 2 = 1), max(event_id) FILTER (WHERE event_id % 2 = 0)) AS n FROM events GROUP BY 1)
SELECT date, n, CAST(n % 6 AS INT) AS peak, 'briefings/' || date || '.md' AS path FROM d""")
def report_index(spark: SparkSession):
    rows = spark.sql("SELECT date_format(ts, 'yyyy-MM-dd') AS date, event_id AS n, CAST(event_id % 6 AS INT) AS peak, concat('briefings/', date_format(ts, 'yyyy-MM-dd'), '.md') AS path, event_id AS generated_at FROM events")
    return op.report_index(rows.where("n % 2 = 0"), rows.where("n % 2 = 1")).select("date", "n", "peak", "path")


@register("referential_checks", """
SELECT 'cluster_articles.article_id -> articles.id' AS problem, count(*) AS n FROM cluster_articles WHERE article_id NOT IN (SELECT id FROM articles WHERE language <> 'fr')
UNION ALL SELECT 'ingest_log.run_id -> pipeline_runs.run_id', count(*) FROM ingest_log WHERE run_id = 'run_20240105' UNION ALL SELECT 'articles key', 0""")
def referential_checks(spark: SparkSession):
    t = spark.table
    tables = {"cluster_articles": t("cluster_articles"), "articles": t("articles").where("language <> 'fr'"), "ingest_log": t("ingest_log"), "pipeline_runs": t("pipeline_runs").where("run_id <> 'run_20240105'")}
    return op.referential_checks(tables, {"articles": ["id"]}, [("cluster_articles", "article_id", "articles", "id"), ("ingest_log", "run_id", "pipeline_runs", "run_id")])
