"""The news tables, shaped from the general input tables by SQL that both engines read alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsline.plans.storage import spread

BASE = ("documents", "events", "embeddings", "pages")
#: Tables of texts, where a row is much work.
LONG = ("documents", "pages")

ADAPTERS: dict[str, str] = {
    "sources": """
SELECT source AS id, source AS display_name,
       CASE CAST(substr(source,4) AS INT) % 10 WHEN 0 THEN 'gov_aligned' WHEN 1 THEN 'centrist' WHEN 2 THEN 'opposition'
       WHEN 3 THEN 'independent' WHEN 4 THEN 'international' WHEN 5 THEN 'social_x' WHEN 6 THEN 'social_reddit'
       WHEN 7 THEN 'primary_gov' WHEN 8 THEN 'primary_market' ELSE 'primary_judicial' END AS band,
       CASE CAST(substr(source,4) AS INT) % 4 WHEN 0 THEN 'RSS' WHEN 1 THEN 'HTML' WHEN 2 THEN 'PDF' ELSE 'API' END AS kind
       FROM documents GROUP BY source""",
    "articles": """
SELECT CAST(d.doc_id AS STRING) AS id, d.source AS source_id, e.ts AS published_at,
       split_part(d.text, chr(10), 1) AS title, substr(d.text,1,500) AS lead, d.text AS body, d.lang AS language
       FROM documents d JOIN events e ON e.event_id = d.doc_id""",
    "cluster_articles": """
SELECT concat('cl_', lpad(CAST(v.label AS STRING),4,'0'), '_', CAST(d.doc_id % 7 AS STRING)) AS cluster_id,
       CAST(d.doc_id AS STRING) AS article_id FROM embeddings v JOIN documents d ON d.doc_id = v.vec_id""",
    "clusters": """
SELECT cluster_id, min(a.published_at) AS created_at,
       CAST(min(CAST(ca.article_id AS BIGINT)) % 6 AS INT) AS raw_severity
       FROM cluster_articles ca JOIN articles a ON a.id = ca.article_id GROUP BY cluster_id""",
    "ingest_log": """
SELECT concat('run_', replace(CAST(CAST(ts AS DATE) AS STRING),'-','')) AS run_id,
       concat('src', CAST(user_id % 20 AS STRING)) AS source_id, min(ts) AS started_at, max(ts) AS completed_at,
       CASE WHEN sum(CASE WHEN event_type='error' THEN 1 ELSE 0 END) * 3 > count(*) THEN 'HTTP_ERROR' ELSE 'OK' END AS status,
       sum(CASE WHEN event_type='view' THEN 1 ELSE 0 END) AS articles_fetched
       FROM events GROUP BY 1, 2""",
    "pipeline_runs": """
SELECT run_id, min(started_at) AS started_at, max(completed_at) AS completed_at FROM ingest_log GROUP BY run_id""",
    "arcs": """
SELECT concat('arc_', lpad(CAST(user_id AS STRING),4,'0')) AS id, min(ts) AS created_at,
       max(CASE WHEN event_id % 5 = 0 THEN ts END) AS last_update_at,
       CAST(min(event_id) % 6 AS INT) AS peak_severity,
       CASE user_id % 5 WHEN 0 THEN 'RESOLVED' WHEN 1 THEN 'WATCH' ELSE 'OPEN' END AS state
       FROM events WHERE ts < TIMESTAMP '2024-01-10 00:00:00' OR user_id % 2 = 0 GROUP BY user_id""",
}

#: Prefix of an oracle's SELECT.
WITH = "WITH RECURSIVE " + ",\n".join(f"{name} AS ({sql})" for name, sql in ADAPTERS.items()) + "\n"


def load(spark: SparkSession, sf_dir: str) -> SparkSession:
    """Register the input tables and the news tables as temporary views; nothing is computed."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for name in BASE:
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        (spread(rows) if name in LONG else rows).createOrReplaceTempView(name)
    for name, sql in ADAPTERS.items():
        spark.sql(sql).createOrReplaceTempView(name)
    return spark


def articles_with(spark: SparkSession, **of_text: Column) -> DataFrame:
    """The articles and further columns of their title, lead and body, worked out before the texts meet their times.

    Spark leaves such columns below the join, so of title, lead and body only those that are read later move.
    """
    said = spark.sql(
        "SELECT CAST(doc_id AS STRING) AS id, source AS source_id, split_part(text, chr(10), 1) AS title, substr(text, 1, 500) AS lead, text AS body, lang AS language FROM documents"
    )  # as in the view of articles; joined by the id as it is read later, so that a grouping by it moves nothing
    times = spark.sql("SELECT CAST(event_id AS STRING) AS id, ts AS published_at FROM events")
    return said.select("*", *(c.alias(name) for name, c in of_text.items())).join(times, "id")
