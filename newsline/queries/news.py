"""Queries on stories, their severity and arcs."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from newsline.functions import rules
from newsline.functions.text import embedding_input, word_count
from newsline.operators import arcs as arc_op
from newsline.operators import linking, scoring, stories
from newsline.operators import vectors as vec
from newsline.plans.adapters import articles_with
from newsline.plans.storage import materialize
from newsline.registry import register

NOW = "TIMESTAMP '2024-01-12 22:30:00'"
TOUCHED = "SELECT DISTINCT source_id FROM ingest_log WHERE run_id = 'run_20240103'"
WORDS = "len(list_filter(string_split_regex(body, '\\s+'), lambda x: x <> ''))"
EVIDENCE = """
, e AS (SELECT ca.cluster_id, list_sort(list(DISTINCT s.band)) AS bands, count(*) AS n FROM cluster_articles ca JOIN articles a ON a.id = ca.article_id LEFT JOIN sources s ON s.id = a.source_id GROUP BY ca.cluster_id)"""
RULES = EVIDENCE + """
, f AS (SELECT *, list_has_any(bands, ['primary_gov','primary_market','primary_judicial']) AS prim, len(list_filter(bands, lambda x: x NOT IN ('social_x','social_reddit'))) AS ns,
CAST(list_contains(bands, 'gov_aligned') AS INT) + CAST(list_contains(bands, 'opposition') AS INT) + CAST(list_has_any(bands, ['centrist','independent','international']) AS INT) AS sides FROM e)
, g AS (SELECT c.cluster_id, c.created_at, c.raw_severity, f.bands, f.n, f.sides, f.prim, f.ns,
CASE WHEN prim THEN 0 WHEN ns = 0 THEN 4 WHEN ns >= 3 AND sides >= 2 THEN 1 WHEN ns >= 2 THEN 3 ELSE 4 END AS ceiling,
CASE WHEN prim THEN 'primary' WHEN ns = 0 THEN 'social_only' WHEN ns >= 3 AND sides >= 2 THEN 'three_bands_two_sides' WHEN ns >= 2 THEN 'two_bands' ELSE 'single_band' END AS rule_applied,
CASE WHEN prim OR (sides >= 2 AND n >= 4) THEN 'YÜKSEK' WHEN sides >= 2 OR n >= 3 THEN 'ORTA' ELSE 'DÜŞÜK' END AS confidence FROM clusters c JOIN f USING (cluster_id))
, h AS (SELECT *, CASE WHEN created_at < (SELECT min(started_at) FROM pipeline_runs) + INTERVAL 7 DAYS THEN least(greatest(raw_severity, ceiling) + 1, 5) ELSE greatest(raw_severity, ceiling) END AS final_severity FROM g)
"""


@register("eligible_articles", f"""
SELECT a.id, coalesce(s.band, '') AS band, a.language, {WORDS} AS word_count FROM articles a LEFT JOIN sources s ON s.id = a.source_id WHERE a.source_id IN ({TOUCHED}) AND CAST(a.id AS BIGINT) % 3 <> 0""")
def eligible_articles(spark: SparkSession):
    rows = articles_with(spark, word_count=word_count(F.col("body")))
    return stories.eligible_articles(rows, spark.table("sources"), rows.where("CAST(id AS BIGINT) % 3 = 0"), spark.sql(TOUCHED)).select("id", "band", "language", "word_count")


def _roles(spark: SparkSession):
    return stories.length_gate(articles_with(spark, word_count=word_count(F.col("body"))))


@register("article_roles", f"SELECT id, CASE WHEN {WORDS} < 10 THEN 'skip' WHEN {WORDS} < 30 THEN 'join' ELSE 'seed' END AS role FROM articles")
def article_roles(spark: SparkSession):
    return _roles(spark).select("id", "role")


def _stories(spark: SparkSession):
    """(articles with their roles, their stories); the texts are read once."""
    rows = articles_with(spark, word_count=word_count(F.col("body")), bow=vec.bow_of(embedding_input(F.col("title"), F.col("lead"))))
    rows = materialize(stories.length_gate(rows).select("id", "language", "published_at", "role", "bow.idx", "bow.weight"), "roles")
    return rows, stories.cluster_stories(rows, threshold=0.7)


@register("clustered_stories")
def clustered_stories(spark: SparkSession):
    return _stories(spark)[1]


@register("story_counts")
def story_counts(spark: SparkSession):
    return stories.run_counts(*_stories(spark))


@register("minted_ids", """
, r AS (SELECT cluster_id, strftime(created_at, '%Y%m%d') AS d, row_number() OVER (PARTITION BY strftime(created_at, '%Y%m%d') ORDER BY created_at, cluster_id) AS n FROM clusters)
SELECT cluster_id, 'cl_' || d || '_' || CASE WHEN length(CAST(n + CASE WHEN d = '20240101' THEN 9998 ELSE 0 END AS STRING)) < 4 THEN lpad(CAST(n AS STRING), 4, '0') ELSE CAST(n + CASE WHEN d = '20240101' THEN 9998 ELSE 0 END AS STRING) END AS new_id FROM r""")
def minted_ids(spark: SparkSession):
    taken = spark.sql("SELECT 'cl_20240101_9998' AS id UNION ALL SELECT 'cl_20240101_0007'")
    return stories.mint_ids(spark.table("clusters"), "cl", "created_at", ["created_at", "cluster_id"], taken).select("cluster_id", "new_id")


@register("cluster_tables", """
, e AS (SELECT ca.cluster_id, min(a.published_at) AS created_at, list_sort(list(DISTINCT s.band)) AS bands, count(*) AS n FROM cluster_articles ca JOIN articles a ON a.id = ca.article_id LEFT JOIN sources s ON s.id = a.source_id GROUP BY ca.cluster_id)
SELECT cluster_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, array_to_string(bands, ',') AS bands, n AS n_articles FROM e""")
def cluster_tables(spark: SparkSession):
    found = stories.cluster_tables(spark.table("cluster_articles"), spark.table("articles"), spark.table("sources"))
    return found.select("cluster_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.array_join("bands", ",").alias("bands"), "n_articles")


#: Stories as a clustering gives them: each article with its story's first one.
STORIES = "SELECT article_id AS id, first_value(article_id) OVER (PARTITION BY cluster_id ORDER BY published_at, CAST(article_id AS BIGINT)) AS story FROM (SELECT ca.*, a.published_at FROM cluster_articles ca JOIN articles a ON a.id = ca.article_id)"
STORY_IDS = f"""
, st AS ({STORIES})
, sd AS (SELECT DISTINCT st.story, a.published_at FROM st JOIN articles a ON a.id = st.story)
, si AS (SELECT story, 'cl_' || strftime(published_at, '%Y%m%d') || '_' || lpad(CAST(row_number() OVER (PARTITION BY strftime(published_at, '%Y%m%d') ORDER BY published_at, story) AS STRING), 4, '0') AS cluster_id FROM sd)
, sm AS (SELECT si.cluster_id, st.id AS article_id FROM st JOIN si USING (story))
"""


def _story_tables(spark: SparkSession):
    vectors = spark.table("embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))
    return stories.story_tables(spark.table("articles"), spark.table("sources"), spark.sql(STORIES), vectors)


@register("story_members", STORY_IDS + "SELECT cluster_id, article_id FROM sm")
def story_members(spark: SparkSession):
    return _story_tables(spark)[1]


@register("story_centroids", STORY_IDS + """
, v AS (SELECT cluster_id, unnest(x.embedding) AS x, generate_subscripts(x.embedding, 1) - 1 AS i FROM sm JOIN embeddings x ON CAST(x.vec_id AS STRING) = article_id)
SELECT cluster_id, CAST(i AS INT) AS i, round(avg(CAST(x AS DOUBLE)), 6) AS x FROM v GROUP BY cluster_id, i""")
def story_centroids(spark: SparkSession):
    return _story_tables(spark)[2].select("cluster_id", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 6))


@register("unscored_clusters", f"SELECT cluster_id FROM clusters c WHERE raw_severity <> 3 AND EXISTS (SELECT 1 FROM cluster_articles ca JOIN articles a ON a.id = ca.article_id WHERE ca.cluster_id = c.cluster_id AND a.source_id IN ({TOUCHED}))")
def unscored_clusters(spark: SparkSession):
    rows = spark.table("clusters").withColumn("final_severity", F.when(F.col("raw_severity") == 3, 3))
    return scoring.unscored(rows, spark.table("cluster_articles"), spark.table("articles"), spark.table("ingest_log"), "run_20240103").select("cluster_id")


@register("cluster_evidence", EVIDENCE + "SELECT cluster_id, array_to_string(bands, ',') AS bands, n AS n_articles FROM e")
def cluster_evidence(spark: SparkSession):
    return scoring.evidence(spark.table("cluster_articles"), spark.table("articles"), spark.table("sources")).withColumn("bands", F.array_join("bands", ","))


@register("classification_prompts", """
, r AS (SELECT ca.cluster_id, a.published_at, a.id, s.band, a.title, a.lead, row_number() OVER (PARTITION BY ca.cluster_id ORDER BY a.published_at, a.id) AS i FROM cluster_articles ca JOIN articles a ON a.id = ca.article_id LEFT JOIN sources s ON s.id = a.source_id)
SELECT cluster_id, 'Severity: 0 worst to 5 mildest.' || chr(10) || 'Categories: POLİTİKA, EKONOMİ, YARGI, GÜVENLİK, DİPLOMASİ, MEVZUAT, TOPLUM, SINIFLANDIRILMADI' || chr(10) || chr(10) || 'Sources:' || chr(10) ||
string_agg('[' || CAST(i AS STRING) || '] ' || coalesce(band, '') || ' | ' || coalesce(title, '') || chr(10) || coalesce(lead, ''), chr(10) || chr(10) ORDER BY i) AS prompt FROM r GROUP BY cluster_id""")
def classification_prompts(spark: SparkSession):
    return scoring.classification_prompts(scoring.evidence_list(spark.table("cluster_articles"), spark.table("articles"), spark.table("sources")))


ANSWERS = """
SELECT event_id, concat('k', CAST(user_id AS STRING)) AS cluster_id, event_id % 3 AS attempt, CASE event_id % 4
WHEN 0 THEN concat('{"defcon": ', CAST(user_id % 6 AS STRING), ', "category": "ekonomi", "confidence_self": "high", "entities": ["a"], "summary": "s", "headline": "h', CAST(event_id AS STRING), '"}')
WHEN 1 THEN concat('```json\n{"defcon": 2, "category": "GUVENLIK", "confidence_self": "low", "summary": "s", "headline": "h', CAST(event_id AS STRING), '"}\n```')
WHEN 2 THEN '{"defcon": 9, "category": "YARGI", "confidence_self": "low", "summary": "s", "headline": "h"}' ELSE 'no answer {' END AS response FROM events"""
ANSWERED = """
, r AS (SELECT event_id, 'k' || CAST(user_id AS STRING) AS cluster_id, event_id % 3 AS attempt, event_id % 4 AS k, user_id FROM events)"""


@register("parsed_answers", ANSWERED + "SELECT event_id, CASE k WHEN 2 THEN 'bad_severity' WHEN 3 THEN 'no_json' END AS reason, CAST(CASE k WHEN 0 THEN user_id % 6 WHEN 1 THEN 2 ELSE -1 END AS INT) AS severity, CASE k WHEN 0 THEN 'EKONOMİ' WHEN 1 THEN 'GÜVENLİK' END AS category FROM r")
def parsed_answers(spark: SparkSession):
    return scoring.parse_responses(spark.sql(ANSWERS)).select("event_id", "reason", F.coalesce("parsed.severity", F.lit(-1)).alias("severity"), "parsed.category")


@register("picked_answers", ANSWERED + """
, v AS (SELECT cluster_id, event_id, k, user_id, row_number() OVER (PARTITION BY cluster_id ORDER BY attempt, event_id) AS n FROM r WHERE k < 2)
SELECT c.cluster_id, CAST(CASE v.k WHEN 0 THEN user_id % 6 WHEN 1 THEN 2 ELSE 5 END AS INT) AS severity, CASE v.k WHEN 0 THEN 'EKONOMİ' WHEN 1 THEN 'GÜVENLİK' ELSE 'SINIFLANDIRILMADI' END AS category,
coalesce('h' || CAST(event_id AS STRING), '(başlıksız)') AS headline, v.cluster_id IS NULL AS fell_back FROM (SELECT DISTINCT cluster_id FROM r) c LEFT JOIN v ON v.cluster_id = c.cluster_id AND v.n = 1""")
def picked_answers(spark: SparkSession):
    """Answers in order of attempt; the events of one attempt are numbered apart by their ids."""
    rows = spark.sql(ANSWERS).withColumn("attempt", F.struct("attempt", "event_id"))
    return scoring.pick_response(rows, max_retries=None)


@register("normalized_categories", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'DİPLOMASİ' WHEN 1 THEN 'TOPLUM' ELSE event_type END AS category FROM events")
def normalized_categories(spark: SparkSession):
    text = F.when(F.col("event_id") % 3 == 0, "diplomasi").when(F.col("event_id") % 3 == 1, "Toplum").otherwise(F.col("event_type"))
    return spark.table("events").select("event_id", scoring.normalize_category(text).alias("category"))


def promotion(spark: SparkSession):
    found = scoring.evidence(spark.table("cluster_articles"), spark.table("articles"), spark.table("sources"))
    return scoring.promotion_log(spark.table("clusters"), found, spark.table("pipeline_runs"))


@register("promotion_log", RULES + "SELECT cluster_id, CAST(raw_severity AS INT) AS raw_severity, CAST(ceiling AS INT) AS ceiling, CAST(final_severity AS INT) AS final_severity, array_to_string(bands, ',') AS bands, CAST(sides AS INT) AS n_sides, confidence, rule_applied FROM h")
def promotion_log(spark: SparkSession):
    return promotion(spark).select("cluster_id", "raw_severity", "ceiling", "final_severity", F.array_join("bands", ",").alias("bands"), F.size("sides").alias("n_sides"), "confidence", "rule_applied")


@register("story_board", RULES + "SELECT cluster_id, CAST(final_severity AS INT) AS final_severity, confidence, rule_applied, CASE WHEN ns = 0 THEN true ELSE false END AS is_social_only, n AS n_articles FROM h")
def story_board(spark: SparkSession):
    return promotion(spark).select("cluster_id", "final_severity", "confidence", "rule_applied", rules.social_only(F.col("bands")).alias("is_social_only"), "n_articles")


@register("active_arcs", f"SELECT id, peak_severity FROM arcs WHERE state IN ('OPEN','WATCH') AND (last_update_at IS NULL OR last_update_at >= {NOW} - INTERVAL 30 DAYS) AND CAST(substr(id, 5) AS INT) % 4 <> 0")
def active_arcs(spark: SparkSession):
    rows = spark.table("arcs")
    return arc_op.active_arcs(rows, rows.where("CAST(substr(id, 5) AS INT) % 4 <> 0").select("id"), F.expr(NOW)).select("id", "peak_severity")


@register("linkable_clusters", RULES + f"SELECT cluster_id, CAST(final_severity AS INT) AS final_severity FROM h WHERE n > 3 AND cluster_id IN (SELECT ca.cluster_id FROM cluster_articles ca JOIN articles a ON a.id = ca.article_id WHERE a.source_id IN ({TOUCHED}))")
def linkable_clusters(spark: SparkSession):
    rows = promotion(spark).withColumn("headline", F.when(F.col("n_articles") > 3, "h").otherwise(" ")).withColumn("arc_id", F.lit(None).cast("string"))
    touched = spark.table("cluster_articles").join(spark.table("articles").select(F.col("id").alias("article_id"), "source_id"), "article_id").join(spark.sql(TOUCHED), "source_id").select("cluster_id")
    return arc_op.linkable_clusters(rows, touched).select("cluster_id", "final_severity")


def _entities(spark: SparkSession):
    """Names of the stories: the source of each member and its kind."""
    rows = spark.table("cluster_articles").join(spark.table("articles").select(F.col("id").alias("article_id"), "source_id", "language"), "article_id")
    return arc_op.cluster_entities(spark.table("cluster_articles"), rows.select("article_id", F.explode(F.array("source_id", "language", F.lit("Türkiye"))).alias("entity")))


ENTITIES = """
, n AS (SELECT DISTINCT ca.cluster_id, unnest([a.source_id, a.language]) AS e FROM cluster_articles ca JOIN articles a ON a.id = ca.article_id)
"""


@register("cluster_entities", ENTITIES + "SELECT cluster_id, string_agg(DISTINCT e, ',' ORDER BY e) AS entities FROM n GROUP BY cluster_id")
def cluster_entities(spark: SparkSession):
    return _entities(spark).select("cluster_id", F.array_join(F.sort_array(arc_op.drop_stop_entities(F.col("entities"))), ",").alias("entities"))


def _sides(spark: SparkSession):
    """Stories and arcs with entities and vectors: odd and even stories of the given clusters."""
    rows = _entities(spark).withColumn("entities", arc_op.drop_stop_entities(F.col("entities")))
    members = spark.table("cluster_articles").join(spark.table("embeddings").select(F.col("vec_id").cast("string").alias("article_id"), "embedding"), "article_id")
    rows = rows.join(vec.centroid(members, "cluster_id", "embedding").withColumnRenamed("centroid", "vector"), "cluster_id")
    even = F.substring("cluster_id", -1, 1).cast("int") % 2 == 0
    return rows.where(~even), rows.where(even).withColumnRenamed("cluster_id", "id")


@register("matched_arcs", ENTITIES + """
, v AS (SELECT ca.cluster_id, unnest(x.embedding) AS x, generate_subscripts(x.embedding, 1) AS i FROM cluster_articles ca JOIN embeddings x ON CAST(x.vec_id AS STRING) = ca.article_id)
, m AS (SELECT cluster_id, i, avg(CAST(x AS DOUBLE)) AS x FROM v GROUP BY cluster_id, i)
, z AS (SELECT cluster_id, sqrt(sum(x * x)) AS z FROM m GROUP BY cluster_id)
, s AS (SELECT a.cluster_id, b.cluster_id AS arc_id, count(*) AS k FROM n a JOIN n b ON a.e = b.e GROUP BY ALL)
, c AS (SELECT cluster_id, count(*) AS c FROM n GROUP BY cluster_id)
, j AS (SELECT s.cluster_id, s.arc_id, k / (p.c + q.c - k) AS jaccard FROM s JOIN c p ON p.cluster_id = s.cluster_id JOIN c q ON q.cluster_id = s.arc_id WHERE CAST(right(s.cluster_id, 1) AS INT) % 2 = 1 AND CAST(right(s.arc_id, 1) AS INT) % 2 = 0)
, d AS (SELECT j.cluster_id, j.arc_id, j.jaccard, sum(a.x * b.x) / any_value(p.z) / any_value(q.z) AS cosine FROM j JOIN m a ON a.cluster_id = j.cluster_id JOIN m b ON b.cluster_id = j.arc_id AND b.i = a.i JOIN z p ON p.cluster_id = j.cluster_id JOIN z q ON q.cluster_id = j.arc_id GROUP BY j.cluster_id, j.arc_id, j.jaccard)
, r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY cosine DESC, arc_id) AS n FROM d WHERE cosine >= 0.05 AND jaccard >= 0.2)
SELECT cluster_id, arc_id, round(cosine, 6) AS cosine, round(jaccard, 6) AS jaccard FROM r WHERE n = 1""")
def matched_arcs(spark: SparkSession):
    found = arc_op.match_arcs(*_sides(spark), 0.05, 0.2)
    return found.select("cluster_id", "arc_id", F.round("cosine", 6).alias("cosine"), F.round("jaccard", 6).alias("jaccard"))


@register("linked_arcs")
def linked_arcs(spark: SparkSession):
    clusters, arcs = _sides(spark)
    clusters = clusters.join(spark.table("clusters").select("cluster_id", "created_at", F.col("raw_severity").alias("severity")), "cluster_id")
    return linking.link_arcs(clusters, arcs.withColumn("n", F.lit(1)), 0.05, 0.2)


LINKED = "SELECT concat('arc_', lpad(CAST(CAST(substr(cluster_id, 4, 4) AS INT) * 3 % 150 AS STRING), 4, '0')) AS arc_id, cluster_id, created_at, raw_severity AS severity, CASE WHEN raw_severity = 2 THEN ' ' ELSE concat('head ', cluster_id) END AS headline FROM clusters"


@register("folded_arcs", f"""
, l AS (SELECT *, row_number() OVER (PARTITION BY arc_id ORDER BY severity DESC, cluster_id DESC) AS k FROM ({LINKED}))
, m AS (SELECT arc_id, min(severity) AS low, count(*) AS n FROM l GROUP BY arc_id)
SELECT a.id, CASE WHEN m.n IS NOT NULL AND a.state = 'WATCH' THEN 'OPEN' ELSE a.state END AS state, CAST(least(a.peak_severity, m.low) AS INT) AS peak_severity, l.cluster_id AS last_cluster_id, coalesce(m.n, 0) AS n_linked,
coalesce(epoch_us(coalesce(l.created_at, a.last_update_at)), 0) AS last_us FROM arcs a LEFT JOIN m ON m.arc_id = a.id LEFT JOIN l ON l.arc_id = a.id AND l.k = 1""")
def folded_arcs(spark: SparkSession):
    linked = spark.sql(LINKED).withColumn("seq", F.struct("severity", "cluster_id"))
    return arc_op.fold_arc_updates(spark.table("arcs"), linked).select("id", "state", "peak_severity", "last_cluster_id", "n_linked", F.coalesce(F.unix_micros(F.col("last_update_at").cast("timestamp")), F.lit(0)).alias("last_us"))


@register("folded_arc_state", f"""
, l AS (SELECT *, row_number() OVER (PARTITION BY arc_id ORDER BY severity DESC, cluster_id DESC) AS k FROM ({LINKED}))
, n AS (SELECT id, state AS e FROM arcs UNION SELECT arc_id, 'e' || CAST(severity AS STRING) FROM l UNION SELECT arc_id, right(cluster_id, 1) FROM l)
, m AS (SELECT arc_id, avg(severity) AS x, avg(CAST(right(cluster_id, 1) AS INT)) AS y FROM l GROUP BY arc_id)
SELECT a.id, (SELECT string_agg(e, ',' ORDER BY e) FROM n WHERE n.id = a.id) AS entities, round(coalesce(m.x, -1.0), 6) AS x, round(coalesce(m.y, -2.0), 6) AS y, 'sum ' || l.cluster_id AS last_summary FROM arcs a LEFT JOIN m ON m.arc_id = a.id LEFT JOIN l ON l.arc_id = a.id AND l.k = 1""")
def folded_arc_state(spark: SparkSession):
    rows = spark.table("arcs").select("id", F.array("state").alias("entities"), F.array(F.lit(-1.0), F.lit(-2.0)).alias("centroid"))
    linked = spark.sql(LINKED).select(
        "arc_id", F.array(F.concat(F.lit("e"), F.col("severity").cast("string")), F.expr("right(cluster_id, 1)")).alias("entities"),
        F.array(F.col("severity").cast("double"), F.expr("right(cluster_id, 1)").cast("double")).alias("vector"), F.concat(F.lit("sum "), "cluster_id").alias("summary"), F.struct("severity", "cluster_id").alias("seq"),
    )
    found = arc_op.fold_arc_state(rows, linked)
    return found.select("id", F.array_join("entities", ",").alias("entities"), F.round(F.col("centroid")[0], 6).alias("x"), F.round(F.col("centroid")[1], 6).alias("y"), "last_summary")


@register("resolved_arcs", f"SELECT id, CASE WHEN state IN ('OPEN','WATCH') AND CAST(last_update_at AS DATE) <= CAST({NOW} + INTERVAL 3 HOURS AS DATE) - 7 THEN 'RESOLVED' ELSE state END AS state FROM arcs")
def resolved_arcs(spark: SparkSession):
    return arc_op.resolve_expired(spark.table("arcs"), F.expr(NOW)).select("id", "state")


AGE = f"greatest(coalesce(date_diff('day', CAST(last_update_at AS DATE), CAST({NOW} AS DATE)), 0), 0)"


@register("arc_freshness", f"SELECT id, CAST({AGE} AS INT) AS days, CASE WHEN {AGE} >= 7 THEN 'EXPIRED' WHEN {AGE} >= 2 THEN 'DORMANT' ELSE 'FRESH' END AS freshness, CASE WHEN {AGE} = 0 THEN 'bugün' WHEN {AGE} = 1 THEN 'dün' ELSE CAST({AGE} AS STRING) || ' gün önce' END AS label FROM arcs")
def arc_freshness(spark: SparkSession):
    days = rules.days_since(F.col("last_update_at"), F.expr(NOW))
    return spark.table("arcs").select("id", days.alias("days"), rules.freshness(days).alias("freshness"), rules.recency_label(days).alias("label"))


@register("backfilled_arcs", f"""
, l AS (SELECT *, row_number() OVER (PARTITION BY arc_id ORDER BY created_at DESC, cluster_id DESC) AS k FROM ({LINKED}))
SELECT a.id, l.cluster_id AS last_cluster_id, epoch_us(coalesce(a.last_update_at, l.created_at, a.created_at)) AS last_us FROM arcs a LEFT JOIN l ON l.arc_id = a.id AND l.k = 1""")
def backfilled_arcs(spark: SparkSession):
    return arc_op.backfill_latest_cluster(spark.table("arcs"), spark.sql(LINKED)).select("id", "last_cluster_id", F.unix_micros(F.col("last_update_at").cast("timestamp")).alias("last_us"))


@register("arc_audit", f"SELECT id, 'no_centroid' AS problem FROM arcs WHERE CAST(substr(id, 5) AS INT) % 4 = 0 UNION ALL SELECT id, 'no_clusters' FROM arcs WHERE id NOT IN (SELECT arc_id FROM ({LINKED}))")
def arc_audit(spark: SparkSession):
    rows = spark.table("arcs")
    return arc_op.audit_arcs(rows, rows.where("CAST(substr(id, 5) AS INT) % 4 <> 0").select("id"), spark.sql(LINKED))


@register("repaired_headlines", f"""
, l AS (SELECT *, row_number() OVER (PARTITION BY arc_id ORDER BY created_at, cluster_id) AS k FROM ({LINKED}) WHERE trim(headline) <> '')
, s AS (SELECT *, row_number() OVER (PARTITION BY arc_id ORDER BY created_at, cluster_id) AS k FROM ({LINKED}) WHERE severity > 3)
SELECT a.id, coalesce(CASE WHEN peak_severity > 2 THEN a.id END, l.headline, '(başlıksız)') AS headline, coalesce(CASE WHEN peak_severity < 2 THEN 'own' END, 'sum ' || s.cluster_id, '(başlıksız)') AS summary
FROM arcs a LEFT JOIN l ON l.arc_id = a.id AND l.k = 1 LEFT JOIN s ON s.arc_id = a.id AND s.k = 1""")
def repaired_headlines(spark: SparkSession):
    rows = spark.table("arcs").withColumn("headline", F.when(F.col("peak_severity") > 2, F.col("id")).otherwise(" ")).withColumn("summary", F.when(F.col("peak_severity") < 2, "own"))
    linked = spark.sql(LINKED).withColumn("summary", F.when(F.col("severity") > 3, F.concat(F.lit("sum "), "cluster_id")))
    return arc_op.repair_headlines(rows, linked).select("id", "headline", "summary")
