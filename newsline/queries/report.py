"""Queries on the report and its spoken form."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from newsline.functions import rules
from newsline.operators import report as op
from newsline.queries.news import AGE, NOW, RULES, promotion
from newsline.registry import register

LABEL = "list_extract(['DÜŞÜNÜLEMEZ','AKUT','ŞİDDETLİ','MATERYAL','GÜNDEM','AMBİYANS'], CAST({} AS INT) + 1)"
SUFFIX = "' · ' || CASE WHEN days = 0 THEN 'bugün' WHEN days = 1 THEN 'dün' ELSE CAST(days AS STRING) || ' gün önce' END"
VIEWS = RULES + f"""
, lk AS (SELECT cluster_id, 'arc_' || lpad(CAST(CAST(substr(cluster_id, 4, 4) AS INT) * 3 % 200 AS STRING), 4, '0') AS arc_id FROM clusters)
, vw AS (SELECT h.cluster_id, CAST(h.final_severity AS INT) AS final_severity, 'head ' || h.cluster_id AS headline, h.confidence, CASE WHEN h.raw_severity % 2 = 0 THEN 'sum ' || h.cluster_id END AS summary, CASE WHEN h.raw_severity > 1 THEN 'TOPLUM' END AS category, h.ns = 0 AS is_social_only, lk.arc_id,
  CAST(greatest(coalesce(date_diff('day', CAST(coalesce(a.last_update_at, h.created_at) AS DATE), CAST({NOW} AS DATE)), 0), 0) AS INT) AS days FROM h JOIN lk USING (cluster_id) LEFT JOIN arcs a ON a.id = lk.arc_id)
, sr AS (SELECT ca.cluster_id, count(DISTINCT a.source_id) AS n_sources, string_agg(DISTINCT s.id || '/' || s.band, ',' ORDER BY s.id || '/' || s.band) AS sources FROM cluster_articles ca JOIN articles a ON a.id = ca.article_id JOIN sources s ON s.id = a.source_id GROUP BY ca.cluster_id)
"""


def views(spark: SparkSession):
    rows = promotion(spark).withColumn("headline", F.concat(F.lit("head "), "cluster_id")).withColumn("category", F.when(F.col("raw_severity") > 1, "TOPLUM")).withColumn("summary", F.when(F.col("raw_severity") % 2 == 0, F.concat(F.lit("sum "), "cluster_id")))
    arc = F.concat(F.lit("arc_"), F.lpad((F.substring("cluster_id", 4, 4).cast("int") * 3 % 200).cast("string"), 4, "0"))
    return op.report_clusters(rows.withColumn("arc_id", arc), spark.table("arcs"), F.expr(NOW))


def sources(spark: SparkSession):
    return op.cluster_sources(spark.table("cluster_articles"), spark.table("articles"), spark.table("sources"))


def arcs(spark: SparkSession):
    rows = spark.table("arcs").withColumn("headline", F.concat(F.lit("story "), "id")).withColumn("category", F.lit(None).cast("string"))
    rows = rows.withColumn("summary", F.concat(F.lit("first "), "id")).withColumn("last_update_summary", F.when(F.col("peak_severity") > 2, F.concat(F.lit("last "), "id")))
    return op.report_arcs(rows, F.lit("2024-01-11 00:00:00").cast("timestamp"), F.expr(NOW))


@register("report_clusters", VIEWS + "SELECT cluster_id, final_severity, days, CASE WHEN days >= 7 THEN 'EXPIRED' WHEN days >= 2 THEN 'DORMANT' ELSE 'FRESH' END AS freshness, is_social_only FROM vw")
def report_clusters(spark: SparkSession):
    return views(spark).select("cluster_id", "final_severity", "days", "freshness", "is_social_only")


@register("cluster_sources", VIEWS + "SELECT cluster_id, sources, n_sources FROM sr")
def cluster_sources(spark: SparkSession):
    return sources(spark).select("cluster_id", F.array_join("sources", ",").alias("sources"), "n_sources")


@register("social_only_clusters", """
, b AS (SELECT a.language, strftime(a.published_at, '%Y%m%d%H') AS hour, list(DISTINCT s.band) AS bands FROM articles a JOIN sources s ON s.id = a.source_id GROUP BY 1, 2)
SELECT language, hour, len(bands) AS n_bands, len(list_filter(bands, lambda x: x NOT IN ('social_x', 'social_reddit'))) = 0 AS is_social_only FROM b
UNION ALL SELECT 'none', s.band, 1, s.band IN ('social_x', 'social_reddit') FROM sources s GROUP BY s.band""")
def social_only_clusters(spark: SparkSession):
    """Articles of one hour and language, and each band alone."""
    rows = spark.table("articles").join(spark.table("sources").select(F.col("id").alias("source_id"), "band"), "source_id")
    grouped = rows.groupBy("language", F.date_format("published_at", "yyyyMMddHH").alias("hour")).agg(F.collect_set("band").alias("bands"))
    alone = spark.table("sources").groupBy(F.lit("none").alias("language"), F.col("band").alias("hour")).agg(F.collect_set("band").alias("bands"))
    return grouped.union(alone).select("language", "hour", F.size("bands").cast("long").alias("n_bands"), rules.social_only(F.col("bands")).alias("is_social_only"))


KEPT = "(state = 'OPEN' OR (state = 'RESOLVED' AND last_update_at >= TIMESTAMP '2024-01-11 00:00:00'))"


@register("report_arcs", f"SELECT id, state, CAST({AGE} AS INT) AS days, coalesce(CAST(last_update_at + INTERVAL 3 HOURS AS DATE) = CAST({NOW} + INTERVAL 3 HOURS AS DATE), false) AS active_today FROM arcs WHERE {KEPT}")
def report_arcs(spark: SparkSession):
    return arcs(spark).select("id", "state", "days", "active_today")


@register("failed_sources", "SELECT source_id, status FROM ingest_log WHERE run_id = 'run_20240103' AND status <> 'OK'")
def failed_sources(spark: SparkSession):
    return op.failed_sources(spark.table("ingest_log"), "run_20240103")


@register("report_header", VIEWS + "SELECT (SELECT count(*) FROM vw) AS n_clusters, (SELECT count(*) FROM vw WHERE final_severity = 5) AS n_ambient, (SELECT coalesce(min(final_severity), 5) FROM vw) AS peak, (SELECT count(*) FROM arcs WHERE state = 'OPEN') AS n_open, (SELECT count(*) FROM arcs) AS n_arcs")
def report_header(spark: SparkSession):
    return op.report_header(views(spark), spark.table("arcs"))


@register("open_arc_section", f"""
, o AS (SELECT *, {AGE} AS days FROM arcs WHERE state = 'OPEN')
, r AS (SELECT *, row_number() OVER (ORDER BY days, peak_severity, id) AS k FROM o WHERE days < 7)
SELECT CAST(k AS DOUBLE) AS rank, CASE WHEN k <= 10 THEN 'highlight' ELSE 'overflow' END AS block, '- story ' || id || ' · ' || {LABEL.format("peak_severity")} || ' · SINIFLANDIRILMADI · `' || id || '`' || {SUFFIX} AS line FROM r
UNION ALL SELECT m.* FROM (VALUES (0.0::DOUBLE, 'highlight', '### Öne Çıkanlar'), (10.5::DOUBLE, 'overflow', '### Diğer Açık Hikayeler')) m(rank, block, line) WHERE (SELECT count(*) FROM r) > 10""")
def open_arc_section(spark: SparkSession):
    return op.open_arc_lines(arcs(spark))


@register("section_lines", VIEWS + f"""
, x AS (SELECT vw.*, sr.n_sources FROM vw LEFT JOIN sr USING (cluster_id))
SELECT 3 AS section, cluster_id AS id, '- ' || headline || ' · ' || coalesce(category, 'SINIFLANDIRILMADI') || ' · (' || CAST(n_sources AS STRING) || ' kaynak) · ' || arc_id || {SUFFIX} AS line FROM x WHERE final_severity = 4
UNION ALL SELECT 4, cluster_id, '- ' || headline || ' · (yalnızca sosyal)' || {SUFFIX} FROM x WHERE final_severity BETWEEN 1 AND 4 AND is_social_only
UNION ALL SELECT 5, cluster_id, '- ' || headline || ' · (' || CAST(n_sources AS STRING) || ' kaynak)' || {SUFFIX} FROM x WHERE final_severity = 5
UNION ALL SELECT 6, id, '- story ' || id || ' · ' || {LABEL.format("peak_severity")} || ' · SINIFLANDIRILMADI · `' || id || '` · kapatıldı' FROM arcs WHERE state = 'RESOLVED' AND {KEPT}""")
def section_lines(spark: SparkSession):
    return op.section_lines(views(spark), sources(spark), arcs(spark).where("state = 'RESOLVED'")).select("section", "id", "line")


LABELLED = LABEL.format
#: The blocks of clusters and arcs.
BLOCKS = VIEWS + f"""
, cb AS (SELECT vw.*, sr.n_sources, CAST(final_severity AS STRING) || '|' || vw.cluster_id AS own, coalesce(category, 'SINIFLANDIRILMADI') AS cat, '### ' || headline AS head,
  {LABELLED("final_severity")} AS label, CASE WHEN summary IS NOT NULL THEN summary ELSE '' END AS s, replace(replace(sources, '/', '·'), ',', ' · ') AS names FROM vw LEFT JOIN sr USING (cluster_id))
, ct AS (SELECT *, head || chr(10) || '**DEFCON** · ' || label || ' · **Kategori** · ' || cat || ' · **Güven** · ' || confidence || chr(10) || '**Arc** · ' || arc_id || CASE WHEN s <> '' THEN chr(10) || chr(10) || s ELSE '' END || chr(10) || chr(10) || '**Kaynaklar** · ' || names AS fulltext,
  '#' || head || chr(10) || '**Güven** · ' || confidence || ' · **Arc** · ' || arc_id || CASE WHEN s <> '' THEN chr(10) || chr(10) || s ELSE '' END AS compact,
  head || chr(10) || 'DEFCON · ' || label || ' · Kategori · ' || cat || ' · Güven · ' || confidence || chr(10) || 'Arc · ' || arc_id || CASE WHEN s <> '' THEN chr(10) || s ELSE '' END || chr(10) || 'Kaynaklar · ' || names || CASE WHEN is_social_only THEN chr(10) || '(yalnızca sosyal · DEFCON 4 üst sınırı uygulanır)' ELSE '' END AS prompt FROM cb)
, ar AS (SELECT *, CAST({AGE} AS INT) AS days, coalesce(CAST(last_update_at + INTERVAL 3 HOURS AS DATE) = CAST({NOW} + INTERVAL 3 HOURS AS DATE), false) AS today, {LABELLED("peak_severity")} AS label FROM arcs WHERE (state = 'OPEN' OR (state = 'RESOLVED' AND last_update_at >= TIMESTAMP '2024-01-11 00:00:00')))
, ah AS (SELECT *, '### story ' || id || ' · ' || id || chr(10) || '**Açıldı** · ' || CAST(day(created_at) AS STRING) || ' ' || list_extract(['Ocak','Şubat','Mart','Nisan','Mayıs','Haziran','Temmuz','Ağustos','Eylül','Ekim','Kasım','Aralık'], CAST(month(created_at) AS INT)) || ' ' || CAST(year(created_at) AS STRING) || ' · **Zirve DEFCON** · ' || label || ' · **Kategori** · SINIFLANDIRILMADI' AS head FROM ar)
, ab AS (SELECT *, head || CASE WHEN today THEN chr(10) || chr(10) || '**Güncelleme** · ' || CASE WHEN peak_severity > 2 THEN 'last ' ELSE 'first ' END || id ELSE chr(10) || '**Son güncelleme** · ' || CAST(days AS STRING) || ' gün önce' || chr(10) || chr(10) || 'first ' || id || chr(10) || chr(10) || '*Bu arc''da bugün yeni gelişme yok.*' END AS opentext,
  head || chr(10) || chr(10) || 'first ' || id || chr(10) || chr(10) || 'Bu hikaye bugün kapatıldı.' AS closedtext, '- story ' || id || ' · ' || label || ' · SINIFLANDIRILMADI · `' || id || '`' AS bullet,
  '### story ' || id || ' · ' || id || chr(10) || 'Zirve DEFCON · ' || label || ' · Kategori · SINIFLANDIRILMADI' || chr(10) || 'first ' || id AS prompt FROM ah)
, cf AS (SELECT cat, min(own) AS first FROM ct WHERE final_severity = 3 GROUP BY cat)
, op AS (SELECT *, CASE WHEN today THEN '0' ELSE '1' END || '|' || CAST(peak_severity AS STRING) || '|' || lpad(CAST(1000000000000 - epoch_us(coalesce(last_update_at, created_at)) // 1000000 AS STRING), 13, '0') || '|' || id AS ord FROM ab WHERE state = 'OPEN')
, ok AS (SELECT *, row_number() OVER (ORDER BY ord) AS k FROM op)
, fb AS (SELECT 0 AS section, own AS rank, fulltext AS block FROM ct WHERE final_severity <= 2
  UNION ALL SELECT 1, first || '|1|' || own, compact FROM ct JOIN cf USING (cat) WHERE final_severity = 3 UNION ALL SELECT 1, first || '|0', '### ' || cat FROM cf
  UNION ALL SELECT 2, '1|' || ord, opentext FROM ok WHERE k <= 10 UNION ALL SELECT 2, '3|' || ord, bullet FROM ok WHERE k > 10
  UNION ALL SELECT 2, '0|', '### Öne Çıkanlar' FROM ok WHERE k = 1 UNION ALL SELECT 2, '2|', '### Diğer Açık Hikayeler' FROM ok WHERE k = 11
  UNION ALL SELECT 6, id, closedtext FROM ab WHERE state = 'RESOLVED')
"""


@register("fallback_sections", BLOCKS + "SELECT section, rank, block FROM fb")
def fallback_sections(spark: SparkSession):
    return op.fallback_sections(views(spark), sources(spark), arcs(spark))


RUNS = ("run_20240101", "run_20240102", "run_20240103")
#: Report lines of three runs from the same data; the second has no ambient section.
LINES = BLOCKS + f"""
, xl AS (SELECT 3 AS section, lpad(CAST(days AS STRING), 5, '0') || cluster_id AS rank, '- ' || headline || ' · ' || cat || ' · (' || CAST(n_sources AS STRING) || ' kaynak) · ' || arc_id || {SUFFIX} AS line FROM cb WHERE final_severity = 4
UNION ALL SELECT 4, lpad(CAST(days AS STRING), 5, '0') || cluster_id, '- ' || headline || ' · (yalnızca sosyal)' || {SUFFIX} FROM cb WHERE final_severity BETWEEN 1 AND 4 AND is_social_only
UNION ALL SELECT 5, lpad(CAST(days AS STRING), 5, '0') || cluster_id, '- ' || headline || ' · (' || CAST(n_sources AS STRING) || ' kaynak)' || {SUFFIX} FROM cb WHERE final_severity = 5
UNION ALL SELECT 6, lpad(CAST(days AS STRING), 5, '0') || id, '- story ' || id || ' · ' || label || ' · SINIFLANDIRILMADI · `' || id || '` · kapatıldı' FROM ar WHERE state = 'RESOLVED'
UNION ALL SELECT section, rank, block FROM fb WHERE section < 2)
, ro AS (SELECT *, row_number() OVER (ORDER BY days, peak_severity, id) AS k FROM ar WHERE state = 'OPEN' AND days < 7)
, xm AS (SELECT * FROM xl UNION ALL SELECT 2, lpad(CAST(k * 10 AS STRING), 8, '0'), '- story ' || id || ' · ' || label || ' · SINIFLANDIRILMADI · `' || id || '`' || {SUFFIX} FROM ro
UNION ALL SELECT 2, m.rank, m.line FROM (VALUES ('00000000', '### Öne Çıkanlar'), ('00000105', '### Diğer Açık Hikayeler')) m(rank, line) WHERE (SELECT count(*) FROM ro) > 10)
, xr AS (SELECT run_id, xm.* FROM xm, (VALUES {", ".join(f"('{r}')" for r in RUNS)}) u(run_id) WHERE NOT (run_id = 'run_20240102' AND section = 5))
"""
MARKERS = ", ".join(f"({i}, '{m}', '{e}')" for i, (m, e) in enumerate(zip(op.SECTIONS, op.EMPTY)))
REPORTS = LINES + f"""
, xb AS (SELECT run_id, section, string_agg(line, chr(10) ORDER BY rank, line) AS body FROM xr GROUP BY run_id, section)
, xg AS (SELECT u.run_id, t.section, t.marker || chr(10) || chr(10) || coalesce(body, note) AS part FROM (SELECT DISTINCT run_id FROM xr) u CROSS JOIN (VALUES {MARKERS}) t(section, marker, note) LEFT JOIN xb ON xb.run_id = u.run_id AND xb.section = t.section)
, rp AS (SELECT run_id, '{op.TITLE}' || chr(10) || chr(10) || string_agg(part, chr(10) || chr(10) ORDER BY section) || chr(10) AS report FROM xg GROUP BY run_id)
"""


def lines(spark: SparkSession):
    found = op.section_lines(views(spark), sources(spark), arcs(spark).where("state = 'RESOLVED'"))
    rows = found.select("section", F.concat(F.lpad(F.col("days").cast("string"), 5, "0"), "id").alias("rank"), "line")
    top = op.open_arc_lines(arcs(spark)).select(F.lit(2).alias("section"), F.lpad((F.col("rank") * 10).cast("int").cast("string"), 8, "0").alias("rank"), "line")
    worst = op.fallback_sections(views(spark), sources(spark), arcs(spark)).where("section < 2").select("section", "rank", F.col("block").alias("line"))
    runs = F.explode(F.array(*map(F.lit, RUNS))).alias("run_id")
    return rows.union(top).union(worst).select(runs, "section", "rank", "line").where("not (run_id = 'run_20240102' and section = 5)")


@register("assembled_reports", REPORTS + "SELECT run_id, report FROM rp")
def assembled_reports(spark: SparkSession):
    return op.assemble_report(lines(spark))


@register("validated_reports", REPORTS + f"""
, br AS (SELECT run_id, CASE run_id WHEN 'run_20240101' THEN replace(report, '{op.SECTIONS[6]}', '## text') WHEN 'run_20240102' THEN 'x' || replace(report, '{op.SECTIONS[5]}', '{op.SECTIONS[5]}' || chr(10) || 'Adım 1: {op.PLACEHOLDER}') ELSE replace(report, '{op.SECTIONS[7]}', '{op.SECTIONS[7]}' || chr(10) || 'GÖREV · x') END AS report FROM rp)
, bl AS (SELECT run_id, unnest(string_split(report, chr(10))) AS line, generate_subscripts(string_split(report, chr(10)), 1) AS pos FROM br)
, bn AS (SELECT *, CASE line {" ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(op.SECTIONS))} ELSE CASE WHEN line LIKE '## %' THEN -1 END END AS n FROM bl)
, ba AS (SELECT *, last_value(n IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY pos) AS own FROM bn)
, be AS (SELECT run_id, 'no_title' AS e FROM (SELECT run_id, arg_min(trim(line), pos) AS title FROM bl WHERE trim(line) <> '' GROUP BY run_id) WHERE title <> '{op.TITLE}'
UNION SELECT r.run_id, 'missing:' || CAST(t.section AS STRING) FROM rp r CROSS JOIN (VALUES {MARKERS}) t(section, marker, note) WHERE NOT EXISTS (SELECT 1 FROM bn WHERE bn.run_id = r.run_id AND bn.n = t.section)
UNION SELECT run_id, 'unexpected' FROM bn WHERE n = -1 UNION SELECT run_id, 'unmarked' FROM bn WHERE n = -1 AND line NOT LIKE '## ❯ %'
UNION SELECT run_id, 'placeholder:' || CAST(own AS STRING) FROM ba WHERE own >= 0 AND n IS NULL AND contains(line, '{op.PLACEHOLDER}')
UNION SELECT run_id, 'reasoning:' || CAST(own AS STRING) FROM ba WHERE own >= 0 AND n IS NULL AND regexp_matches(line, '^\\s*(?:Adım\\s*\\d+|Gerekçe)\\s*:')
UNION SELECT run_id, 'prompt_echo:' || CAST(own AS STRING) FROM ba WHERE own >= 0 AND n IS NULL AND contains(line, 'GÖREV ·')
UNION SELECT run_id, 'empty_section:' || CAST(own AS STRING) FROM ba WHERE own >= 0 GROUP BY run_id, own HAVING count(*) FILTER (WHERE n IS NULL AND trim(line) <> '') = 0)
SELECT r.run_id, coalesce(string_agg(e, ',' ORDER BY e), '') AS errors FROM rp r LEFT JOIN be ON be.run_id = r.run_id GROUP BY r.run_id""")
def validated_reports(spark: SparkSession):
    """Reports with a renamed section, without title and with a model's leftovers, and with an echo of the prompt."""
    behind = lambda i, text: F.replace("report", F.lit(op.SECTIONS[i]), F.lit(f"{op.SECTIONS[i]}\n{text}"))
    text = F.when(F.col("run_id") == RUNS[0], F.replace("report", F.lit(op.SECTIONS[6]), F.lit("## text"))).when(F.col("run_id") == RUNS[1], F.concat(F.lit("x"), behind(5, f"Adım 1: {op.PLACEHOLDER}"))).otherwise(behind(7, "GÖREV · x"))
    return op.validate_reports(op.assemble_report(lines(spark)).withColumn("report", text)).select("run_id", F.array_join("errors", ",").alias("errors"))


@register("system_logs", VIEWS + f"""
, hd AS (SELECT (SELECT count(*) FROM vw) AS n_clusters, (SELECT coalesce(min(final_severity), 5) FROM vw) AS peak, (SELECT count(*) FROM arcs WHERE state = 'OPEN') AS n_open, (SELECT count(*) FROM arcs) AS n_arcs)
SELECT r.run_id, '**Run** · `' || r.run_id || '`' || chr(10) || '**Çalıştırılan aşamalar** · ' || CASE WHEN CAST(right(r.run_id, 2) AS INT) % 3 = 0 THEN '(yok)' ELSE 'ingest · score' END || chr(10) || '**İşlenen olay** · ' || CAST(n_clusters AS STRING) || chr(10) || '**Açık hikaye** · ' || CAST(n_open AS STRING) || chr(10) || '**Toplam arc** · ' || CAST(n_arcs AS STRING) || chr(10) || '**Zirve DEFCON** · ' || CAST(peak AS STRING) || chr(10) ||
'**Başarısız kaynak** · ' || coalesce((SELECT string_agg(l.source_id || ' (' || l.status || ')', ' · ' ORDER BY l.source_id || ' (' || l.status || ')') FROM ingest_log l WHERE l.run_id = r.run_id AND l.status <> 'OK'), '(yok)') ||
CASE WHEN CAST(right(r.run_id, 2) AS INT) % 2 = 0 THEN chr(10) || '**Başarısız bölüm üretimi** · {op.SECTIONS[0][5:]} · {op.SECTIONS[1][5:]}' ELSE '' END AS text FROM pipeline_runs r, hd""")
def system_logs(spark: SparkSession):
    day = F.expr("right(run_id, 2)").cast("int")
    runs = spark.table("pipeline_runs").select("run_id", F.when(day % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("ingest"), F.lit("score"))).alias("stages_done"))
    header = runs.select("run_id").crossJoin(F.broadcast(op.report_header(views(spark), spark.table("arcs"))))
    lost = runs.where(day % 2 == 0).select("run_id", F.explode(F.array(F.lit(1), F.lit(0))).alias("section"))
    return op.system_log(runs, header, spark.table("ingest_log").where("status <> 'OK'"), lost)


@register("section_prompts", BLOCKS + f"""
, sd AS (SELECT 0 AS section, own AS rank, prompt AS line FROM ct WHERE final_severity <= 2 UNION ALL SELECT 1, first || '|1|' || own, prompt FROM ct JOIN cf USING (cat) WHERE final_severity = 3 UNION ALL SELECT 1, first || '|0', '### ' || cat FROM cf
UNION ALL SELECT 2, CAST(peak_severity AS STRING) || '|' || id, prompt FROM ab WHERE state = 'OPEN' UNION ALL SELECT 3, own, '- ' || headline || ' · ' || cat || ' · (' || CAST(n_sources AS STRING) || ' kaynak) · ' || arc_id FROM ct WHERE final_severity = 4
UNION ALL SELECT 4, own, '- ' || headline FROM ct WHERE final_severity <= 4 AND is_social_only UNION ALL SELECT 5, own, '- ' || headline || ' · (' || CAST(n_sources AS STRING) || ' kaynak)' FROM ct WHERE final_severity = 5
UNION ALL SELECT 6, CAST(peak_severity AS STRING) || '|' || id, prompt FROM ab WHERE state = 'RESOLVED')
, sb AS (SELECT section, string_agg(line, chr(10) ORDER BY rank) AS body FROM sd GROUP BY section)
SELECT 'run_20240103' AS run_id, t.section, 'Bölüm: ' || t.marker || chr(10) || chr(10) || 'Kısa yaz.' || chr(10) || chr(10) || 'BÖLÜM VERİSİ:' || chr(10) || coalesce(body, note) AS prompt FROM (VALUES {MARKERS}) t(section, marker, note) LEFT JOIN sb USING (section) WHERE t.section < 7""")
def section_prompts(spark: SparkSession):
    data = op.section_data(views(spark), sources(spark), arcs(spark)).select(F.lit(RUNS[2]).alias("run_id"), "section", "rank", "line")
    return op.section_prompts(data, "Kısa yaz.")


#: Reports for the voice: with sources, a stalled mark, and bullets that are all dormant under a subheader.
VOICED = REPORTS + f"""
, vr AS (SELECT run_id, replace(replace(report, '{op.SECTIONS[2]}', '{op.SECTIONS[2]}' || chr(10) || '{op.STALLED.replace("'", "''")}' || chr(10) || '### Eski' || chr(10) || chr(10) || '- a · `arc_20240101_0012` · 5 gün önce' || chr(10) || '- b · `arc_20240101_0013` · 2 gün önce' || chr(10) || '[bağ](http://x) *eğik* DEFCON · 3 TBMM'),
  '{op.SECTIONS[1]}', '{op.SECTIONS[1]}' || chr(10) || '**Kaynaklar** · x') AS report FROM rp)
, vl AS (SELECT run_id, unnest(string_split(report, chr(10))) AS line, generate_subscripts(string_split(report, chr(10)), 1) - 1 AS pos FROM vr)
, vn AS (SELECT *, coalesce(last_value(CASE trim(line) {" ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(op.SECTIONS))} END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY pos), -1) AS section FROM vl)
, vo AS (SELECT *, max(CASE WHEN line = '{op.OVERFLOW}' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, section ORDER BY pos) AS over_ FROM vn)
, vs AS (SELECT run_id, pos, section, line FROM vo WHERE section IN (-1, 0, 1, 2, 7) AND NOT (section = 1 AND regexp_matches(line, '^\\*?\\*?Kaynaklar\\*?\\*?\\s*[·:]')) AND NOT (section = 2 AND (over_ = 1 OR trim(line) = '{op.STALLED.replace("'", "''")}')))
"""


def voiced(spark: SparkSession):
    extra = f"{op.SECTIONS[2]}\n{op.STALLED}\n### Eski\n\n- a · `arc_20240101_0012` · 5 gün önce\n- b · `arc_20240101_0013` · 2 gün önce\n[bağ](http://x) *eğik* DEFCON · 3 TBMM"
    report = F.replace(F.replace("report", F.lit(op.SECTIONS[2]), F.lit(extra)), F.lit(op.SECTIONS[1]), F.lit(f"{op.SECTIONS[1]}\n**Kaynaklar** · x"))
    return op.voiced_scope(op.assemble_report(lines(spark)).withColumn("report", report))


@register("voiced_lines", VOICED + "SELECT run_id, CAST(pos AS INT) AS pos, CAST(section AS INT) AS section, line FROM vs")
def voiced_lines(spark: SparkSession):
    return voiced(spark)


def _spoken_sql() -> str:
    """The rewriting of the voice's text in DuckDB, nested in order."""
    text = "text"
    for pattern, to in (*op.SPOKEN, *((rf"\b{a}\b", b) for a, b in op.ABBREVIATIONS), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
        text = f"regexp_replace({text}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return text


@register("spoken_reports", VOICED + f"""
, p1 AS (SELECT *, regexp_matches(line, '·\\s*\\d+\\s+gün\\s+önce\\s*$') AS d, trim(line) <> '' AS solid, regexp_matches(line, '^\\s*-\\s.*`[^`]+`') AND regexp_matches(line, '·\\s*(?:\\d+\\s+gün\\s+önce|bugün|dün)\\s*$') AS b FROM vs)
, p2 AS (SELECT *, sum(CASE WHEN b THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY pos) AS g FROM p1)
, p3 AS (SELECT *, b AND count(*) FILTER (WHERE NOT d) OVER (PARTITION BY run_id, g, b) = 0 AS quiet, pos = min(pos) OVER (PARTITION BY run_id, g, b) AS first FROM p2)
, p4 AS (SELECT *, first_value(CASE WHEN solid THEN quiet END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS bef FROM p3)
, p5 AS (SELECT run_id, pos, solid, CASE WHEN quiet THEN '{op.DORMANT_NOTE}' ELSE line END AS line FROM p4 WHERE NOT ((b AND d AND NOT (quiet AND first)) OR (NOT b AND coalesce(bef, false) AND (NOT solid OR regexp_matches(line, '^\\s*#{{2,6}}\\s')))))
, p6 AS (SELECT *, last_value(CASE WHEN solid THEN line END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM p5)
, p7 AS (SELECT run_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM p6 WHERE NOT (line = '{op.DORMANT_NOTE}' AND coalesce(last = '{op.DORMANT_NOTE}', false)) GROUP BY run_id)
SELECT run_id, {_spoken_sql()} AS text FROM p7""")
def spoken_reports(spark: SparkSession):
    return op.speech_text(voiced(spark))
