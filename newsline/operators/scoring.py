"""Evidence, model answers and severity of stories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsline.functions import rules
from newsline.functions.text import fold_key

# The categories.
CATEGORIES = ("POLİTİKA", "EKONOMİ", "YARGI", "GÜVENLİK", "DİPLOMASİ", "MEVZUAT", "TOPLUM", "SINIFLANDIRILMADI")
RESPONSE = "defcon double, category string, confidence_self string, entities array<string>, summary string, headline string"


def unscored(clusters: DataFrame, members: DataFrame, articles: DataFrame, log: DataFrame, run_id: str) -> DataFrame:
    """Clusters without final severity that have an article of a source of this run."""
    touched = log.where(F.col("run_id") == run_id).select("source_id").distinct()
    ids = members.join(articles.select(F.col("id").alias("article_id"), "source_id"), "article_id").join(touched, "source_id", "left_semi").select("cluster_id").distinct()
    return clusters.where("final_severity is null").join(ids, "cluster_id", "left_semi")


def evidence(members: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(cluster_id, bands, n_articles): sorted distinct non-empty bands and member count."""
    rows = members.join(articles.select(F.col("id").alias("article_id"), "source_id"), "article_id").join(sources.select(F.col("id").alias("source_id"), "band"), "source_id", "left")
    return rows.groupBy("cluster_id").agg(F.sort_array(F.collect_set(F.when(F.col("band") != "", F.col("band")))).alias("bands"), F.count("*").alias("n_articles"))


def evidence_list(members: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(cluster_id, items): members as (published_at, id, band, title, lead) in order of time; a cluster's members are bounded by its window."""
    rows = members.join(articles, F.col("article_id") == F.col("id")).join(sources.select(F.col("id").alias("source_id"), "band"), "source_id", "left")
    return rows.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("published_at", "article_id", "band", "title", "lead"))).alias("items"))


def classification_prompts(items: DataFrame) -> DataFrame:
    """(cluster_id, prompt): one text with the scale, the categories and the numbered sources."""
    blocks = F.array_join(F.transform("items", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(x.band, F.lit("")), F.lit(" | "), F.coalesce(x.title, F.lit("")), F.lit("\n"), F.coalesce(x.lead, F.lit("")))), "\n\n")
    head = "Severity: 0 worst to 5 mildest.\nCategories: " + ", ".join(CATEGORIES) + "\n\nSources:\n"
    return items.select("cluster_id", F.concat(F.lit(head), blocks).alias("prompt"))


def normalize_category(category: Column) -> Column:
    """The category that equals the text but for case and diacritics; others unchanged (E5)."""
    key, out = fold_key(category), category
    for name in CATEGORIES:
        out = F.when(key == fold_key(F.lit(name)), F.lit(name)).otherwise(out)
    return out


def parse_responses(answers: DataFrame, text: str = "response") -> DataFrame:
    """Adds parsed (struct) and reason: null for a valid answer, else what is wrong.

    Code fences are dropped and the outermost braces cut out before the JSON is read.
    """
    bare = F.regexp_replace(F.col(text), r"(?m)^\s*```[a-zA-Z]*\s*$", "")
    found = F.from_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), RESPONSE)
    rows = answers.withColumn("_p", found).withColumn("_c", normalize_category(F.col("_p.category")))
    level = F.col("_p.defcon")
    reason = (
        F.when(F.col("_p").isNull() | (level.isNull() & F.col("_p.category").isNull() & F.col("_p.headline").isNull()), "no_json").when(level.isNull() | (level != F.floor(level)) | (level < 0) | (level > 5), "bad_severity")
        .when(F.col("_c").isNull() | ~F.col("_c").isin(*CATEGORIES), "bad_category").when(~F.coalesce(F.col("_p.confidence_self").isin("high", "medium", "low"), F.lit(False)), "bad_confidence")
        .when(F.coalesce(F.length("_p.summary") > 500, F.lit(True)), "bad_summary").when(F.coalesce(F.length("_p.headline") > 200, F.lit(True)), "bad_headline")
    )
    parsed = F.struct(level.cast("int").alias("severity"), F.col("_c").alias("category"), F.col("_p.confidence_self").alias("confidence_self"), F.coalesce("_p.entities", F.array().cast("array<string>")).alias("entities"), F.col("_p.summary").alias("summary"), F.col("_p.headline").alias("headline"))
    return rows.withColumn("reason", reason).withColumn("parsed", F.when(F.col("reason").isNull(), parsed)).drop("_p", "_c")


def pick_response(attempts: DataFrame, max_retries: int | None = 2) -> DataFrame:
    """(cluster_id, severity, category, headline, fell_back): the first valid of the attempts 0 to ``max_retries`` (all, if None), else the fixed fallback."""
    rows = parse_responses(attempts if max_retries is None else attempts.where(F.col("attempt") <= max_retries))
    best = rows.groupBy("cluster_id").agg(F.min_by(F.when(F.col("reason").isNull(), F.col("parsed")), F.when(F.col("reason").isNull(), F.col("attempt"))).alias("p"))
    return best.select(
        "cluster_id", F.coalesce("p.severity", F.lit(5)).alias("severity"), F.coalesce("p.category", F.lit("SINIFLANDIRILMADI")).alias("category"),
        F.coalesce("p.headline", F.lit("(başlıksız)")).alias("headline"), F.col("p").isNull().alias("fell_back"),
    )


def promotion_log(clusters: DataFrame, found: DataFrame, runs: DataFrame) -> DataFrame:
    """One audit row a cluster: raw, ceiling and final severity, stored bands, sides, confidence, rule.

    ``runs``' earliest start, a single number, decides the demotion of the first week.
    """
    first = runs.agg(F.min("started_at").alias("first_run"))
    rows = clusters.join(found, "cluster_id", "left").withColumn("bands", F.coalesce("bands", F.array().cast("array<string>"))).crossJoin(F.broadcast(first))
    known = rules.known_bands(F.col("bands"))
    level, rule = rules.ceiling(known)
    rows = rows.withColumn("ceiling", level).withColumn("rule_applied", rule).withColumn("sides", rules.ideological_sides(known)).withColumn("confidence", rules.confidence(known, F.coalesce("n_articles", F.lit(0))))
    final = rules.final_severity(F.col("raw_severity"), F.col("ceiling"))
    return rows.select("cluster_id", "created_at", "raw_severity", "ceiling", rules.bootstrap_demote(final, F.col("created_at"), F.col("first_run")).alias("final_severity"), "bands", "sides", "confidence", "rule_applied", F.coalesce("n_articles", F.lit(0)).alias("n_articles"))


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")
