"""Stories over days: matching, state, lifecycle, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsline.functions import rules
from newsline.functions.text import local_date

# Entities too common to tell stories apart.
STOP_ENTITIES = (
    "Türkiye", "Türk", "Cumhuriyet", "Vatandaş", "Devlet", "Hükümet", "İktidar", "Muhalefet", "Meclis", "TBMM",
    "Cumhurbaşkanı", "Cumhurbaşkanlığı", "AKP", "CHP", "MHP", "AK Parti", "Anayasa", "Kanun", "Karar",
)
ACTIVE = ("OPEN", "WATCH")
PLACEHOLDER = "(başlıksız)"


def active_arcs(arcs: DataFrame, centroids: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Open or watched arcs touched within ``days`` (or never) that have a centroid, each row once; a missing peak is 5 (F1)."""
    live = arcs.where(F.col("state").isin(*ACTIVE) & (F.col("last_update_at").isNull() | (F.col("last_update_at") >= now - F.expr(f"INTERVAL {days} DAYS"))))
    return live.join(centroids, "id", "left_semi").withColumn("peak_severity", F.coalesce("peak_severity", F.lit(5)))


def linkable_clusters(clusters: DataFrame, touched: DataFrame) -> DataFrame:
    """Scored clusters of this run without arc and with a headline; linking takes them worst first (F2)."""
    rows = clusters.where("arc_id is null and final_severity is not null and trim(coalesce(headline, '')) != ''")
    return rows.join(touched.select("cluster_id").distinct(), "cluster_id", "left_semi")


def drop_stop_entities(entities: Column) -> Column:
    """Without empty, null and too common entities."""
    return F.array_except(entities, F.array(*map(F.lit, ("", *STOP_ENTITIES)), F.lit(None).cast("string")))


def cluster_entities(members: DataFrame, entities: DataFrame) -> DataFrame:
    """(cluster_id, entities): sorted distinct entity texts of the member articles; blank ones skipped."""
    rows = members.join(entities, "article_id").where("entity is not null and entity != ''")
    return rows.groupBy("cluster_id").agg(F.sort_array(F.collect_set("entity")).alias("entities"))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common members; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def match_arcs(clusters: DataFrame, arcs: DataFrame, min_cosine: float = 0.55, min_jaccard: float = 0.4) -> DataFrame:
    """(cluster_id, arc_id, cosine, jaccard): the arc with the highest cosine of those that pass both tests.

    Both sides have entities array<string> and vector array<double>. A Jaccard above 0 needs a
    shared entity, so pairs come from an equi-join of entities, not from all pairs.
    """
    from newsline.operators.vectors import cosine

    left = clusters.select("cluster_id", F.explode(F.array_distinct("entities")).alias("e"))
    right = arcs.select(F.col("id").alias("arc_id"), F.explode(F.array_distinct("entities")).alias("e"))
    pairs = left.join(right, "e").groupBy("cluster_id", "arc_id").count().drop("count")
    pairs = pairs.join(clusters.select("cluster_id", F.col("entities").alias("ca"), F.col("vector").alias("cv")), "cluster_id").join(arcs.select(F.col("id").alias("arc_id"), F.col("entities").alias("aa"), F.col("vector").alias("av")), "arc_id")
    pairs = pairs.select("cluster_id", "arc_id", cosine(F.col("cv"), F.col("av")).alias("cosine"), jaccard(F.col("ca"), F.col("aa")).alias("jaccard")).where((F.col("cosine") >= min_cosine) & (F.col("jaccard") >= min_jaccard))
    return pairs.withColumn("_rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.col("cosine").desc(), "arc_id"))).where("_rank = 1").drop("_rank")


def fold_arc_updates(arcs: DataFrame, linked: DataFrame) -> DataFrame:
    """Arcs after their linked clusters: (arc_id, cluster_id, created_at, severity, headline, seq) rows; the last call wins."""
    last = F.max_by(F.struct("created_at", "cluster_id", "headline"), "seq")
    new = linked.groupBy(F.col("arc_id").alias("id")).agg(last.alias("last"), F.min("severity").alias("low"), F.count("*").alias("n_linked"))
    return arcs.join(new, "id", "left").select(
        "id", "created_at", F.when(F.col("last").isNotNull() & (F.col("state") == "WATCH"), "OPEN").otherwise(F.col("state")).alias("state"), F.coalesce("last.created_at", "last_update_at").alias("last_update_at"),
        F.least("peak_severity", "low").alias("peak_severity"), F.col("last.cluster_id").alias("last_cluster_id"), F.col("last.headline").alias("last_headline"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
    )


def fold_arc_state(arcs: DataFrame, linked: DataFrame) -> DataFrame:
    """(id, entities, centroid, last_summary) of arcs after their linked clusters.

    Entities: the arc's and all its clusters', sorted; centroid: the mean of its clusters' vectors, the
    stored one without any; last_summary: the last call's. ``arcs``: id, entities, centroid; ``linked``: arc_id,
    entities, vector, summary, seq.
    """
    from newsline.operators.vectors import centroid

    names = arcs.select("id", F.explode("entities").alias("e")).union(linked.select(F.col("arc_id"), F.explode("entities")))
    names = names.groupBy("id").agg(F.sort_array(F.collect_set("e")).alias("entities"))
    means = centroid(linked, "arc_id", "vector").withColumnRenamed("arc_id", "id").withColumnRenamed("centroid", "mean")
    last = linked.groupBy(F.col("arc_id").alias("id")).agg(F.max_by("summary", "seq").alias("last_summary"))
    rows = arcs.select("id", "centroid").join(names, "id", "left").join(means, "id", "left").join(last, "id", "left")
    return rows.select("id", F.coalesce("entities", F.array().cast("array<string>")).alias("entities"), F.coalesce("mean", "centroid").alias("centroid"), "last_summary")


def resolve_expired(arcs: DataFrame, now: Column, days: int = rules.EXPIRE_DAYS) -> DataFrame:
    """Open or watched arcs last updated ``days`` calendar days ago or more are RESOLVED; null never; times stay (F8).

    The update counts by its UTC date, today by the date three hours east.
    """
    due = F.col("state").isin(*ACTIVE) & (F.to_date("last_update_at") <= F.date_sub(local_date(now), days))
    return arcs.withColumn("state", F.when(due, "RESOLVED").otherwise(F.col("state")))


def backfill_latest_cluster(arcs: DataFrame, linked: DataFrame) -> DataFrame:
    """Adds last_cluster_id, the newest linked cluster, ties to the larger id; last_update_at falls back to it, then to created_at."""
    newest = linked.groupBy(F.col("arc_id").alias("id")).agg(F.max(F.struct("created_at", "cluster_id")).alias("m"))
    return arcs.join(newest, "id", "left").select("id", "state", F.coalesce("last_update_at", "m.created_at", "created_at").alias("last_update_at"), F.col("m.cluster_id").alias("last_cluster_id"))


def audit_arcs(arcs: DataFrame, centroids: DataFrame, linked: DataFrame) -> DataFrame:
    """(id, problem): arcs without centroid and arcs without clusters."""
    gap = arcs.join(centroids.select("id"), "id", "left_anti").select("id", F.lit("no_centroid").alias("problem"))
    return gap.union(arcs.join(linked.select(F.col("arc_id").alias("id")), "id", "left_anti").select("id", F.lit("no_clusters").alias("problem")))


def repair_headlines(arcs: DataFrame, linked: DataFrame) -> DataFrame:
    """Blank headlines and summaries get those of the earliest linked cluster that has one, else a placeholder; a second run changes nothing."""
    for name in ("headline", "summary"):
        good = linked.where(F.trim(F.coalesce(name, F.lit(""))) != "").groupBy(F.col("arc_id").alias("id")).agg(F.min(F.struct("created_at", "cluster_id", name)).alias("m"))
        arcs = arcs.join(good, "id", "left").withColumn(name, F.coalesce(F.when(F.trim(name) != "", F.col(name)), F.col(f"m.{name}"), F.lit(PLACEHOLDER))).drop("m")
    return arcs
