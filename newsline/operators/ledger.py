"""Run ledger, retention, overrides, search and integrity checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsline.functions.text import tokens, tr_lower
from newsline.operators.ingest import upsert
from newsline.plans.live import drop_days
from newsline.plans.storage import materialize

STAGES = ("ingest", "normalize", "cluster", "score", "arcs", "write", "tts")
KEEP_DAYS = {"raw_articles": 90, "articles": 365, "article_embeddings": 365, "ingest_log": 365}


def run_status(events: DataFrame) -> DataFrame:
    """(run_id, status, stages_done, failed_stages, is_latest) from append-only (run_id, at, stage, outcome, reason) events (H1).

    Stages appear in order of their first success; outcome is done or failed.
    """
    done = F.when(F.col("outcome") == "done", F.struct("at", "stage"))
    failed = F.when(F.col("outcome") == "failed", F.struct("at", F.concat_ws(": ", "stage", "reason").alias("f")))
    runs = events.groupBy("run_id").agg(F.sort_array(F.collect_list(done)).alias("d"), F.sort_array(F.collect_list(failed)).alias("f"), F.min("at").alias("started"))
    stages = F.array_distinct(F.transform("d", lambda x: x.stage))
    missing = F.array_except(F.array(*map(F.lit, STAGES)), stages)
    status = F.when(F.size("f") > 0, "FAILED").when(F.size(missing) == 0, "DONE").otherwise("RUNNING")
    top = runs.agg(F.max(F.struct("started", "run_id")).alias("m"))
    return runs.crossJoin(F.broadcast(top)).select("run_id", status.alias("status"), stages.alias("stages_done"), F.transform("f", lambda x: x.f).alias("failed_stages"), (F.col("m.run_id") == F.col("run_id")).alias("is_latest"))


def merge_counts(counts: DataFrame) -> DataFrame:
    """(run_id, counts map) of (run_id, name, at, n): the newest value of each counter (H2)."""
    newest = counts.groupBy("run_id", "name").agg(F.max_by("n", "at").alias("n"))
    return newest.groupBy("run_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "n")))).alias("counts"))


def stuck_runs(status: DataFrame) -> DataFrame:
    """(run_id, stuck, missing): runs marked RUNNING though every stage is done, and the stages each run lacks (H3).

    ``status``: run_id, marked (the stored status) and stages_done.
    """
    missing = F.array_except(F.array(*map(F.lit, STAGES)), F.col("stages_done"))
    return status.select("run_id", ((F.col("marked") == "RUNNING") & (F.size(missing) == 0)).alias("stuck"), missing.alias("missing"))


def slow_stages(stages: DataFrame, budgets: DataFrame) -> DataFrame:
    """Adds verdict: slow over the stage's soft budget, timeout over twice that, else ok; no budget is ok (H4). ``budgets`` has a row a stage."""
    over = F.col("seconds") / F.col("budget_seconds")
    return stages.join(budgets, "stage", "left").withColumn("verdict", F.when(over > 2, "timeout").when(over > 1, "slow").otherwise("ok"))


def apply_retention(df: DataFrame, table: str, at: str, now: Column) -> DataFrame:
    """Rows young enough for the table's rule; tables without rule keep all; rows without time stay (H5)."""
    days = KEEP_DAYS.get(table)
    return df if days is None else df.where(F.col(at).isNull() | (F.col(at) >= now - F.expr(f"INTERVAL {days} DAYS")))


def expire_days(spark: SparkSession, path: str, table: str, now: dt.datetime) -> list[str]:
    """Drop the day folders of a dated table (``plans.live``) that the table's rule no longer keeps any row of; the days dropped (H5)."""
    days = KEEP_DAYS.get(table)
    return [] if days is None else drop_days(spark, path, (now - dt.timedelta(days=days)).date())


def _ends(hops: DataFrame) -> DataFrame:
    """(arc, to) with the end of each chain of merges; merges that run in a circle, or into one, are void."""
    hops = materialize(hops, "merges")
    for _ in range(hops.count().bit_length()):  # pointer jumping: what is left of the longest chain halves each time
        further = hops.select(F.col("arc").alias("to"), F.col("to").alias("further"))
        hops = materialize(hops.join(further, "to", "left").select("arc", F.coalesce("further", "to").alias("to")), "merges")
    return hops.join(hops.select(F.col("arc").alias("to")), "to", "left_anti").select("arc", "to")


def apply_overrides(clusters: DataFrame, arcs: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clusters, arcs) after the log of (at, action, target_id, new_value); of one target and kind the latest counts (H6).

    PROMOTE, DEMOTE (new_value is the severity) and DISMISS act on clusters; RESOLVE, REOPEN and RENAME
    on arcs; MERGE moves an arc's clusters to the arc new_value, through chains but not circles, and resolves it; SPLIT gives a
    cluster the new arc new_value. Severity 0 without an override shows as 1.
    """
    kind = F.when(F.col("action").isin("PROMOTE", "DEMOTE", "DISMISS"), "severity").when(F.col("action").isin("RESOLVE", "REOPEN"), "state").otherwise(F.col("action"))
    last = log.withColumn("kind", kind).groupBy("kind", "target_id").agg(F.max_by(F.struct("action", "new_value"), "at").alias("o"))
    one = lambda k, name: last.where(F.col("kind") == k).select(F.col("target_id").alias("_t"), F.col("o").alias(name))
    hops = _ends(one("MERGE", "m").select(F.col("_t").alias("arc"), F.col("m.new_value").alias("to")).where("arc != to"))
    c = clusters.join(one("severity", "s"), F.col("cluster_id") == F.col("_t"), "left").drop("_t").join(one("SPLIT", "p"), F.col("cluster_id") == F.col("_t"), "left").drop("_t")
    c = c.withColumn("arc_id", F.coalesce("p.new_value", "arc_id")).join(hops.select(F.col("arc").alias("arc_id"), "to"), "arc_id", "left").withColumn("arc_id", F.coalesce("to", "arc_id"))
    level = F.when(F.col("s.action") == "DISMISS", 5).when(F.col("s").isNotNull(), F.col("s.new_value").cast("int")).when(F.col("final_severity") == 0, 1).otherwise(F.col("final_severity"))
    c = c.select("cluster_id", "arc_id", level.alias("final_severity"), F.coalesce(F.col("s.action") == "DISMISS", F.lit(False)).alias("dismissed"))
    a = arcs.join(one("state", "s"), F.col("id") == F.col("_t"), "left").drop("_t").join(one("RENAME", "r"), F.col("id") == F.col("_t"), "left").drop("_t").join(hops.select(F.col("arc").alias("id"), "to"), "id", "left")
    state = F.when(F.col("to").isNotNull(), "RESOLVED").when(F.col("s.action") == "RESOLVE", "RESOLVED").when(F.col("s.action") == "REOPEN", "OPEN").otherwise(F.col("state"))
    a = a.select("id", state.alias("state"), F.coalesce("r.new_value", "headline").alias("headline"))
    split = one("SPLIT", "p").select(F.col("p.new_value").alias("id"), F.lit("OPEN").alias("state"), F.lit(None).cast("string").alias("headline")).distinct().join(arcs.select("id"), "id", "left_anti")
    return c, a.union(split)


def token_index(articles: DataFrame) -> DataFrame:
    """(token, id): distinct folded tokens of title and body."""
    return articles.select("id", F.explode(F.array_distinct(tokens(tr_lower(F.concat_ws(" ", "title", "body"))))).alias("token"))


def search(
    index: DataFrame, articles: DataFrame, query: str, since: str | None = None, until: str | None = None, language: str | None = None,
    entity: tuple[DataFrame, str] | None = None, clusters: DataFrame | None = None, category: str | None = None, worst: int | None = None,
) -> DataFrame:
    """Articles that hold every word of the query, within dates and language, with an entity, in a story of a category or of a severity (H7).

    ``entity``: a table (id, entity) and the entity; ``clusters``: (id, category, severity) of the articles'
    stories; ``worst``: severities up to this number, lower being worse.
    """
    words = sorted({w.replace("İ", "i").replace("I", "ı").lower() for w in query.split()})
    rows = articles
    if words:
        ids = index.where(F.col("token").isin(words)).groupBy("id").count().where(F.col("count") == len(words)).select("id")
        rows = rows.join(ids, "id", "left_semi")
    for test, value in ((F.col("published_at") >= F.lit(since).cast("timestamp"), since), (F.col("published_at") < F.lit(until).cast("timestamp"), until), (F.col("language") == language, language)):
        rows = rows.where(test) if value is not None else rows
    if entity is not None:
        rows = rows.join(entity[0].where(F.col("entity") == entity[1]).select("id"), "id", "left_semi")
    if category is not None or worst is not None:
        some = clusters if category is None else clusters.where(F.col("category") == category)
        rows = rows.join((some if worst is None else some.where(F.col("severity") <= worst)).select("id"), "id", "left_semi")
    return rows


def arc_timeline(linked: DataFrame, sources: DataFrame, arc: str) -> DataFrame:
    """The arc's clusters, newest first by number, with their sources (H8)."""
    rows = linked.where(F.col("arc_id") == arc).join(sources, "cluster_id", "left")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("arc_id").orderBy(F.col("created_at").desc(), "cluster_id")))


def source_health(log: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """(source_id, last_ok, n_failed): last success, failures of the last days (H9)."""
    ok = F.col("status") == "OK"
    return log.groupBy("source_id").agg(F.max(F.when(ok, F.col("completed_at"))).alias("last_ok"), F.count_if(~ok & (F.col("completed_at") >= now - F.expr(f"INTERVAL {days} DAYS"))).alias("n_failed"))


def run_history(runs: DataFrame, log: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Runs of the last days with sources, failures and articles."""
    per = log.groupBy("run_id").agg(F.count("*").alias("n_sources"), F.count_if(F.col("status") != "OK").alias("n_failed"), F.sum("articles_fetched").alias("articles"))
    return runs.where(F.col("started_at") >= now - F.expr(f"INTERVAL {days} DAYS")).join(per, "run_id", "left")


def failure_report(log: DataFrame, run_id: str, events: DataFrame, counts: DataFrame) -> DataFrame:
    """(run_id, last_completed, ok_sources, failed_sources, last_stage, counts) of one run.

    ``events`` as for ``run_status``: the stage that finished last; ``counts`` as for ``merge_counts``.
    """
    ok, own = F.col("status") == "OK", F.col("run_id") == run_id
    pick = lambda test: F.array_join(F.sort_array(F.collect_list(F.when(test, F.col("source_id")))), ",")
    fetched = log.where(own).groupBy("run_id").agg(F.max("completed_at").alias("last_completed"), pick(ok).alias("ok_sources"), pick(~ok).alias("failed_sources"))
    last = events.where(own & (F.col("outcome") == "done")).groupBy("run_id").agg(F.max(F.struct("at", "stage")).alias("m")).select("run_id", F.col("m.stage").alias("last_stage"))
    return fetched.join(last, "run_id", "left").join(merge_counts(counts.where(own)), "run_id", "left")


def override_rate(log: DataFrame, alert: int = 3) -> DataFrame:
    """(week, n, alert): overrides in weeks that begin on Monday."""
    rows = log.groupBy(F.date_trunc("week", "at").alias("week")).agg(F.count("*").alias("n"))
    return rows.withColumn("alert", F.col("n") > alert)


def referential_checks(tables: dict[str, DataFrame], keys: dict[str, list[str]], edges: list[tuple[str, str, str, str]]) -> DataFrame:
    """(problem, n): child rows without parent for each (child, column, parent, column), and repeated primary keys."""
    rows = None
    for child, c, parent, p in edges:
        lost = tables[child].where(F.col(c).isNotNull()).join(tables[parent].select(F.col(p).alias(c)).distinct(), c, "left_anti")
        found = lost.agg(F.count("*").alias("n")).select(F.lit(f"{child}.{c} -> {parent}.{p}").alias("problem"), "n")
        rows = found if rows is None else rows.union(found)
    for name, own in keys.items():
        found = tables[name].groupBy(*own).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit(f"{name} key").alias("problem"), "n")
        rows = found if rows is None else rows.union(found)
    return rows


def report_index(index: DataFrame, row: DataFrame) -> DataFrame:
    """The index of reports with today's row in place of an older one of its date."""
    return upsert(index, row, ["date"], "generated_at")
