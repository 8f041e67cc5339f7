"""Landing and keeping rows: registry checks, upserts, first-wins inserts, run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("OK", "TIMEOUT", "HTTP_ERROR", "PARSE_ERROR", "SKIPPED")


def registry_violations(sources: DataFrame) -> DataFrame:
    """(id, reason) of the registry's faults: repeated id, bad id, empty url, rate of 0 or less (A1)."""
    bad = lambda test, reason: sources.where(test).select("id", F.lit(reason).alias("reason"))
    twice = sources.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate_id").alias("reason"))
    return twice.union(bad(F.coalesce(~F.col("id").rlike("^[a-z0-9_]+$"), F.lit(True)), "bad_id")).union(bad(F.coalesce(F.trim("url") == "", F.lit(True)), "empty_url")).union(bad(F.coalesce(F.col("rate_limit_seconds") <= 0, F.lit(True)), "bad_rate"))


def sources_where(sources: DataFrame, band: str | None = None, tier: str | None = None, kind: str | None = None) -> DataFrame:
    """The sources of a band, tier or kind; None doesn't restrict (A2)."""
    for name, value in (("band", band), ("tier", tier), ("kind", kind)):
        if value is not None:
            sources = sources.where(F.col(name) == value)
    return sources


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both, one a key: an update wins over what is there, and of several rows of one side the largest version (A3)."""
    rows = target.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    newest = Window.partitionBy(*keys).orderBy(F.col("_new").desc(), F.col(version).desc_nulls_last())
    return rows.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank", "_new")


def insert_ignore(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of ``batch`` that are really new: the first of each key that the target lacks (A4)."""
    first = batch.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")
    return first.join(target.select(*keys).distinct(), keys, "left_anti").select(batch.columns)


def ingest_summary(log: DataFrame) -> DataFrame:
    """Per run: articles of OK sources, OK and failed sources."""
    ok = F.col("status") == "OK"
    return log.groupBy("run_id").agg(F.coalesce(F.sum(F.when(ok, F.col("articles_fetched"))), F.lit(0)).cast("long").alias("articles"), F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"))


def classify_fetch(fetches: DataFrame) -> DataFrame:
    """Adds status: TIMEOUT, HTTP_ERROR, PARSE_ERROR, SKIPPED or OK.

    Columns: has_handler, timed_out, transport_error booleans, http_status int, parsed boolean, entries int.
    """
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    return fetches.withColumn(
        "status",
        F.when(~true("has_handler"), "SKIPPED").when(true("timed_out"), "TIMEOUT").when(true("transport_error") | (F.coalesce(F.col("http_status"), F.lit(0)) >= 400), "HTTP_ERROR")
        .when(~true("parsed") & (F.coalesce(F.col("entries"), F.lit(0)) == 0), "PARSE_ERROR").otherwise("OK"),
    )


def pending(raw: DataFrame, log: DataFrame, done: DataFrame, run_id: str) -> DataFrame:
    """Rows of the sources that this run touched, whatever their status, that aren't done yet (B1)."""
    touched = log.where(F.col("run_id") == run_id).select("source_id").distinct()
    return raw.join(touched, "source_id", "left_semi").join(done.select("id").distinct(), "id", "left_anti")
