"""Landed feeds, posts and gazette pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsline.functions.text import article_id

ITEM = "title string, link string, guid string, id string, pubDate string, published string, updated string, description string, summary string, content string"
AGE_HOURS, MIN_SCORE, MIN_COMMENTS = 24, 50, 25


def feed_entries(items: DataFrame) -> DataFrame:
    """Entries of one or more fetches: (feed, entry_id, url, title, ts, body).

    Entries without link are dropped; the id is id, guid or link; of equal ids in a feed the first
    (smallest pos) stays; the time is the earlier of published and updated; the body is content,
    description or summary, the first there is.
    """
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    time = lambda c: F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(F.regexp_replace(c, "^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z")))
    times = F.filter(F.array(time(F.coalesce("published", "pubDate")), time(F.col("updated"))), lambda t: t.isNotNull())
    rows = items.where(blank("link").isNotNull()).select("feed", "pos", F.coalesce(blank("id"), blank("guid"), blank("link")).alias("entry_id"), blank("link").alias("url"), blank("title").alias("title"), F.array_min(times).alias("ts"), F.coalesce(blank("content"), blank("description"), blank("summary"), F.lit("")).alias("body"))
    first = Window.partitionBy("feed", "entry_id").orderBy("pos")
    return rows.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank", "pos")


def read_feed_items(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """``feed_entries`` of the XML files under a path; the feed is the file."""
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(ITEM).load(path)
    return feed_entries(raw.withColumn("feed", F.col("_metadata.file_path")).withColumn("pos", F.monotonically_increasing_id()))


def filter_recent_popular(posts: DataFrame, now: Column) -> DataFrame:
    """Posts of the last 24 hours with 50 points or 25 comments; without a creation time they go (A10)."""
    fresh = F.col("created").isNotNull() & (F.unix_timestamp("created") > 0) & (F.col("created") >= now - F.expr(f"INTERVAL {AGE_HOURS} HOURS"))
    return posts.where(fresh & ((F.col("score") >= MIN_SCORE) | (F.col("comments") >= MIN_COMMENTS)))


def filter_by_channel_rules(posts: DataFrame, rules: DataFrame) -> DataFrame:
    """Posts whose flair and title each hold one of the channel's needles, case-insensitively; no needles pass all, no rule none.

    ``rules``: (channel, flair_any array, title_any array), one row a channel of a fixed list.
    """
    holds = lambda text, any_: (F.size(any_) == 0) | F.exists(any_, lambda x: F.contains(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lower(x)))
    return posts.join(rules, "channel").where(holds("flair", F.col("flair_any")) & holds("title", F.col("title_any"))).select(posts.columns)


def normalize_posts(posts: DataFrame, base: str = "https://www.example.com") -> DataFrame:
    """(id, title, body, comments, permalink, external_url): title to 500, body and comments to 200 characters; of the first three comments the non-blank."""
    texts = F.filter(F.transform(F.slice("comments", 1, 3), lambda c: F.substring(F.trim(c), 1, 200)), lambda c: c.isNotNull() & (c != ""))
    link = F.when(F.col("permalink").startswith("http"), F.col("permalink")).otherwise(F.concat(F.lit(base), F.col("permalink")))
    return posts.select("id", F.substring("title", 1, 500).alias("title"), F.substring(F.coalesce("selftext", F.lit("")), 1, 200).alias("body"), F.coalesce(texts, F.array().cast("array<string>")).alias("comments"), link.alias("permalink"), F.when(~F.coalesce("is_self", F.lit(False)), F.col("url")).alias("external_url"))


# What marks a section (contained in the line), an item (the whole line), and the reference patterns in order.
SECTIONS = ("YÜRÜTME VE İDARE BÖLÜMÜ", "YARGI BÖLÜMÜ", "İLAN BÖLÜMÜ")
ITEM_TYPES = ("KANUN", "CUMHURBAŞKANLIĞI KARARNAMESİ", "YÖNETMELİK", "TEBLİĞ", "ATAMA KARARI", "MAHKEME KARARI")
REFERENCES = (
    r"Karar\s+No\s*[:：]\s*(\d{1,4}/\d{1,5})", r"Karar\s+Sayısı\s*[:：]\s*(\d{1,5}(?:/\d{1,5})?)", r"Kanun\s+No\s*[:：]\s*(\d{1,5}(?:/\d{1,5})?)",
    r"Tebliğ\s+No\s*[:：]\s*(\d{1,5}(?:/\d{1,5})?)", r"Yönetmelik\s+No\s*[:：]\s*(\d{1,5}(?:/\d{1,5})?)", r"\bSayı\s*[:：]\s*(\d{1,5}(?:/\d{1,5})?)",
)


def segment_gazette(pages: DataFrame) -> DataFrame:
    """(edition, item, section, kind, title, reference, body, first_page, last_page) of (edition, page, text).

    A line that contains a section's name opens the section and closes the item; a line that is an
    item type opens an item; lines before the first item go. Items before any section are of the first one. Title: the
    item's first non-empty line; reference: that of the first line that has one, by the first pattern that
    matches it; body: the non-empty lines; pages: from the item's type to its last non-empty line.
    """
    lines = pages.select("edition", "page", F.posexplode(F.split("text", "\n")).alias("row", "line")).withColumn("raw", F.col("line")).withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))
    section = F.coalesce(*(F.when(F.contains(F.col("line"), F.lit(s)), F.lit(s)) for s in SECTIONS))
    kind = F.when(F.col("line").isin(*ITEM_TYPES), F.col("line"))
    order = Window.partitionBy("edition").orderBy("page", "row")
    marked = lines.withColumn("_s", section).withColumn("_k", kind)
    marked = marked.withColumn("section", F.coalesce(F.last("_s", ignorenulls=True).over(order), F.lit(SECTIONS[0]))).withColumn("_n", F.sum(F.when(F.col("_s").isNotNull() | F.col("_k").isNotNull(), 1).otherwise(0)).over(order))
    marked = marked.withColumn("kind", F.first("_k", ignorenulls=True).over(Window.partitionBy("edition", "_n")))
    body = marked.where("kind is not null")
    found = F.coalesce(*(F.nullif(F.regexp_extract("line", f"(?iu){r}", 1), F.lit("")) for r in REFERENCES))
    is_text = F.col("_k").isNull() & (F.col("line") != "")
    items = body.groupBy("edition", "_n").agg(
        F.min("section").alias("section"), F.min("kind").alias("kind"), F.min_by("line", F.when(is_text, F.struct("page", "row"))).alias("title"),
        F.min_by(found, F.when(found.isNotNull(), F.struct("page", "row"))).alias("reference"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(is_text, F.struct("page", "row", "raw")))), lambda x: x.raw), "\n").alias("body"),
        F.min("page").alias("first_page"), F.max(F.when(is_text | F.col("_k").isNotNull(), F.col("page"))).alias("last_page"),
    )
    items = items.withColumn("title", F.coalesce("title", F.lit(""))).withColumn("reference", F.coalesce("reference", F.lit(""))).withColumn("body", F.regexp_replace("body", r"(?U)^\s+|\s+$", ""))
    return items.withColumn("item", F.row_number().over(Window.partitionBy("edition").orderBy("_n")) - 1).drop("_n")


def gazette_keys(items: DataFrame, base: str = "https://www.example.gov/eskiler") -> DataFrame:
    """Adds entry_id (the reference, else item-i-pN), url and article_id."""
    entry = F.coalesce(F.nullif("reference", F.lit("")), F.format_string("item-%d-p%d", "item", "first_page"))
    rows = items.withColumn("entry_id", entry)
    rows = rows.withColumn("url", F.concat(F.lit(base + "/"), F.col("edition"), F.lit("#"), F.replace("entry_id", F.lit(" "), F.lit("-"))))
    return rows.withColumn("article_id", article_id(F.lit("gazette"), F.col("url")))


def is_pdf(content: Column) -> Column:
    """Whether the bytes start as a PDF does."""
    return F.coalesce(F.substring(content, 1, 4) == F.lit(b"%PDF"), F.lit(False))
