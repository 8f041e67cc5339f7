"""Landed web pages: links, titles, publication times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names, and the meta tags with a time in order of trust.
MONTHS = ("Ocak", "Şubat", "Mart", "Nisan", "Mayıs", "Haziran", "Temmuz", "Ağustos", "Eylül", "Ekim", "Kasım", "Aralık")
META_TAGS = (
    ("property", "article:published_time"), ("property", "article:modified_time"), ("property", "og:updated_time"), ("name", "datePublished"), ("name", "publishdate"),
    ("name", "publish-date"), ("name", "date"), ("name", "pubdate"), ("itemprop", "datePublished"), ("itemprop", "dateModified"),
)
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def unescape(text: Column) -> Column:
    """The common character references as characters; &amp; last."""
    for name, value in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(value))
    return text


def absolute_url(base: Column, href: Column) -> Column:
    """href against the page's URL: absolute, scheme-relative, rooted or relative; fragments and dots stay."""
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(?:/[^?#]*)?)", 1), r"(?<=[^:/])/[^/]*$", "")
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([^:]*:)", 1), href))
        .when(href.startswith("/"), F.concat(root, href)).when(href.startswith("#") | href.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), href)).otherwise(F.concat(folder, F.lit("/"), href))
    )


def extract_links(pages: DataFrame, containers: DataFrame | None = None) -> DataFrame:
    """(page_id, pos, url): absolute links inside the source's listing element, each once at its first place.

    ``containers``: (source_id, tag, class), a row a source; class may be null. Pages of other sources, and
    all without it, list their links in ``nav``. An element ends at the first end tag of its name.
    """
    if containers is None:
        pages = pages.withColumn("_open", F.lit(r"nav\b[^>]*")).withColumn("_tag", F.lit("nav"))
    else:
        named = F.concat(F.lit(r"""\b[^>]*\bclass\s*=\s*["'][^"']*\b"""), "class", F.lit(r"\b[^>]*"))
        opened = F.concat("tag", F.coalesce(named, F.lit(r"\b[^>]*")))
        pages = pages.join(containers.select("source_id", "tag", opened.alias("_open")), "source_id", "left")
        pages = pages.withColumn("_open", F.coalesce("_open", F.lit(r"nav\b[^>]*"))).withColumn("_tag", F.coalesce("tag", F.lit("nav")))
    pages = pages.withColumn("_pattern", F.concat(F.lit("(?is)<"), "_open", F.lit(">(.*?)</"), "_tag", F.lit(">")))
    hrefs = F.regexp_extract_all(F.expr("regexp_extract(html, _pattern, 1)"), F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*("[^"]+"|'[^']+'|[^\s>"']+)"""), 1)
    found = pages.select("page_id", F.col("url").alias("base"), F.posexplode(F.transform(hrefs, lambda x: F.regexp_replace(x, "^[\"']|[\"']$", ""))).alias("pos", "href"))
    return found.select("page_id", "pos", absolute_url(F.col("base"), unescape(F.col("href"))).alias("url")).groupBy("page_id", "url").agg(F.min("pos").alias("pos")).select("page_id", "pos", "url")


def extract_title(pages: DataFrame, tag: str = "h1") -> DataFrame:
    """(page_id, title): text of the title element, else of <title>, trimmed; null if both are blank."""
    inner = lambda t: F.trim(unescape(F.regexp_replace(F.regexp_extract("html", rf"(?is)<{t}\b[^>]*>(.*?)</{t}>", 1), "<[^>]*>", "")))
    return pages.select("page_id", F.coalesce(F.nullif(inner(tag), F.lit("")), F.nullif(inner("title"), F.lit(""))).alias("title"))


def _time(text: Column) -> Column:
    return F.try_to_timestamp(F.trim(text))


def canonical_timestamp(pages: DataFrame) -> DataFrame:
    """(page_id, ts, method): JSON-LD, then meta tags in order, then Turkish dates in the body, else fetched_at."""
    ld = F.regexp_extract_all("html", F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), 1)
    ld_times = F.flatten(F.transform(ld, lambda x: F.regexp_extract_all(x, F.lit(r'"(?:datePublished|dateCreated|dateModified)"\s*:\s*"([^"]*)"'), 1)))
    from_ld = F.try_element_at(F.filter(F.transform(ld_times, _time), lambda t: t.isNotNull()), F.lit(1))
    metas = []
    for attribute, value in META_TAGS:
        tag = F.regexp_extract("html", rf'(?is)(<meta\b[^>]*\b{attribute}="{value}"[^>]*>)', 1)
        metas.append(_time(F.regexp_extract(tag, r'(?is)\bcontent="([^"]*)"', 1)))
    body = F.regexp_replace(F.regexp_replace(F.regexp_extract("html", r"(?is)<body\b[^>]*>(.*)", 1), r"(?is)<(script|style)\b.*?</\1>", " "), "<[^>]*>", " ")
    named = rf"(\d{{1,2}})\s+({'|'.join(MONTHS)})\s+(\d{{4}})"
    month = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, f"{i + 1:02d}")])
    from_name = F.when(F.regexp_extract(body, named, 3) != "", F.try_to_timestamp(F.concat_ws("-", F.regexp_extract(body, named, 3), F.try_element_at(month, F.regexp_extract(body, named, 2)), F.lpad(F.regexp_extract(body, named, 1), 2, "0"))))
    dotted = r"(\d{1,2})\.(\d{1,2})\.(\d{4})"
    from_dots = F.when(F.regexp_extract(body, dotted, 3) != "", F.try_to_timestamp(F.concat_ws("-", F.regexp_extract(body, dotted, 3), F.lpad(F.regexp_extract(body, dotted, 2), 2, "0"), F.lpad(F.regexp_extract(body, dotted, 1), 2, "0"))))
    rows = pages.select("page_id", "fetched_at", from_ld.alias("ld"), F.coalesce(*metas).alias("meta"), F.coalesce(from_name, from_dots).alias("turkish"))
    method = F.when(F.col("ld").isNotNull(), "json-ld").when(F.col("meta").isNotNull(), "meta").when(F.col("turkish").isNotNull(), "turkish-regex").otherwise("fetched-at")
    return rows.select("page_id", F.coalesce("ld", "meta", "turkish", "fetched_at").alias("ts"), method.alias("method"))
