"""The daily report: views, section lines, assembly, checks, and the spoken form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsline.functions import rules
from newsline.functions.text import local_date
from newsline.plans.storage import materialize
from newsline.sources.pages import MONTHS

# Severity words, section markers in order, notes and line formats of the report.
LABELS = ("DÜŞÜNÜLEMEZ", "AKUT", "ŞİDDETLİ", "MATERYAL", "GÜNDEM", "AMBİYANS")
SECTIONS = (
    "## ❯ DEFCON 1-2 · ÖNCELİKLİ", "## ❯ DEFCON 3 · MATERYAL", "## ❯ AÇIK GELİŞMELER · DEVAM EDEN TAKİP", "## ❯ DEFCON 4 · GÜNDEM",
    "## ❯ DİKKAT · YALNIZCA SOSYALDE", "## ❯ AMBİYANS · DEFCON 5", "## ❯ KAPATILAN HİKAYELER", "## ❯ SİSTEM LOG",
)
EMPTY = ("(bugün öğe yok)", "(bugün öğe yok)", "(bugün güncelleme yok)", "(bugün öğe yok)", "(bugün öğe yok)", "(bugün öğe yok)", "(bugün kapatılan yok)", "(kayıt yok)")
HIGHLIGHT, OVERFLOW = "### Öne Çıkanlar", "### Diğer Açık Hikayeler"
SOCIAL_PROMPT = "(yalnızca sosyal · DEFCON 4 üst sınırı uygulanır)"
UNTITLED, UNCLASSIFIED, CLOSED = "(başlıksız)", "SINIFLANDIRILMADI", "kapatıldı"
DORMANT_NOTE = "Bu bölümde bugüne ait güncel gelişme yok."
UPDATE, STALLED, CLOSING = "**Güncelleme** ·", "*Bu arc'da bugün yeni gelişme yok.*", "Bu hikaye bugün kapatıldı."
LOW_CONFIDENCE, NONE = "DÜŞÜK", "(yok)"
PROMPT_ECHOES = ("KURALLAR (", "BÖLÜM VERİSİ:", "ÇIKTI (yalnızca", "GÖREV ·", "Hedef bölüm ·")
PLACEHOLDER = "[içerik buraya"
TITLE = "# GÜNLÜK BRİFİNG"
VOICED_CAP = 10


def severity_label(level: Column) -> Column:
    """The word of a severity."""
    return F.element_at(F.array(*map(F.lit, LABELS)), level.cast("int") + 1)


def turkish_date(ts: Column) -> Column:
    """d Month yyyy."""
    return F.concat_ws(" ", F.dayofmonth(ts).cast("string"), F.element_at(F.array(*map(F.lit, MONTHS)), F.month(ts)), F.year(ts).cast("string"))


def report_clusters(clusters: DataFrame, arcs: DataFrame, now: Column) -> DataFrame:
    """Scored clusters with age and freshness by their arc's last update, else their own time (G1).

    Columns needed: cluster_id, created_at, final_severity, confidence, headline, summary, category, bands, arc_id.
    """
    rows = clusters.where("final_severity is not null").dropDuplicates(["cluster_id"]).join(arcs.select(F.col("id").alias("arc_id"), "last_update_at"), "arc_id", "left")
    days = rules.days_since(F.coalesce("last_update_at", "created_at"), now)
    return rows.select("cluster_id", "final_severity", "confidence", "headline", "summary", "category", "bands", "arc_id", days.alias("days"), rules.freshness(days).alias("freshness"), rules.social_only(F.col("bands")).alias("is_social_only"))


def cluster_sources(members: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(cluster_id, sources, n_sources): distinct (source, band) in order of source."""
    rows = members.join(articles.select(F.col("id").alias("article_id"), "source_id"), "article_id").select("cluster_id", "source_id").distinct().join(sources.select(F.col("id").alias("source_id"), "band"), "source_id", "left")
    return rows.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.concat_ws("/", "source_id", "band"))).alias("sources"), F.count("*").alias("n_sources"))


def report_arcs(arcs: DataFrame, run_start: Column, now: Column) -> DataFrame:
    """All open arcs, and resolved ones updated since the run's start (all, if that is null), with age, freshness and whether touched today."""
    keep = (F.col("state") == "OPEN") | ((F.col("state") == "RESOLVED") & (run_start.isNull() | (F.col("last_update_at") >= run_start)))
    days = rules.days_since(F.col("last_update_at"), now)
    today = F.coalesce(local_date(F.col("last_update_at")) == local_date(now), F.lit(False))
    return arcs.where(keep).withColumn("days", days).withColumn("freshness", rules.freshness(days)).withColumn("active_today", today)


def failed_sources(log: DataFrame, run_id: str) -> DataFrame:
    """Sources of the run that aren't OK."""
    return log.where((F.col("run_id") == run_id) & (F.col("status") != "OK")).select("source_id", "status")


def report_header(views: DataFrame, arcs: DataFrame) -> DataFrame:
    """One row: clusters, ambient clusters, peak severity (5 without clusters), open and all arcs."""
    a = views.agg(F.count("*").alias("n_clusters"), F.count_if(F.col("final_severity") == 5).alias("n_ambient"), F.coalesce(F.min("final_severity"), F.lit(5)).alias("peak"))
    b = arcs.agg(F.count_if(F.col("state") == "OPEN").alias("n_open"), F.count("*").alias("n_arcs"))
    return a.crossJoin(b)


def _suffix(days: str = "days") -> Column:
    return F.concat(F.lit(" · "), rules.recency_label(F.col(days)))


def _title() -> Column:
    return F.coalesce(F.nullif("headline", F.lit("")), F.lit(UNTITLED))


def open_arc_lines(arcs: DataFrame, cap: int = VOICED_CAP) -> DataFrame:
    """(rank, block, line) of open arcs that aren't expired, freshest and worst first; beyond ``cap`` in a block of their own.

    The rank is by (days, peak, id). Marker lines come only with an overflow; they have ranks 0 and ``cap`` + 0.5.
    """
    rows = arcs.where("state = 'OPEN' and freshness != 'EXPIRED'")
    line = F.concat(F.lit("- "), _title(), F.lit(" · "), severity_label(F.col("peak_severity")), F.lit(" · "), F.coalesce("category", F.lit(UNCLASSIFIED)), F.lit(" · `"), F.col("id"), F.lit("`"), _suffix())
    # The order is global by contract: ranks come from range partitions and their counts.
    from newsline.operators.stories import mint_ids

    ranked = mint_ids(rows.withColumn("_day", F.lit("2000-01-01").cast("timestamp")), "r", "_day", ["days", "peak_severity", "id"])
    ranked = ranked.withColumn("rank", F.regexp_extract("new_id", r"_(\d+)$", 1).cast("double")).withColumn("line", line).select("rank", F.when(F.col("rank") <= cap, "highlight").otherwise("overflow").alias("block"), "line")
    over = ranked.where(F.col("rank") == cap + 1)
    marks = over.select(F.explode(F.array(F.struct(F.lit(0.0).alias("rank"), F.lit("highlight").alias("block"), F.lit(HIGHLIGHT).alias("line")), F.struct(F.lit(cap + 0.5).alias("rank"), F.lit("overflow").alias("block"), F.lit(OVERFLOW).alias("line")))).alias("m")).select("m.*")
    return ranked.union(marks)


def section_lines(views: DataFrame, sources: DataFrame, resolved: DataFrame) -> DataFrame:
    """(section, days, id, line) bullets of the routine, social-only, ambient and resolved sections; order by (days, id).

    Sections are numbered as in ``SECTIONS``.
    """
    rows = views.join(sources.select("cluster_id", "n_sources"), "cluster_id", "left")
    count = F.concat(F.lit("("), F.coalesce("n_sources", F.lit(0)).cast("string"), F.lit(" kaynak)"))
    arc = F.when(F.col("arc_id").isNotNull(), F.concat(F.lit(" · "), F.col("arc_id"))).otherwise("")
    routine = F.concat(F.lit("- "), _title(), F.lit(" · "), F.coalesce("category", F.lit(UNCLASSIFIED)), F.lit(" · "), count, arc, _suffix())
    social = F.concat(F.lit("- "), _title(), F.lit(" · (yalnızca sosyal)"), _suffix())
    ambient = F.concat(F.lit("- "), _title(), F.lit(" · "), count, _suffix())
    closed = F.concat(F.lit("- "), _title(), F.lit(" · "), severity_label(F.col("peak_severity")), F.lit(" · "), F.coalesce("category", F.lit(UNCLASSIFIED)), F.lit(" · `"), F.col("id"), F.lit("` · " + CLOSED))
    pick = lambda test, number, line: rows.where(test).select(F.lit(number).alias("section"), "days", F.col("cluster_id").alias("id"), line.alias("line"))
    out = pick("final_severity = 4", 3, routine).union(pick("final_severity between 1 and 4 and is_social_only", 4, social)).union(pick("final_severity = 5", 5, ambient))
    return out.union(resolved.select(F.lit(6).alias("section"), "days", "id", closed.alias("line")))


def _after(before: str, value: Column) -> Column:
    """The value behind a text, nothing if it is null or blank."""
    return F.when(F.trim(F.coalesce(value, F.lit(""))) != "", F.concat(F.lit(before), value)).otherwise("")


def cluster_blocks(views: DataFrame, sources: DataFrame) -> DataFrame:
    """``views`` with n_sources and the texts full, compact and prompt of each cluster."""
    rows = views.join(sources, "cluster_id", "left")
    label, category, sure = severity_label(F.col("final_severity")), F.coalesce("category", F.lit(UNCLASSIFIED)), F.coalesce("confidence", F.lit(LOW_CONFIDENCE))
    names = F.array_join(F.transform("sources", lambda x: F.replace(x, F.lit("/"), F.lit("·"))), " · ")
    full = F.concat(
        F.lit("### "), _title(), F.lit("\n**DEFCON** · "), label, F.lit(" · **Kategori** · "), category, F.lit(" · **Güven** · "), sure,
        _after("\n**Arc** · ", F.col("arc_id")), _after("\n\n", F.col("summary")), _after("\n\n**Kaynaklar** · ", names),
    )
    compact = F.concat(F.lit("#### "), _title(), F.lit("\n**Güven** · "), sure, _after(" · **Arc** · ", F.col("arc_id")), _after("\n\n", F.col("summary")))
    prompt = F.concat(
        F.lit("### "), _title(), F.lit("\nDEFCON · "), label, F.lit(" · Kategori · "), category, F.lit(" · Güven · "), sure, _after("\nArc · ", F.col("arc_id")),
        _after("\n", F.col("summary")), _after("\nKaynaklar · ", names), F.when(F.col("is_social_only"), F.lit("\n" + SOCIAL_PROMPT)).otherwise(""),
    )
    return rows.select("*", full.alias("full"), compact.alias("compact"), prompt.alias("prompt"))


def arc_blocks(arcs: DataFrame) -> DataFrame:
    """``arcs`` with the texts open, closed, bullet and prompt of each arc.

    An arc touched today shows its last update, a stalled one how long ago that was. Columns: id,
    created_at, headline, summary, last_update_summary, peak_severity, category, days, active_today.
    """
    label, category = severity_label(F.col("peak_severity")), F.coalesce("category", F.lit(UNCLASSIFIED))
    opened = F.when(F.col("created_at").isNotNull(), F.concat(F.lit("**Açıldı** · "), turkish_date(F.col("created_at")), F.lit(" · "))).otherwise("")
    head = F.concat(F.lit("### "), _title(), F.lit(" · "), F.col("id"), F.lit("\n"), opened, F.lit("**Zirve DEFCON** · "), label, F.lit(" · **Kategori** · "), category)
    news = F.coalesce(F.nullif("last_update_summary", F.lit("")), "summary")
    stalled = F.concat(F.lit("\n**Son güncelleme** · "), F.col("days").cast("string"), F.lit(" gün önce"), _after("\n\n", F.col("summary")), F.lit("\n\n" + STALLED))
    closed = F.concat(head, _after("\n\n", F.col("summary")), F.lit("\n\n" + CLOSING))
    bullet = F.concat(F.lit("- "), _title(), F.lit(" · "), label, F.lit(" · "), category, F.lit(" · `"), F.col("id"), F.lit("`"))
    prompt = F.concat(F.lit("### "), _title(), F.lit(" · "), F.col("id"), F.lit("\nZirve DEFCON · "), label, F.lit(" · Kategori · "), category, _after("\n", F.col("summary")))
    return arcs.select("*", F.concat(head, F.when(F.col("active_today"), _after(f"\n\n{UPDATE} ", news)).otherwise(stalled)).alias("open"), closed.alias("closed"), bullet.alias("bullet"), prompt.alias("prompt"))


def _by_category(rows: DataFrame, block: str) -> DataFrame:
    """(rank, block) of clusters under a heading a category, categories in order of their first cluster."""
    rows = rows.select(F.coalesce("category", F.lit(UNCLASSIFIED)).alias("category"), F.concat_ws("|", F.col("final_severity").cast("string"), "cluster_id").alias("own"), F.col(block).alias("block"))
    first = rows.groupBy("category").agg(F.min("own").alias("first"))
    return rows.join(first, "category").select(F.concat_ws("|", "first", F.lit("1"), "own").alias("rank"), "block").union(first.select(F.concat_ws("|", "first", F.lit("0")), F.concat(F.lit("### "), F.col("category"))))


def fallback_sections(views: DataFrame, sources: DataFrame, arcs: DataFrame, cap: int = VOICED_CAP) -> DataFrame:
    """(section, rank, block), ranks being text in order: the sections with blocks, written without a model.

    Severities 0 to 2 in full, severity 3 compact by category, open arcs (touched today, worst, latest first; whole
    up to ``cap``, the others as bullets), resolved arcs.
    """
    clusters, stories = cluster_blocks(views, sources), arc_blocks(arcs)
    worst = clusters.where("final_severity <= 2").select(F.lit(0).alias("section"), F.concat_ws("|", F.col("final_severity").cast("string"), "cluster_id").alias("rank"), F.col("full").alias("block"))
    material = _by_category(clusters.where("final_severity = 3"), "compact").select(F.lit(1).alias("section"), "rank", "block")
    late = F.lpad((F.lit(10**12) - F.coalesce(F.unix_seconds(F.coalesce("last_update_at", "created_at").cast("timestamp")), F.lit(0))).cast("string"), 13, "0")
    open_ = stories.where("state = 'OPEN'").withColumn("order", F.concat_ws("|", F.when(F.col("active_today"), "0").otherwise("1"), F.col("peak_severity").cast("string"), late, "id"))
    top = open_.orderBy("order").limit(cap).select("id")
    high = open_.join(top, "id", "left_semi").select(F.concat(F.lit("1|"), "order").alias("rank"), F.col("open").alias("block"))
    low = open_.join(top, "id", "left_anti").select(F.concat(F.lit("3|"), "order").alias("rank"), F.col("bullet").alias("block"))
    mark = lambda rows, rank, text: rows.limit(1).select(F.lit(rank).alias("rank"), F.lit(text).alias("block"))
    follow = high.union(low).union(mark(high, "0|", HIGHLIGHT)).union(mark(low, "2|", OVERFLOW)).select(F.lit(2).alias("section"), "rank", "block")
    closed = stories.where("state = 'RESOLVED'").select(F.lit(6).alias("section"), F.col("id").alias("rank"), F.col("closed").alias("block"))
    return worst.union(material).union(follow).union(closed)


def section_data(views: DataFrame, sources: DataFrame, arcs: DataFrame) -> DataFrame:
    """(section, rank, line): what the writer is told of each of the sections 0 to 6."""
    clusters, stories = cluster_blocks(views, sources), arc_blocks(arcs)
    rank = F.concat_ws("|", F.col("final_severity").cast("string"), "cluster_id")
    pick = lambda rows, test, section, order, line: rows.where(test).select(F.lit(section).alias("section"), order.alias("rank"), line.alias("line"))
    count = F.concat(F.lit(" · ("), F.coalesce("n_sources", F.lit(0)).cast("string"), F.lit(" kaynak)"))
    routine = F.concat(F.lit("- "), _title(), F.lit(" · "), F.coalesce("category", F.lit(UNCLASSIFIED)), count, _after(" · ", F.col("arc_id")))
    out = pick(clusters, "final_severity <= 2", 0, rank, F.col("prompt"))
    out = out.union(_by_category(clusters.where("final_severity = 3"), "prompt").select(F.lit(1), "rank", "block"))
    out = out.union(pick(stories, "state = 'OPEN'", 2, F.concat_ws("|", F.col("peak_severity").cast("string"), "id"), F.col("prompt")))
    out = out.union(pick(clusters, "final_severity = 4", 3, rank, routine)).union(pick(clusters, "final_severity <= 4 and is_social_only", 4, rank, F.concat(F.lit("- "), _title())))
    out = out.union(pick(clusters, "final_severity = 5", 5, rank, F.concat(F.lit("- "), _title(), count)))
    return out.union(pick(stories, "state = 'RESOLVED'", 6, F.concat_ws("|", F.col("peak_severity").cast("string"), "id"), F.col("prompt")))


def assemble_report(lines: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, report): all eight sections in order, the empty note where a section has no lines.

    ``lines``: (run, section, rank, line); a run's report is one text, so its lines meet in one group.
    """
    spark = lines.sparkSession
    template = spark.createDataFrame([(i, s, e) for i, (s, e) in enumerate(zip(SECTIONS, EMPTY))], "section int, marker string, note string")
    text = lines.groupBy(run, "section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: x.line), "\n").alias("body"))
    grid = lines.select(run).distinct().crossJoin(F.broadcast(template)).join(text, [run, "section"], "left")
    part = F.concat("marker", F.lit("\n\n"), F.coalesce("body", "note"))
    return grid.groupBy(run).agg(F.concat(F.lit(TITLE + "\n\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section", part.alias("p")))), lambda x: x.p), "\n\n"), F.lit("\n")).alias("report"))


def validate_reports(reports: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, errors): an empty report (then nothing else), another first non-blank line than the title, missing, repeated, unexpected, unmarked or misordered sections, sections without content, and what a model may have left: placeholders, its prompt, its reasoning."""
    reports = materialize(reports.select(key, "report"), "reports")  # read once for each kind of error
    blank = F.coalesce(F.col("report").rlike(r"(?U)^\s*$"), F.lit(True))
    empty = reports.where(blank).select(key, F.array(F.lit("empty")).alias("errors"))
    reports = reports.where(~blank)
    title = F.trim(F.filter(F.split("report", "\n"), lambda x: F.trim(x) != "")[0])
    lines = reports.select(key, F.posexplode(F.split("report", "\n")).alias("pos", "line"))
    number = F.coalesce(*(F.when(F.col("line") == s, F.lit(i)) for i, s in enumerate(SECTIONS)), F.when(F.col("line").startswith("## "), F.lit(-1)))
    order = Window.partitionBy(key).orderBy("pos")
    marked = lines.withColumn("n", number).withColumn("at", F.last("n", ignorenulls=True).over(order))
    heads = marked.where("n is not null").withColumn("before", F.max("n").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    text = F.when(F.col("n").isNull() & (F.trim("line") != ""), 1)
    filled = marked.where("at >= 0").groupBy(key, "at").agg(F.count(text).alias("c")).where("c = 0").select(key, F.concat(F.lit("empty_section:"), F.col("at").cast("string")).alias("e"))
    grid = reports.select(key, F.explode(F.sequence(F.lit(0), F.lit(len(SECTIONS) - 1))).alias("n"))
    counts = grid.join(heads.groupBy(key, "n").count(), [key, "n"], "left")
    named = lambda label: F.concat(F.lit(label + ":"), F.col("n").cast("string"))
    inside = lambda test, label: marked.where((F.col("at") >= 0) & F.col("n").isNull() & test).select(key, F.concat(F.lit(label + ":"), F.col("at").cast("string")).alias("e"))
    echo = F.contains(F.col("line"), F.lit(PROMPT_ECHOES[0]))
    for x in PROMPT_ECHOES[1:]:
        echo = echo | F.contains(F.col("line"), F.lit(x))
    found = [
        reports.where(title != TITLE).select(key, F.lit("no_title").alias("e")),
        counts.where("count is null").select(key, named("missing").alias("e")), counts.where("count > 1").select(key, named("repeated").alias("e")),
        heads.where("n < 0").select(key, F.lit("unexpected").alias("e")), heads.where((F.col("n") < 0) & ~F.col("line").startswith("## ❯ ")).select(key, F.lit("unmarked").alias("e")),
        heads.where("n >= 0 and before > n").select(key, named("order").alias("e")), filled,
        inside(F.contains(F.col("line"), F.lit(PLACEHOLDER)), "placeholder"),
        inside(echo, "prompt_echo"), inside(F.col("line").rlike(r"^\s*(?:Adım\s*\d+|Gerekçe)\s*:"), "reasoning"),
    ]
    rows = found[0]
    for x in found[1:]:
        rows = rows.union(x)
    errors = rows.groupBy(key).agg(F.sort_array(F.collect_set("e")).alias("errors"))
    return reports.select(key).join(errors, key, "left").select(key, F.coalesce("errors", F.array().cast("array<string>")).alias("errors")).union(empty)


def system_log(runs: DataFrame, header: DataFrame, failed: DataFrame, failed_sections: DataFrame) -> DataFrame:
    """(run_id, text): a run's stages, what its report holds, failed sources and failed sections.

    ``runs``: run_id and stages_done; ``header``: a row of ``report_header`` a run; ``failed_sections``: run_id and the section's number.
    """
    bold = lambda name, value: F.concat(F.lit(f"**{name}** · "), value)
    listed = lambda rows, text: rows.groupBy("run_id").agg(F.array_join(F.sort_array(F.collect_list(text)), " · ").alias("names"))
    sources = listed(failed, F.concat("source_id", F.lit(" ("), "status", F.lit(")"))).withColumnRenamed("names", "sources")
    titles = F.element_at(F.array(*(F.lit(s.removeprefix("## ❯ ")) for s in SECTIONS)), F.col("section") + 1)
    sections = failed_sections.groupBy("run_id").agg(F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("section", titles.alias("t")))), lambda x: x.t), " · ").alias("sections"))
    rows = runs.join(header, "run_id", "left").join(sources, "run_id", "left").join(sections, "run_id", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    lines = [
        bold("Run", F.concat(F.lit("`"), "run_id", F.lit("`"))), bold("Çalıştırılan aşamalar", F.coalesce(F.nullif(F.array_join("stages_done", " · "), F.lit("")), F.lit(NONE))), bold("İşlenen olay", number("n_clusters")),
        bold("Açık hikaye", number("n_open")), bold("Toplam arc", number("n_arcs")), bold("Zirve DEFCON", F.coalesce("peak", F.lit(5)).cast("string")), bold("Başarısız kaynak", F.coalesce("sources", F.lit(NONE))),
        F.when(F.col("sections").isNotNull(), bold("Başarısız bölüm üretimi", F.col("sections"))),
    ]
    return rows.select("run_id", F.concat_ws("\n", *lines).alias("text"))


def section_prompts(data: DataFrame, rules_text: str = "", run: str = "run_id") -> DataFrame:
    """(run, section, prompt): the writer's input for each of the sections 0 to 6, from (run, section, rank, line) of ``section_data``; a section without lines has its empty note."""
    spark = data.sparkSession
    grid = spark.createDataFrame([(i, SECTIONS[i], EMPTY[i]) for i in range(7)], "section int, marker string, note string")
    body = data.where("section <= 6").groupBy(run, "section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: x.line), "\n").alias("body"))
    rows = data.select(run).distinct().crossJoin(F.broadcast(grid)).join(body, [run, "section"], "left")
    parts = [F.concat(F.lit("Bölüm: "), F.col("marker")), F.nullif(F.lit(rules_text), F.lit("")), F.concat(F.lit("BÖLÜM VERİSİ:\n"), F.coalesce("body", "note"))]
    return rows.select(run, "section", F.concat_ws("\n\n", *parts).alias("prompt"))


def voiced_scope(reports: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, pos, section, line) of the lines to be read aloud: title, sections 0 to 2, the last one; without source lines in section 1 and without stalled marks and the overflow block of section 2."""
    lines = reports.select(key, F.posexplode(F.split("report", "\n")).alias("pos", "line"))
    number = F.coalesce(*(F.when(F.trim("line") == s, F.lit(i)) for i, s in enumerate(SECTIONS)))
    order = Window.partitionBy(key).orderBy("pos")
    placed = lines.withColumn("section", F.coalesce(F.last(number, ignorenulls=True).over(order), F.lit(-1)))
    placed = placed.withColumn("over", F.max(F.when(F.trim("line") == OVERFLOW, 1).otherwise(0)).over(Window.partitionBy(key, "section").orderBy("pos")))
    source = F.col("line").rlike(r"^\*?\*?Kaynaklar\*?\*?\s*[·:]")
    quiet = ((F.col("section") == 1) & source) | ((F.col("section") == 2) & ((F.col("over") == 1) | (F.trim("line") == STALLED)))
    return placed.where(F.col("section").isin(-1, 0, 1, 2, len(SECTIONS) - 1) & ~quiet).select(key, "pos", "section", "line")


# How short forms are read.
ABBREVIATIONS = (
    ("TCMB", "Te Ce Me Be"), ("BDDK", "Be De De Ka"), ("SPK", "Se Pe Ka"), ("EPDK", "E Pe De Ka"), ("BIST", "Bist"), ("KAP", "Ka A Pe"), ("BES", "Be E Se"), ("RTÜK", "Re Te Ü Ka"), ("TÜİK", "Tüik"), ("TBMM", "Te Be Me Me"), ("AYM", "A Ye Me"),
    ("YSK", "Ye Se Ka"), ("HSK", "Ha Se Ka"), ("MHP", "Me He Pe"), ("CHP", "Ce He Pe"), ("AKP", "A Ka Pe"), ("DEM", "Dem"), ("MİT", "Mit"), ("AB", "A Be"), ("BM", "Be Me"), ("NATO", "Nato"),
)


# The words of severities, and what is rewritten for the voice, in order.
NUMBERS = ("Bir", "İki", "Üç", "Dört", "Beş")
SPOKEN = (
    (r"(?m)^\*?\*?Kaynaklar\*?\*?\s*·.*$", ""), (r"(?m)^#{1,6}\s*", ""), (r"\*\*([^*\n]+)\*\*", "$1"), (r"\*([^*\n]+)\*", "$1"), (r"\[([^\]\n]+)\]\([^)\n]+\)", "$1"), ("`", ""), (r"(?m)^---[ \t]*$", ""), (r"❯[ \t]*", ""),
    (r"arc_\d{8}_0*(\d+)", "hikaye $1"), *((rf"\bDEFCON\b\s*[·:-]?\s*{i + 1}", f"Defkon {w}") for i, w in enumerate(NUMBERS)), (r"\bDEFCON\b", "Defkon"),
)


def speech_text(lines: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, text): what is read aloud from (key, pos, line).

    In a run of arc bullets (with an id in backticks and an age at the end) the dormant ones go; if all are
    dormant, one note stands for them and for the subheader before them, and a note isn't said twice in
    a row. Then sources, markup, arc ids, severities and short forms are rewritten and blank lines collapsed.
    """
    order = Window.partitionBy(key).orderBy("pos")
    after = order.rowsBetween(1, Window.unboundedFollowing)
    dormant = F.col("line").rlike(r"·\s*\d+\s+gün\s+önce\s*$")
    bullet = F.col("line").rlike(r"^\s*-\s.*`[^`]+`") & (dormant | F.col("line").rlike(r"·\s*(?:bugün|dün)\s*$"))
    rows = lines.withColumn("b", bullet).withColumn("d", dormant).withColumn("solid", F.trim("line") != "")
    rows = rows.withColumn("g", F.sum(F.when(F.col("b"), 0).otherwise(1)).over(order))
    block = Window.partitionBy(key, "g", "b")
    rows = rows.withColumn("quiet", F.col("b") & (F.count_if(~F.col("d")).over(block) == 0)).withColumn("first", F.min("pos").over(block) == F.col("pos"))
    rows = rows.withColumn("before", F.first(F.when(F.col("solid"), F.col("quiet")), ignorenulls=True).over(after))
    gone = (F.col("b") & F.col("d") & ~(F.col("quiet") & F.col("first"))) | (~F.col("b") & F.coalesce("before", F.lit(False)) & (~F.col("solid") | F.col("line").rlike(r"^\s*#{2,6}\s")))
    said = rows.where(~gone).select(key, "pos", "solid", F.when(F.col("quiet"), F.lit(DORMANT_NOTE)).otherwise(F.col("line")).alias("line"))
    last = F.last(F.when(F.col("solid"), F.col("line")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    said = said.withColumn("last", last).where(~((F.col("line") == DORMANT_NOTE) & F.coalesce(F.col("last") == DORMANT_NOTE, F.lit(False))))
    text = said.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x.line), "\n").alias("text"))
    for pattern, to in (*SPOKEN, *((rf"(?U)\b{a}\b", b) for a, b in ABBREVIATIONS)):
        text = text.withColumn("text", F.regexp_replace("text", pattern, to))
    return text.select(key, F.regexp_replace(F.regexp_replace("text", r"\n{3,}", "\n\n"), r"^\s+|\s+$", "").alias("text"))
