"""Landed rows to clean text, language and entities."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsline.functions.text import fold_key, lead, tokens, word_count
from newsline.plans.storage import materialize
from newsline.sources.pages import unescape

COMMENTS = "\n\n--- Yorumlar ---\n\n"  # fixed value
SHORT_HTML = 100
POST = "selftext string, comments array<struct<body:string>>"


def strip_markup(html: Column) -> Column:
    """Tags out, references decoded, white space collapsed."""
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(html, "<[^>]*>", " ")), r"(?U)\s+", " "))


def html_main_text(html: Column, selector: str = "article") -> Column:
    """Text without scripts, menus and other boilerplate blocks; the selector's text if that is under 100 characters and shorter.

    Approximates a boilerplate remover by element names and advert classes; see the llm subpackage for one with block rules.
    """
    dropped = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|nav|footer|aside|header|form|noscript)\b.*?</\1>", " ")
    dropped = F.regexp_replace(dropped, r'(?is)<div[^>]*class="[^"]*\b(?:ad|ads|advert|banner)\b[^"]*"[^>]*>.*?</div>', " ")
    body = F.regexp_replace(dropped, r"(?is)<head\b.*?</head>", " ")
    found = F.regexp_extract(body, rf"(?is)<{selector}\b[^>]*>(.*)</{selector}>", 1)
    main, chosen = strip_markup(F.regexp_replace(body, r"(?is)^.*?<article\b[^>]*>(.*)</article>.*$", "$1")), strip_markup(found)
    return F.when((F.length(main) < SHORT_HTML) & (F.length(chosen) > F.length(main)), chosen).otherwise(main)


def feed_text(body: Column, summary: Column) -> Column:
    """Body, else summary; markup is stripped if there is any, and kept if nothing else is left."""
    raw = F.coalesce(F.nullif(F.trim(body), F.lit("")), F.trim(summary), F.lit(""))
    bare = strip_markup(raw)
    return F.when(raw.rlike("<[a-zA-Z/!][^>]*>"), F.when(bare == "", raw).otherwise(bare)).otherwise(raw)


def clean_page_text(body: Column) -> Column:
    """Lines that are only a page number go, runs of blanks become one, three or more line ends two."""
    text = F.regexp_replace(body, r"(?im)^[ \t]*(?:sayfa[ \t]*)?[-–—]?[ \t]*\d{1,4}[ \t]*[-–—]?[ \t]*$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def post_text(json: Column) -> Column:
    """Self text, a separator, the non-blank comments; broken JSON is empty."""
    post = F.from_json(json, POST)
    comments = F.filter(F.transform(F.coalesce(post.comments, F.array().cast("array<struct<body:string>>")), lambda c: F.trim(c.body)), lambda c: c.isNotNull() & (c != ""))
    text = F.trim(F.coalesce(post.selftext, F.lit("")))
    joined = F.concat(text, F.lit(COMMENTS), F.array_join(comments, "\n\n"))
    return F.regexp_replace(F.when(F.size(comments) > 0, joined).otherwise(text), r"(?U)^\s+|\s+$", "")


def normalize(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, source_id, kind, title, lead, body, word_count): text by the source's kind; unknown sources count as HTML.

    ``raw``: id, source_id, title, content. Rows of a kind without extractor have kind skipped and no body.
    """
    rows = raw.join(sources.select(F.col("id").alias("source_id"), "kind"), "source_id", "left")
    kind, content = F.coalesce("kind", F.lit("HTML")), F.coalesce("content", F.lit(""))
    body = F.when(kind == "HTML", html_main_text(content)).when(kind == "RSS", feed_text(content, F.lit(""))).when(kind == "PDF", clean_page_text(content)).when(kind == "API", post_text(content))
    rows = rows.select("id", "source_id", F.when(body.isNull(), "skipped").otherwise(kind).alias("kind"), "title", body.alias("body"))
    return rows.select("id", "source_id", "kind", "title", lead(F.col("body")).alias("lead"), "body", word_count(F.col("body")).alias("word_count"))


def stop_profiles(labelled: DataFrame, per_language: int = 60) -> DataFrame:
    """(language, token, weight): the most frequent words of each language in labelled texts, weighted by their share."""
    words = labelled.select("language", F.explode(tokens(F.lower("body"))).alias("token")).groupBy("language", "token").agg(F.count("*").alias("n"))
    total = words.groupBy("language").agg(F.sum("n").alias("total"))
    rank = F.row_number().over(Window.partitionBy("language").orderBy(F.col("n").desc(), "token"))
    return words.withColumn("_rank", rank).where(F.col("_rank") <= per_language).join(total, "language").select("language", "token", (F.col("n") / F.col("total")).alias("weight"))


def tag_language(df: DataFrame, profiles: DataFrame, fallback: str = "tr") -> DataFrame:
    """(id, language) of (id, body): unknown under 20 characters, the profile with the highest sum, the fallback if none has any.

    ``profiles`` has a fixed number of words a language.
    """
    hits = df.select("id", F.explode(tokens(F.lower("body"))).alias("token")).join(profiles, "token").groupBy("id", "language").agg(F.sum("weight").alias("s"))
    best = hits.groupBy("id").agg(F.max_by("language", F.struct("s", "language")).alias("found"))
    short = F.length(F.trim(F.coalesce("body", F.lit("")))) < 20
    return df.join(best, "id", "left").select("id", F.when(short, "unknown").otherwise(F.coalesce("found", F.lit(fallback))).alias("language"))


#: What names are made of; anything else is a boundary.
WORD, GAP = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]"


def entity_vocabulary(entries: DataFrame) -> DataFrame:
    """(surface, canonical, type): a row a name or alias, by its folded form; of equal forms the smallest canonical; blank forms go."""
    rows = entries.select("canonical", "type", F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form"))
    rows = rows.select(F.trim(fold_key(F.col("form"))).alias("surface"), "canonical", "type").where("surface != ''")
    return rows.groupBy("surface").agg(F.min(F.struct("canonical", "type")).alias("e")).select("surface", "e.canonical", "e.type")


#: Pieces whose lengths are summed together, and such sums that are added up together. Pieces are read one by one: slice() copies the whole array at each call.
PIECES, SUMS = 16, 32
#: Slots of the tables that tell which words and runs of words may be of names: half a MB each, however many names there are.
SLOTS = 1 << 16


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once; as a column of its own it might be put into a lambda and worked out at each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _steps(size: Column, by: int) -> Column:
    """0, by, 2 by, ... below the size; 0 at least."""
    return F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(by))


def _running(sizes: Column) -> Column:
    """0 and the running sums of a short array: each step copies what is there."""
    return F.aggregate(sizes, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))


def _starts(pieces: Column) -> Column:
    """Struct of what start_of() needs: lengths of the pieces, where blocks of PIECES begin within groups of SUMS blocks, where the groups begin."""
    lengths = F.concat(F.transform(pieces, lambda x: F.length(x)), F.array_repeat(F.lit(0), PIECES))
    block = lambda n, at: reduce(add, [F.get(n, at + i) for i in range(PIECES)])
    sums = lambda n: F.transform(_steps(F.size(pieces), PIECES), lambda at: block(n, at))
    some = lambda x, at: F.transform(F.sequence(at, F.least(at + SUMS, F.size(x)) - 1), lambda i: F.get(x, i))
    groups = lambda n: _let(sums(n), lambda x: F.transform(_steps(F.size(x), SUMS), lambda at: _running(some(x, at))))
    whole = lambda n: _let(groups(n), lambda g: F.struct(n.alias("lengths"), g.alias("within"), _running(F.transform(g, lambda x: F.element_at(x, -1))).alias("groups")))
    return _let(lengths, whole)


def _start_of(starts: Column, at: Column) -> Column:
    """Characters before a piece."""
    group, block = F.floor(at / (PIECES * SUMS)).cast("int"), F.floor(at % (PIECES * SUMS) / PIECES).cast("int")
    inside = F.when(at % PIECES == 0, 0).otherwise(F.aggregate(F.sequence(at - at % PIECES, at - 1), F.lit(0), lambda n, i: n + F.get(starts.lengths, i)))
    return F.get(starts.groups, group) + F.get(F.get(starts.within, group), block) + inside


def _slot(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(SLOTS)).cast("int")


def _slots(rows: DataFrame, key: str, value: Column) -> Column:
    """An array with the distinct values of the rows whose key has the hash i at place i, null where there are none; of a fixed size."""
    filled = rows.groupBy(_slot(F.col(key)).alias("slot")).agg(F.collect_set(value).alias("values"))
    every = rows.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot")).join(filled, "slot", "left")
    return every.agg(F.sort_array(F.collect_list(F.struct("slot", "values"))).alias("s")).select(F.transform("s", lambda x: x["values"])).scalar()


_HIT = "struct<start:int,back:int,surface:string,loops:boolean,canonical:string,type:string>"


def _no_self_overlap(hits: Column) -> Column:
    """Of occurrences of one surface that overlap each other the earlier stay; by (start, -end)."""
    state = lambda surface, upto, k: F.struct(surface.alias("surface"), upto.alias("upto"), k.alias("k"))
    same = lambda a, x: (a.surface == x.surface) & (x.hit.start < a.upto)
    begin = state(F.lit(""), F.lit(0), F.array().cast(f"array<{_HIT}>"))
    named = F.sort_array(F.transform(F.filter(hits, lambda x: x.loops), lambda x: F.struct(x.surface.alias("surface"), x.alias("hit"))))
    kept = F.aggregate(named, begin, lambda a, x: F.when(same(a, x), a).otherwise(state(x.surface, -x.hit.back, F.concat(a.k, F.array(x.hit)))), lambda a: a.k)
    return F.when(F.exists(hits, lambda x: x.loops), F.sort_array(F.concat(F.filter(hits, lambda x: ~x.loops), kept))).otherwise(hits)


#: Hits that are gone through together: each step copies what it has of them.
HITS = 64


def _leftmost_longest(hits: Column) -> Column:
    """Hits sorted by (start, -end) without those that begin before the last one kept ends."""
    state = lambda upto, k: F.struct(upto.alias("upto"), k.alias("k"))
    step = lambda a, x: F.when(x.start >= a.upto, state(-x.back, F.concat(a.k, F.array(x)))).otherwise(a)
    some = lambda at: F.transform(F.sequence(at, F.least(at + HITS, F.size(hits)) - 1), lambda i: F.get(hits, i))
    block = lambda upto, at: F.aggregate(some(at), state(upto, F.array().cast(f"array<{_HIT}>")), step)
    blocks = lambda a, at: _let(block(a.upto, at), lambda b: state(b.upto, F.concat(a.k, F.array(b.k))))
    return F.aggregate(_steps(F.size(hits), HITS), state(F.lit(0), F.array().cast(f"array<array<{_HIT}>>")), blocks, lambda a: F.flatten(a.k))


def extract_entities(df: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, start, end, text, type): names at word boundaries in folded text, half-open spans from 0.

    A text is a run of pieces, words and what stands between. Names are a trie of two levels: the first word
    tells which numbers of words names that begin so have, and only at words that begin a name the run of that
    many words is looked up as a whole, with equal strings, however many names share the first word. What a name has
    before its first and behind its last letter or digit is compared with the pieces beside. Work grows with the
    words of the texts and with the lengths at a first word, not with the names.

    Both levels are asked where the text is: two tables of SLOTS hashes, of first words and of whole runs, leave out
    what is of no name, and what passes meets the names by equal strings. So no text and no word of it moves, only runs that
    may be names. Very many names fill the tables; then more runs move, and the result is the same.

    Names have any length; one without any letter or digit never matches. Of occurrences of one name that overlap, the
    earlier ones count; of overlapping names the earliest start stays, then the longest. ``id`` is unique.
    """
    # Folding keeps the number of characters, so places in the folded text are places in the text.
    folded = df.where("body is not null").select("id", fold_key(F.col("body")).alias("t"))
    core = F.regexp_extract("surface", f"(?s){WORD}(?:.*{WORD})?", 0)
    named = vocabulary.select("surface", "canonical", "type", core.alias("core")).where("core != ''")
    named = named.select("*", F.regexp_extract("surface", f"^{GAP}*", 0).alias("lead")).select("*", F.expr("substring(surface, length(lead) + length(core) + 1)").alias("trail"))
    named = named.select("*", F.regexp_extract_all("core", F.lit(WORD + "+"), F.lit(0)).alias("all"))
    # A name that overlaps itself has its first word twice, or meets itself with its edges.
    loops = ((F.col("lead") != "") & (F.col("trail") != "")) | (F.size("all") > F.size(F.array_remove("all", F.get("all", F.lit(0)))) + 1)
    named = named.select("*", F.get("all", F.lit(0)).alias("word"), F.size("all").alias("words"), loops.alias("loops")).drop("all")
    named = materialize(named, "names")

    def runs(s: Column) -> Column:
        """Runs of words of one text that pass both tables: where they begin, and what stands beside."""
        pieces, size = s.pieces, F.size(s.pieces)
        sizes = lambda at: F.get(s.firsts, _slot(F.get(pieces, at)))
        said = lambda at, n: F.when(n == 1, F.get(pieces, at)).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), 2 * n - 2), lambda i: F.get(pieces, at + i)), ""))
        first = F.when(F.get(pieces, F.lit(0)).rlike(WORD), 0).otherwise(1)
        places = _let(first, lambda f: F.transform(_steps(size, 2), lambda i: i + f))
        places = F.filter(places, lambda at: (at < size) & sizes(at).isNotNull())
        each = F.flatten(F.transform(places, lambda at: F.transform(F.filter(sizes(at), lambda n: at + 2 * n - 1 <= size), lambda n: F.struct(at.alias("at"), n.alias("n"), said(at, n).alias("core")))))
        each = F.filter(each, lambda x: F.get(s.cores, _slot(x.core)).isNotNull())
        run = lambda x, starts: F.struct(
            x.core.alias("core"), _start_of(starts, x["at"]).alias("start"),
            F.when(x["at"] > 0, F.get(pieces, x["at"] - 1)).otherwise("").alias("before"), F.coalesce(F.get(pieces, x["at"] + 2 * x.n - 1), F.lit("")).alias("behind"),
            (x["at"] <= 1).alias("first"), (x["at"] + 2 * x.n + 1 > size).alias("last"),
        )
        return _let(_starts(pieces), lambda starts: F.transform(each, lambda x: run(x, starts)))

    pieces = F.regexp_extract_all("t", F.lit(f"{WORD}+|{GAP}+"), F.lit(0))
    # Spark puts the tables, columns without a row's own values, where they are read: no row carries them.
    tables = folded.select("*", _slots(named, "word", F.col("words")).alias("firsts"), _slots(named, "core", F.lit(1)).alias("cores"))
    seen = F.struct(pieces.alias("pieces"), "firsts", "cores")
    # The outer form: for the inner one Spark infers a filter that works the array out again.
    looked = tables.select("id", _let(seen, runs).alias("runs")).select("id", F.explode_outer("runs").alias("r")).select("id", "r.*").join(named, "core")
    # A name's edge may not touch a word: more of the piece beside is left, or the text ends there.
    left = (F.col("lead") == "") | (F.endswith("before", F.col("lead")) & ((F.length("before") > F.length("lead")) | F.col("first")))
    right = (F.col("trail") == "") | (F.startswith("behind", F.col("trail")) & ((F.length("behind") > F.length("trail")) | F.col("last")))
    start = F.col("start") - F.length("lead")
    hit = F.struct(start.cast("int").alias("start"), (-start - F.length("surface")).cast("int").alias("back"), "surface", "loops", "canonical", "type")
    hits = looked.where(left & right).groupBy("id").agg(F.sort_array(F.collect_list(hit)).alias("h"))
    found = hits.select("id", F.explode_outer(_let(_no_self_overlap(F.col("h")), _leftmost_longest)).alias("k"))
    return found.select("id", "k.start", (-F.col("k.back")).alias("end"), F.col("k.canonical").alias("text"), "k.type")


def isolate_errors(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with error): a check that is false or null makes a row bad, the first one names it."""
    error = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()))
    marked = df.withColumn("error", error)
    return marked.where("error is null").drop("error"), marked.where("error is not null")
