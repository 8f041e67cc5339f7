"""Column functions on text, keys and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Turkish letters that lower() gets wrong, and the letters folded to ASCII.
_DOTTED = ("İI", "iı")
_FOLDED = ("ışğüöç", "isguoc")


def _letters(text: Column, old: str, new: str) -> Column:
    """Letters replaced one after the other, none of ``new`` being in ``old``: replace() looks for bytes, translate() makes a string of every letter."""
    for a, b in zip(old, new):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def article_id(source: Column, url: Column) -> Column:
    """Key of an article: the hash of source and URL; null if either is (A5)."""
    return F.sha2(F.concat(source, F.lit("|"), url), 256)


def tr_lower(text: Column) -> Column:
    """Lower case under Turkish rules: İ and I become i and ı first."""
    return F.lower(_letters(text, *_DOTTED))


def fold_key(text: Column) -> Column:
    """Case- and diacritic-insensitive key."""
    return _letters(tr_lower(text), *_FOLDED)


def tokens(text: Column) -> Column:
    """Non-empty runs between Unicode white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def lead(text: Column, size: int = 500) -> Column:
    """The first ``size`` code points."""
    return F.substring(text, 1, size)


def word_count(text: Column) -> Column:
    """Number of white-space tokens; 0 for null."""
    return F.coalesce(F.size(tokens(text)), F.lit(0))


def embedding_input(title: Column, lead_: Column) -> Column:
    """Title, a blank line, lead; trimmed."""
    return F.regexp_replace(F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(lead_, F.lit(""))), r"(?U)^\s+|\s+$", "")


def script_counts(text: Column) -> dict[str, Column]:
    """Characters by script, and the control characters other than line feed, carriage return and tab."""
    count = lambda keep: F.length(F.regexp_replace(text, f"[^{keep}]", ""))
    return {
        "n_latin": count(r"\p{IsLatin}"), "n_cyrillic": count(r"\p{IsCyrillic}"), "n_arabic": count(r"\p{IsArabic}"), "n_han": count(r"\p{IsHan}"),
        "n_digit": count(r"0-9"), "n_control": count(r"\x00-\x08\x0B\x0C\x0E-\x1F\x7F"),
    }


def utc_naive(text: Column) -> Column:
    """An ISO text as naive UTC: an offset is applied, no offset means UTC, what is no time is null."""
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def local_date(ts: Column) -> Column:
    """The calendar date three hours east of UTC."""
    return F.to_date(ts + F.expr("INTERVAL 3 HOURS"))


def run_id_of(ts: Column) -> Column:
    """run_YYYYMMDD of a time."""
    return F.concat(F.lit("run_"), F.date_format(ts, "yyyyMMdd"))
