"""Corroboration and lifecycle rules as column expressions. Severity runs from 0, worst, to 5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The source bands and the side each belongs to.
PRIMARY = ("primary_gov", "primary_market", "primary_judicial")
SOCIAL = ("social_x", "social_reddit")
SIDES = {"gov": ("gov_aligned",), "opposition": ("opposition",), "neutral": ("centrist", "independent", "international")}
KNOWN = (*PRIMARY, *SOCIAL, *(b for side in SIDES.values() for b in side))
HIGH, MIDDLE, LOW = "YÜKSEK", "ORTA", "DÜŞÜK"
DORMANT_DAYS, EXPIRE_DAYS, BOOTSTRAP_DAYS = 2, 7, 7


def _array(values) -> Column:
    return F.array(*map(F.lit, values))


def known_bands(bands: Column) -> Column:
    """Bands the rules know; others are stored but not judged."""
    return F.array_intersect(bands, _array(KNOWN))


def ideological_sides(bands: Column) -> Column:
    """Names of the sides present, in a fixed order."""
    return F.filter(F.array(*(F.when(F.arrays_overlap(bands, _array(members)), F.lit(side)) for side, members in SIDES.items())), lambda x: x.isNotNull())


def has_primary(bands: Column) -> Column:
    return F.arrays_overlap(bands, _array(PRIMARY))


def ceiling(bands: Column) -> tuple[Column, Column]:
    """(the worst severity that the bands allow, the rule that decided)."""
    reporting, sides = F.size(F.array_except(bands, _array(SOCIAL))), F.size(ideological_sides(bands))
    cases = [(has_primary(bands), 0, "primary"), (reporting == 0, 4, "social_only"), ((reporting >= 3) & (sides >= 2), 1, "three_bands_two_sides"), (reporting >= 2, 3, "two_bands")]
    level, rule = F.lit(4), F.lit("single_band")
    for test, value, name in reversed(cases):
        level, rule = F.when(test, value).otherwise(level), F.when(test, name).otherwise(rule)
    return level, rule


def confidence(bands: Column, articles: Column) -> Column:
    """How sure: by primary bands, sides and the number of member articles."""
    two = F.size(ideological_sides(bands)) >= 2
    return F.when(has_primary(bands) | (two & (articles >= 4)), HIGH).when(two | (articles >= 3), MIDDLE).otherwise(LOW)


def final_severity(raw: Column, level: Column) -> Column:
    """Never worse than the ceiling: the larger number."""
    return F.greatest(raw, level)


def bootstrap_demote(severity: Column, created: Column, first_run: Column, days: int = BOOTSTRAP_DAYS) -> Column:
    """One step milder, at most 5, within the first ``days`` of the first run; unchanged without runs."""
    return F.when(created < first_run + F.expr(f"INTERVAL {days} DAYS"), F.least(severity + 1, F.lit(5))).otherwise(severity)


def days_since(last: Column, now: Column) -> Column:
    """Whole calendar days, never negative, 0 for null."""
    return F.greatest(F.coalesce(F.datediff(F.to_date(now), F.to_date(last)), F.lit(0)), F.lit(0))


def freshness(days: Column, dormant: int = DORMANT_DAYS, expire: int = EXPIRE_DAYS) -> Column:
    """FRESH, DORMANT or EXPIRED by age in days."""
    return F.when(days >= expire, "EXPIRED").when(days >= dormant, "DORMANT").otherwise("FRESH")


def recency_label(days: Column) -> Column:
    """Today, yesterday or so many days ago, in Turkish."""
    return F.when(days <= 0, "bugün").when(days == 1, "dün").otherwise(F.concat(days.cast("string"), F.lit(" gün önce")))


def social_only(bands: Column) -> Column:
    """There are bands and all are social."""
    return (F.size(bands) > 0) & (F.size(F.array_except(bands, _array(SOCIAL))) == 0)
