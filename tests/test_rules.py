import pytest
from pyspark.sql import functions as F

from newsline.functions import rules, text

CASES = [
    (["primary_gov"], 0, "primary", 0), (["primary_market", "social_x"], 0, "primary", 0), ([], 4, "social_only", 0), (["social_x", "social_reddit"], 4, "social_only", 0),
    (["gov_aligned"], 4, "single_band", 1), (["gov_aligned", "social_x"], 4, "single_band", 1), (["gov_aligned", "opposition"], 3, "two_bands", 2), (["centrist", "independent"], 3, "two_bands", 1),
    (["centrist", "independent", "international"], 3, "two_bands", 1), (["gov_aligned", "opposition", "centrist"], 1, "three_bands_two_sides", 3), (["gov_aligned", "centrist", "independent"], 1, "three_bands_two_sides", 2),
]


def test_ceiling_and_sides(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, bands array<string>")
    level, rule = rules.ceiling(F.col("bands"))
    got = df.select("i", level.alias("l"), rule.alias("r"), F.size(rules.ideological_sides(F.col("bands"))).alias("s")).collect()
    for r in got:
        assert (r.l, r.r, r.s) == CASES[r.i][1:], CASES[r.i]


@pytest.mark.parametrize(("bands", "n", "want"), [(["primary_gov"], 1, "YÜKSEK"), (["gov_aligned", "opposition"], 4, "YÜKSEK"), (["gov_aligned", "opposition"], 3, "ORTA"), (["centrist"], 3, "ORTA"), (["centrist"], 2, "DÜŞÜK"), ([], 0, "DÜŞÜK")])
def test_confidence(spark, bands, n, want):
    df = spark.createDataFrame([(bands, n)], "bands array<string>, n int")
    assert df.select(rules.confidence(F.col("bands"), F.col("n"))).first()[0] == want


def test_final_and_demotion(spark):
    row = spark.range(1).select(
        rules.final_severity(F.lit(2), F.lit(4)), rules.final_severity(F.lit(5), F.lit(4)), rules.bootstrap_demote(F.lit(5), F.lit("2024-01-02").cast("timestamp"), F.lit("2024-01-01").cast("timestamp")),
        rules.bootstrap_demote(F.lit(3), F.lit("2024-01-02").cast("timestamp"), F.lit("2024-01-01").cast("timestamp")), rules.bootstrap_demote(F.lit(3), F.lit("2024-01-08").cast("timestamp"), F.lit("2024-01-01").cast("timestamp")),
        rules.bootstrap_demote(F.lit(3), F.lit("2024-01-08").cast("timestamp"), F.lit(None).cast("timestamp")),
    ).first()
    assert tuple(row) == (4, 5, 5, 4, 3, 3)


def test_ages(spark):
    now = F.lit("2026-05-29 12:00:00").cast("timestamp")
    df = spark.createDataFrame([("2026-05-29 23:59:00",), ("2026-05-28 23:59:00",), ("2026-05-27 00:01:00",), ("2026-05-23 00:00:00",), ("2026-05-22 23:00:00",), ("2026-06-02 00:00:00",), (None,)], "t string")
    days = rules.days_since(F.col("t").cast("timestamp"), now)
    got = df.select(days.alias("d"), rules.freshness(days).alias("f"), rules.recency_label(days).alias("l")).collect()
    assert [(r.d, r.f) for r in got] == [(0, "FRESH"), (1, "FRESH"), (2, "DORMANT"), (6, "DORMANT"), (7, "EXPIRED"), (0, "FRESH"), (0, "FRESH")]
    assert [r.l for r in got][:3] == ["bugün", "dün", "2 gün önce"]


def test_text_functions(spark):
    row = spark.createDataFrame([("İSTANBUL Işık ÇĞŞÖÜ", " a b \n c ", None)], "a string, b string, c string").select(
        text.tr_lower(F.col("a")), text.fold_key(F.col("a")), text.word_count(F.col("b")), text.word_count(F.col("c")), text.article_id(F.col("a"), F.col("c")), text.utc_naive(F.lit("2024-01-01T03:00:00+03:00")).cast("string"), text.utc_naive(F.lit("x"))
    ).first()
    assert tuple(row) == ("istanbul ışık çğşöü", "istanbul isik cgsou", 3, 0, None, "2024-01-01 00:00:00", None)
