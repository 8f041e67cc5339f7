"""What moves of the articles, and that nothing else changes."""

import datetime as dt
from itertools import takewhile

from newsline.operators.stories import eligible_articles as eligible
from newsline.plans import adapters
from newsline.registry import QUERIES


def tables(write):
    at = dt.datetime(2024, 1, 3, 5)
    write("documents", [(i, f"head {i}\nw1  w2\tw3 " * (i + 1), "en" if i % 2 else None, f"src{i % 20}", 5) for i in range(30)] + [(30, None, "en", "src1", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    write("embeddings", [(0, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    write("pages", [(0, "u", "h")], "page_id long, url string, html string")
    return write("events", [(i, at, i, "view", 1.0, "") for i in range(31)], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")


def test_articles_with_equals_the_view(spark, write):
    adapters.load(spark, tables(write))
    view = spark.table("articles")
    assert sorted(map(str, adapters.articles_with(spark).select(*view.columns).collect())) == sorted(map(str, view.collect()))


def test_no_join_moves_a_body(spark, write):
    """The text is last read, by the count of words, below every join."""
    plan = QUERIES["eligible_articles"](spark, tables(write))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    at = next(i for i, x in enumerate(plan) if "text#" in x)
    below = takewhile(lambda x: depth(x) > depth(plan[at]), plan[at + 1 :])
    assert "Join" in "".join(plan[:at]) and "Join" not in "".join(below)


def test_operator_takes_body_or_count(spark):
    rows = spark.sql("SELECT '1' AS id, 's' AS source_id, CAST(NULL AS STRING) AS title, 'l' AS lead, 'a b  c' AS body, TIMESTAMP '2024-01-01' AS published_at, CAST(NULL AS STRING) AS language")
    none, touched = rows.where("false").select("id"), rows.select("source_id")
    sources = spark.sql("SELECT 's' AS id, CAST(NULL AS STRING) AS band")
    assert tuple(eligible(rows, sources, none, touched).drop("published_at").first()) == ("1", "s", "", "", "l", "unknown", 3)
