import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from newsline import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
there = pytest.mark.skipif(not os.path.isdir(SF), reason="the input tables aren't here")


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(str([None if not isinstance(v, (list, dict, str)) and pd.isna(v) else round(float(v), 6) if isinstance(v, float) else v for v in r]) for r in df.astype(object).values.tolist())


def test_names_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(registry.QUERIES) > 80


@there
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@there
@pytest.mark.parametrize("name", ["registry_violations", "insert_ignore_new", "page_links", "page_times", "extracted_entities", "hashed_bow", "minted_ids", "promotion_log", "folded_arcs", "resolved_arcs", "section_lines", "overridden_clusters", "feed_items", "gazette_items", "normalized_articles", "html_main_texts", "tagged_languages", "streamed_articles", "story_members", "folded_arc_state", "found_in_stories", "failure_report", "section_prompts", "spoken_reports"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(registry.ORACLE_SQL[name]).df())


@there
@pytest.mark.parametrize("name", ["extracted_entities", "promotion_log", "hashed_bow", "section_lines", "html_main_texts"])
def test_native_plans_have_no_python(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan and "CartesianProduct" not in plan
