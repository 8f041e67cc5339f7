"""The queries of the news operators and their SQL twins.

Each query applies an operator to whole tables shaped by ``plans.adapters``; the SQL beside it
gives the same rows in DuckDB. Operators that SQL can't express have no SQL here and are compared
with plain Python in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsline.plans.adapters import WITH, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a function of a session whose news tables are views; ``sql`` starts at the SELECT or at more CTEs after a comma."""

    def put(build: Callable[[SparkSession], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(load(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = WITH + sql.strip()
        return build

    return put


from newsline.queries import ingest, ledger, news, report, text, vectors  # noqa: E402, F401
