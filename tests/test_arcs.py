"""Arcs whose ids are not unique."""

from pyspark.sql import functions as F

from newsline.operators.arcs import active_arcs


def test_an_id_that_stands_twice_gives_two_rows_not_four(spark):
    arcs = spark.sql("SELECT 'arc_1234' AS id, 'OPEN' AS state, CAST(NULL AS TIMESTAMP) AS last_update_at, CAST(p AS INT) AS peak_severity FROM VALUES (1), (NULL) AS t(p)")
    arcs = arcs.union(arcs.withColumn("id", F.lit("arc_0001")))
    found = active_arcs(arcs, arcs.where("id = 'arc_1234'").select("id"), F.expr("TIMESTAMP '2024-01-12 22:30:00'"))
    assert sorted(map(tuple, found.select("id", "peak_severity").collect())) == [("arc_1234", 1), ("arc_1234", 5)]
