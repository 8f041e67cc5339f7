"""Connected components by alternating star contractions on DataFrames.

Large-star hangs a node's larger neighbours on its smallest one, small-star does so with
the smaller ones; edges never multiply, and a graph of n nodes settles in O(log n) rounds.
Hubs are joined, never collected, so AQE may split them. With long ids each task first
contracts its own edges, at most ``LOCAL_EDGES`` at a time, to stars: the same components
with fewer edges, and small graphs need no further round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from newsline.plans.storage import scratch

LOCAL_EDGES = 1_000_000


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a written table, with their number and a hash of them all taken on the way."""
    spark, seen, path = edges.sparkSession, Observation(), scratch(edges.sparkSession, "cc")
    edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).write.parquet(path)
    return spark.read.schema(edges.schema).parquet(path), (seen.get["n"], seen.get["h"])


def _stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Each node of these edges with the smallest node that they reach from it."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        np.minimum.at(low, label, low)
        low = low[low]
        if (low == label).all():
            break
        label = low
    far = label != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[label[far]])], ["u", "v"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= LOCAL_EDGES:
            yield _stars(*map(np.concatenate, zip(*held)))
            held, n = [], 0
    if n:
        yield _stars(*map(np.concatenate, zip(*held)))


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 50) -> DataFrame:
    """(node, component): component is the smallest node that the edges reach.

    Nodes without an edge to another node aren't listed; nulls, loops and repeated edges
    are dropped. ``max_rounds`` only guards against a fault: it raises, never truncates.
    """
    e = (
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"), F.col(src).alias("_s"), F.col(dst).alias("_d"))
        .where("_s is not null and _d is not null and u != v")
        .select("u", "v")
        .distinct()
    )
    local = isinstance(e.schema["u"].dataType, LongType)
    e, before = _written(e.mapInArrow(_contract, e.schema) if local else e)
    if not before[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u")
        e = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).where("u != v").distinct()
        e, after = _written(e)
        if after == before:
            nodes = e.select(F.explode(F.array("u", "v")).alias("node"), F.col("v").alias("component"))
            return nodes.groupBy("node").agg(F.min("component").alias("component"))
        before = after
    raise RuntimeError(f"components have not settled in {max_rounds} rounds")
