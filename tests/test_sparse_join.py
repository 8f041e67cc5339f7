"""The sparse similarity join against every pair, and the rows it moves on common places."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsline.operators import sparse_join as sj

SCHEMA = "id string, idx int, weight double, grp string"


def unit(counts):
    norm = np.sqrt(sum(x * x for x in counts.values()))
    return {k: x / norm for k, x in counts.items()} if norm else {}


def frame(spark, vectors):
    return spark.createDataFrame([(i, int(k), float(x), g) for i, (v, g) in vectors.items() for k, x in v.items()], SCHEMA)


def plain(vectors, threshold):
    out = {}
    for a, (x, g) in vectors.items():
        for b, (y, h) in vectors.items():
            if a < b and g == h and x and (c := sum(w * y.get(k, 0.0) for k, w in x.items())) >= threshold - 1e-12:
                out[a, b] = round(c, 9)
    return out


def made(n=220, seed=3, common=True):
    rng = np.random.default_rng(seed)
    out, last = {}, None
    for i in range(n):
        counts = {int(k): int(rng.integers(1, 4)) for k in rng.choice(np.minimum((rng.pareto(1.0, 12) * 4).astype(int), 400), int(rng.integers(1, 12)))}
        if common:
            counts[1000] = int(rng.integers(1, 12))  # a place of every vector, from a trace to nearly all of it
        if i % 4 == 0 and last:
            counts = dict(last)
            if i % 8 == 0:
                counts[int(rng.integers(0, 400))] = 1
        last = counts
        out[f"d{i:04d}"] = (unit(counts), "xy"[i % 5 == 0] if i % 3 else None)
    out["d9998"], out["d9999"] = ({3: -1.0}, "x"), ({3: -0.6, 5: 0.8}, "x")
    return out


@pytest.mark.parametrize(("threshold", "hot"), [(0.7, sj.HOT), (0.7, 5), (0.3, 20), (0.95, 3), (0.5, 1)])
def test_equals_every_pair(spark, threshold, hot):
    vectors = made()
    # A null block is a block of its own.
    got = {(r.a, r.b): round(r.cosine, 9) for r in sj.sparse_join(frame(spark, vectors), "id", threshold, "grp", hot).collect()}
    want = plain(vectors, threshold)
    assert all(abs(got.get(k, threshold) - want.get(k, threshold)) < 1e-8 for k in {*got, *want}) and len(want) > 20


def moved(spark, n):
    """Rows that meet, of n vectors that share one place and differ otherwise."""
    rng = np.random.default_rng(9)
    vectors = {f"d{i}": (unit({0: int(rng.integers(1, 3)), **{int(k): 1 for k in rng.choice(np.arange(1, 8 * n), 7, replace=False)}}), None) for i in range(n)}
    found, _ = sj.classes(frame(spark, vectors), "id", None)
    return sum(x.count() for x in sj.sides(sj.postings(found, 0.4, hot=50)))


def test_common_place_moves_rows_linearly(spark):
    few, many = moved(spark, 800), moved(spark, 3200)
    assert many < 5 * few


def test_empty_and_copies(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sj.sparse_join(empty, "id", 0.5).count() == 0
    copies = {f"d{i}": ({1: 0.6, 2: 0.8}, None) for i in range(30)}
    got = sj.sparse_join(frame(spark, copies), "id", 0.9).agg(F.count("*"), F.min("cosine")).first()
    assert got[0] == 30 * 29 // 2 and abs(got[1] - 1) < 1e-9
