import random

import pytest

from newsline.plans import components


def brute(edges):
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("shape", ["random", "path", "star"])
def test_components(spark, monkeypatch, kind, shape):
    monkeypatch.setattr(components, "LOCAL_EDGES", 7)
    rng = random.Random(1)
    edges = {"random": [(rng.randrange(300), rng.randrange(300)) for _ in range(180)], "path": [(i, i + 1) for i in range(150)], "star": [(500 - i, 7) for i in range(200)]}[shape]
    edges = [(a, b) if kind == "long" else (f"n{a:03d}", f"n{b:03d}") for a, b in edges if a != b]
    df = spark.createDataFrame([*edges, *edges[:5], (edges[0][0], edges[0][0]), (None, edges[0][0])], f"a {kind}, b {kind}").repartition(3)
    assert {r.node: r.component for r in components.connected_components(df, "a", "b").collect()} == brute(edges)


def test_none(spark):
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
