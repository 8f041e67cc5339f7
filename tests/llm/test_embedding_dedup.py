import numpy as np
import pytest

from newsline.llm import embedding_dedup as ed


def brute(ids, vectors, threshold):
    n = len(ids)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for v in vectors]
    links, label = [0] * n, list(range(n))
    for i in range(n):
        for j in range(i + 1, n):
            if ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    low = min(label[i], label[j])
                    label = [low if x in (label[i], label[j]) else x for x in label]
    return sorted((ids[i], links[i], min(ids[k] for k in range(n) if label[k] == label[i])) for i in range(n))


@pytest.mark.parametrize(("threshold", "tile", "turned"), [(0.95, 4096, 512), (0.8, 7, 512), (0.5, 16, 512), (0.8, 7, 5)])
def test_links(spark, threshold, tile, turned):
    """Turned: of longer vectors only so many leading components are turned."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 24))
    rows = [(base[i % 12] + rng.normal(size=24) * rng.choice([0.05, 0.3, 1.0])).astype("f4").tolist() for i in range(110)]
    rows += [rows[0], rows[0], rows[5], [0.0] * 24, None, [], [float("nan")] * 24, [float("inf")] + [1.0] * 23, [1.0, None] + [1.0] * 22, [1.0, 2.0], [2.0, 4.0], [5.0], [-5.0], [1e-30] * 24, [1e-30] * 24]
    ids = [int(x) for x in rng.permutation(len(rows)) * 7]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in zip(ids, rows)], "vec_id long, embedding array<float>, label int, n int")
    got = ed.cosine_links(df, threshold, tile, turned).collect()
    stored = [None if v is None else [None if x is None else float(np.float32(x)) for x in v] for v in rows]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(ids, stored, threshold)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_empty(spark, write):
    assert ed.op3_embedding_dedup(spark, write("embeddings", [], "vec_id long, embedding array<float>, label int")).count() == 0


def test_null_and_repeated_ids(spark):
    """A vector without id links, bridges and names nothing; equal vectors link with each other."""
    near = lambda a: [float(np.cos(a)), float(np.sin(a)), 0.0]
    rows = [(4, near(0.0)), (None, near(0.3)), (9, near(0.6)), (None, [0.0, 0.0, 1.0]), (7, [1.0, 1.0, 1.0]), (7, [1.0, 1.0, 1.0]), (None, None)]
    got = ed.cosine_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == sorted(
        [("4", 1, "4", True), ("None", 2, "4", False), ("9", 1, "4", False), ("None", 0, "None", False), ("7", 1, "7", True), ("7", 1, "7", True), ("None", 0, "None", False)]
    )


def test_copies_in_shares(spark):
    """The closing join by shares gives what the plain one gives, with rows that have no vector or no id."""
    rows = [(i, [1.0, float(i % 3), 0.0]) for i in range(40)] + [(50 + i, None) for i in range(20)] + [(None, [1.0, 0.0, 0.0]), (90, [0.0, 0.0, 7.0]), (90, [0.0, 0.0, 7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [sorted(map(str, ed.cosine_links(df, hot=hot).collect())) for hot in (1, 5, 1000)]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)
    assert {r.n_links for r in ed.cosine_links(df, hot=5).where("vec_id % 3 = 0 and vec_id < 40").collect()} == {14}
