"""The nearest-neighbour index against scoring every pair."""

import numpy as np
import pytest

from newsline.operators import nearest as nn

SCHEMA = "vec_id long, embedding array<float>, id int, data string, list int"


def made(n=700, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, dim))
    rows = [(i, (centres[i % 25] + rng.normal(size=dim) * 0.15).astype("f4").tolist()) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(90)] + [(n + 100, [0.0] * dim), (n + 101, None), (n + 102, [1.0]), (n + 103, [None] + [1.0] * (dim - 1)), (n + 104, [float("nan")] * dim), (None, rows[0][1]), (n + 105, (np.array(rows[7][1]) * 5).tolist())]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "d", 2) for i, v in rows], SCHEMA)


def plain(base, queries, k, dim=16):
    def unit(v):
        if v is None or len(v) != dim or any(x is None for x in v):
            return None
        x = np.array(v, "f4").astype(float)
        return x / np.linalg.norm(x) if np.isfinite(x).all() and x.any() else None

    own = [(i, u) for i, v in base if i is not None and (u := unit(v)) is not None]
    ids, m = np.array([i for i, _ in own]), np.stack([u for _, u in own])
    out = []
    for q, v in queries:
        if (u := unit(v)) is not None:
            c = np.round(m @ u, 9)
            order = [j for j in np.lexsort((ids, -c)) if ids[j] != q][:k]
            out += [(q, int(ids[j]), round(float(c[j]), 6), r) for r, j in enumerate(order, 1)]
    return sorted(out)


def got(df):
    return sorted((r.query, r.id, round(r.cosine, 6), r.rank) for r in df.collect())


def test_exact_probed_and_added(spark, tmp_path):
    rows = made()
    queries = [r for r in rows if r[0] is not None and r[0] % 23 == 0] + [(9_000, rows[3][1]), (9_001, [0.0] * 16), (9_002, None)]
    path = str(tmp_path / "index")
    index = nn.VectorIndex.build(frame(spark, rows[:500]), "vec_id", "embedding", path, 16, lists=40)
    asked = frame(spark, queries)
    assert got(index.search_exact(asked, "vec_id", "embedding", 6)) == plain(rows[:500], queries, 6)
    nn.VectorIndex(spark, path).add(frame(spark, rows[500:]), "vec_id", "embedding")
    index = nn.VectorIndex(spark, path)
    want = plain(rows, queries, 6)
    assert got(index.search_exact(asked, "vec_id", "embedding", 6)) == want
    assert got(index.search_exact(asked, "vec_id", "embedding", 6, seeds=1)) == want
    assert got(index.search_exact(asked, "vec_id", "embedding", 2000, seeds=2)) == plain(rows, queries, 2000)
    probes = index.calibrate(0.95, 6)
    assert 1 <= probes <= 20  # of 40 lists
    found = got(index.search(asked, "vec_id", "embedding", 6, probes))
    assert len(set((q, i) for q, i, *_ in found) & set((q, i) for q, i, *_ in want)) >= 0.95 * len(want)
    # Copies of one vector don't make one large piece: pieces end at PIECE vectors, and every usable row is filed.
    pieces = spark.read.parquet(f"{path}/pieces").select("n").collect()
    assert max(p.n for p in pieces) <= nn.PIECE and sum(p.n for p in pieces) == len([1 for i, v in rows if i is not None and v is not None and len(v) == 16 and None not in v and any(x == x and x for x in v)])


def test_triangle_bound():
    """No list with a vector at the floor is left out; on clustered vectors most lists are."""
    import pyarrow as pa

    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 16))
    x = np.repeat(centres, 40, 0) + rng.normal(size=(1200, 16)) * 0.15
    x, centres = x / np.linalg.norm(x, axis=1)[:, None], centres / np.linalg.norm(centres, axis=1)[:, None]
    lists, c = nn._nearest(x, centres)
    angles = np.arccos(c)
    low, high = np.array([[f(angles[lists == i]) for i in range(30)] for f in (np.min, np.max)])

    class Sent:
        value = (centres, low, high)

    cosines = x[::30] @ x.T
    floor = np.sort(cosines, 1)[:, -8]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(40)), pa.array([v.tobytes() for v in x[::30]], pa.binary()), pa.array(floor)], ["id", "data", "floor"])
    wanted = {(q, at) for b in nn._possible(Sent, 16, 0)(iter([batch])) for q, at in zip(b.column("query").to_pylist(), b.column("list").to_pylist())}
    need = {(int(q), int(lists[j])) for q, j in zip(*np.nonzero(cosines >= floor[:, None]))}
    assert need <= wanted and len(wanted) < 40 * 30 / 3


@pytest.mark.parametrize("rows", [[], [(1, None), (2, [0.0] * 16)]])
def test_empty(spark, tmp_path, rows):
    index = nn.VectorIndex.build(frame(spark, rows), "vec_id", "embedding", str(tmp_path / "index"), 16)
    assert index.search_exact(frame(spark, [(1, [1.0] * 16)]), "vec_id", "embedding", 3).count() == 0 and index.calibrate() == 1
