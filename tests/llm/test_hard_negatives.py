"""Hard negatives against scoring every pair, with bounds that hold for every pair."""

import numpy as np
import pytest

from newsline.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, q int, norm int, row int"


def plain(rows):
    own = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = [int(np.floor(256 * x)) for x in v]
        if sum(x * x for x in q) < 1 << 62:
            own.append((i, label, q))
    out = []
    for i, label, q in own:
        if i % 100:
            continue
        met = [(-sum(x * y for x, y in zip(q, o)), j, m) for j, m, o in own if j != i and len(o) == len(q)]
        for s, p in sorted((s, j) for s, j, m in met if m == label)[:5]:
            found = sorted((t, j) for t, j, m in met if m != label and -30 * s <= -100 * t <= -90 * s)[:10]
            out += [(i, p, r, j, -s, -t) for r, (t, j) in enumerate(found, 1)]
    return sorted(out)


def made(n=420, dim=24, seed=2, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = []
    for k in range(n):
        v = (centres[k % 6] + rng.normal(size=dim) * rng.choice([0.02, 0.5, 1.5])) * scale * rng.choice([0.01, 1, 3])
        rows.append((int(k * 10), v.tolist(), int(rng.integers(0, 4))))
    return rows


ODD = [(5, [1.0, 2.0], 1), (200, [1.0, 1.0], 1), (7, [0.3, 0.9], 2), (9, [], 1), (300, [], 2), (11, None, 1), (13, [1.0] * 24, None), (None, [1.0] * 24, 1), (15, [None] + [1.0] * 23, 1), (17, [float("nan")] * 24, 1), (19, [float("inf")] * 24, 2),
       (21, [1e30] * 24, 1), (400, [0.0] * 24, 1), (23, [0.0] * 24, 2), (500, [7.0], 3), (600, [7.0], 2), (1, [-7.0], 2)]


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, x, 1, 2, 3) for i, v, x in rows], SCHEMA)
    got = hn.hard_negatives(hn.quantized(df), "vec_id % 100 = 0", **options).collect()
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got)


@pytest.mark.parametrize("options", [{}, {"pass_bytes": 2500}, {"count": 3}])
def test_equals_scoring_all(spark, options):
    """In one pass and in several; few references make wide intervals, never other results."""
    rows = made()
    rows += [(i + 1, v, label) for i, v, label in rows[:40]] + [(i + 2, v, 3 - label) for i, v, label in rows[:40]] + ODD
    assert run(spark, rows, **options) == plain(rows)


def test_scores_beyond_doubles(spark):
    rows = made(120, 8, 3, scale=30_000.0)
    assert run(spark, rows) == plain(rows) and plain(rows)


def test_bounds_hold():
    """Every pair's score lies in its interval, whatever the references; few references leave wider ones."""
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(300, 20)) * rng.choice([3, 300, 1e6], size=(300, 1)))
    x[5], x[6] = x[4], -x[4]
    norms = np.sqrt((x * x).sum(1))
    axes, widths = np.linalg.qr(rng.normal(size=(20, 20)))[0], []
    for count in (1, 8, 20):
        unit = x / norms[:, None]
        c = np.clip(unit @ axes[:, :count], -1, 1)
        angles = np.rint(np.column_stack([np.arccos(c), np.arcsin(np.sqrt(np.clip(1 - (c * c).sum(1), 0, 1)))]) / hn.UNIT).astype("<u2")
        block = hn.Block(range(300), [0] * 300, norms, [hn._packed(v.astype(np.int64)) for v in x], [a.tobytes() for a in angles])
        least, most = hn.bounds(block, block)
        exact = x @ x.T
        assert (least <= exact).all() and (exact <= most).all()
        widths.append(float(((most - least) / np.multiply.outer(norms, norms)).mean()))
    assert widths[0] > widths[1] > widths[2] and widths[2] < 0.01


def test_empty(spark, write):
    assert hn.op11_hard_negatives(spark, write("embeddings", [], "vec_id long, embedding array<float>, label int")).count() == 0
