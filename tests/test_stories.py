import datetime as dt
import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsline.operators import linking, stories
from newsline.operators.vectors import bow_of, centroid, embed_with, hashed_bow, similar_pairs, dense_blocks, top_k_similar

START = dt.datetime(2024, 1, 1)


def made(seed, n=120, dims=40):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    vectors = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dims)) * 0.5
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    hours = np.sort(rng.integers(0, 24 * 9, n)) + np.where(np.arange(n) > n // 2, 40, 0)
    role = rng.choice(["seed", "seed", "join", "skip"], n)
    lang = rng.choice(["en", "de"], n)
    return [(f"a{i:03d}", str(lang[i]), START + dt.timedelta(hours=int(hours[i])), str(role[i]), vectors[i]) for i in range(n)]


def whole(rows, threshold):
    """One sequential pass a language, without any blocks."""
    out = {}
    for lang in {r[1] for r in rows}:
        own = sorted([r for r in rows if r[1] == lang and r[3] != "skip"], key=lambda r: (r[2], r[0]))
        label = stories.greedy(np.array([r[2] for r in own], "datetime64[us]"), np.stack([r[4] for r in own]), np.array([r[3] == "seed" for r in own]), threshold, 24)
        first = {}
        for r, x in zip(own, label):
            first.setdefault(x, r[0])
            out[r[0]] = first[x] if x >= 0 else None
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_equal_one_pass(spark, seed):
    rows = made(seed)
    articles = spark.createDataFrame([r[:4] for r in rows], "id string, language string, published_at timestamp, role string")
    sparse = spark.createDataFrame([(r[0], i, float(x)) for r in rows for i, x in enumerate(r[4])], "id string, idx int, weight double")
    got = {r.id: r.story for r in stories.cluster_stories(articles, sparse, 0.7).collect()}
    assert got == whole(rows, 0.7)


def test_block_of_any_size_holds_open_stories(spark):
    """A block that lasts many windows holds the open stories only; the result is that of one pass that keeps all."""
    rng = np.random.default_rng(7)
    v = np.abs(rng.normal(size=(600, 12)))
    v /= np.linalg.norm(v, axis=1)[:, None]
    found = stories.OpenStories(0.95, 24, 12)
    got, most = [], 0
    for i in range(600):
        got.append(found.place(i * 3_600_000_000, np.arange(12), v[i], i % 3 > 0, i))
        most = max(most, len(found.names))
    sums, want = {}, []
    for i in range(600):
        near = [(float(s @ v[i] / np.linalg.norm(s)), -k) for k, (s, last) in sums.items() if i - last <= 24]
        like, k = max(near, default=(-2.0, 0))
        story = -k if like >= 0.95 else i if i % 3 else None
        if story is not None:
            sums[story] = (sums.get(story, (np.zeros(12), 0))[0] + v[i], i)
        want.append(story)
    assert got == want and len(set(got)) > 100 and most <= 64


def test_batches_of_articles_equal_one_by_one():
    """Batches that join what they changed themselves, over many windows, against all stories in double precision."""
    rng = np.random.default_rng(11)
    kinds = np.abs(rng.normal(size=(60, 30)))
    rows = [(i * 300_000_000, np.sort(rng.choice(30, 20, replace=False)), bool(rng.integers(0, 4)), i) for i in range(1500)]
    weights = [kinds[rng.integers(0, 60), p] + rng.random(20) * 0.2 for _, p, _, _ in rows]
    sums, last, want = np.zeros((0, 30)), np.zeros(0), []
    for (time, places, seed, i), w in zip(rows, weights):
        x = np.zeros(30)
        x[places] = w
        like = np.where(time - last > 2 * 3_600_000_000, -2.0, sums @ x / np.linalg.norm(x) / np.maximum(np.linalg.norm(sums, axis=1), 1e-30))
        if len(like) and like.max() >= 0.85:
            k = int(np.argmax(like))
            sums[k], last[k] = sums[k] + x, time
            want.append(names[k])
        elif seed:
            sums, last = np.vstack([sums, x]), np.append(last, time)
            names = [*(names if want and len(sums) > 1 else []), i]
            want.append(i)
        else:
            want.append(None)
    found, got, at = stories.OpenStories(0.85, 2, 30), [], 0
    for size in (1, 700, 3, 796):
        part = rows[at : at + size]
        got += found.place_all([r[0] for r in part], [r[1] for r in part], weights[at : at + size], [r[2] for r in part], [r[3] for r in part])
        at += size
    assert got == want and None in want and 100 < len(set(want)) < len(want) - 100


def test_minted_ids_continue(spark):
    df = spark.createDataFrame([(i, START + dt.timedelta(hours=i)) for i in range(30)], "k int, at timestamp")
    taken = spark.createDataFrame([("cl_20240101_9998",), ("cl_20240101_0009",)], "id string")
    got = {r.k: r.new_id for r in stories.mint_ids(df, "cl", "at", ["at"], taken).collect()}
    assert [got[0], got[1], got[2], got[24]] == ["cl_20240101_9999", "cl_20240101_10000", "cl_20240101_10001", "cl_20240102_0001"]


@pytest.mark.parametrize("seed", [3, 4])
def test_linking_blocks_equal_one_pass(spark, seed):
    rng = np.random.default_rng(seed)
    names = [f"e{i}" for i in range(60)]
    pick = lambda: [str(x) for x in rng.choice(names, rng.integers(0, 4), replace=False)]
    clusters = [(f"c{i:02d}", int(rng.integers(0, 6)), START + dt.timedelta(hours=i), pick(), rng.normal(size=6).tolist()) for i in range(50)]
    arcs = [(f"r{i:02d}", pick(), rng.normal(size=6).tolist(), 2) for i in range(15)]
    order = sorted(clusters, key=lambda c: (c[1], c[2], c[0]))
    want = dict(linking.link_in_order([(c[0], c[3], c[4]) for c in order], arcs, 0.3, 0.3))
    df = spark.createDataFrame(clusters, "cluster_id string, severity int, created_at timestamp, entities array<string>, vector array<double>")
    got = linking.link_arcs(df, spark.createDataFrame(arcs, "id string, entities array<string>, vector array<double>, n int"), 0.3, 0.3)
    assert {r.cluster_id: r.arc_id for r in got.collect()} == want


def test_common_entity_joins_no_blocks(spark):
    """All stories and arcs share a language; only those that also share a rarer name may link."""
    rng = np.random.default_rng(6)
    pick = lambda i: ["en", *(f"s{i // 4}.{k}" for k in range(int(rng.integers(2, 5))))]
    clusters = [(f"c{i:02d}", int(rng.integers(0, 6)), START + dt.timedelta(hours=i), pick(i), rng.normal(size=6).tolist()) for i in range(60)]
    arcs = [(f"r{i:02d}", pick(4 * i), rng.normal(size=6).tolist(), 2) for i in range(20)]
    order = sorted(clusters, key=lambda c: (c[1], c[2], c[0]))
    want = dict(linking.link_in_order([(c[0], c[3], c[4]) for c in order], arcs, 0.1, 0.4))
    df = spark.createDataFrame(clusters, "cluster_id string, severity int, created_at timestamp, entities array<string>, vector array<double>")
    have = spark.createDataFrame(arcs, "id string, entities array<string>, vector array<double>, n int")
    assert {r.cluster_id: r.arc_id for r in linking.link_arcs(df, have, 0.1, 0.4).collect()} == want
    assert any(not x.startswith("new:") for x in want.values())
    nodes = linking.linkable_parts(df, have, 0.4).where("node not like 'e:%'")
    assert max(r["count"] for r in nodes.groupBy("component").count().collect()) <= 8


def test_model_calls(spark):
    def model(texts):
        if any("bad" in x for x in texts):
            raise ValueError
        return [[float(len(x))] for x in texts]

    df = spark.createDataFrame([(i, "bad" if i == 5 else "x" * i) for i in range(40)], "id long, t string")
    got = {r.id: r.vector for r in embed_with(df, "id", "t", model).collect()}
    assert got[5] is None and got[7] == [7.0] and len(got) == 40


def test_dense_pairs_and_top_k(spark):
    m = np.random.default_rng(5).normal(size=(60, 8))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(60, [0.0] * 8), (61, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    u = m / np.linalg.norm(m, axis=1)[:, None]
    c = u @ u.T
    own = dense_blocks(df, "id", "v", 16)
    got = {(r.a, r.b) for r in similar_pairs(own, own, 0.5, same=True).collect()}
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if c[i, j] >= 0.5}
    np.fill_diagonal(c, -9)
    near = {(r.a, r.rank): r.b for r in top_k_similar(own, own, 3).collect()}
    assert all([near[i, k + 1] for k in range(3)] == np.argsort(-c[i])[:3].tolist() for i in range(60))


def test_bow_is_unit_and_repeats_count(spark):
    df = spark.createDataFrame([(1, "A a b"), (2, "")], "id long, t string")
    got = hashed_bow(df, "id", "t").collect()
    assert {r.id for r in got} == {1} and abs(sum(r.weight**2 for r in got) - 1) < 1e-12 and round(max(r.weight for r in got), 6) == 0.894427


def test_centroids(spark):
    """Means of any keys: ragged vectors, null components, null and empty vectors, one key with most rows."""
    rng = np.random.default_rng(8)
    rows = [("big" if i % 3 else f"k{i % 40}", rng.normal(size=6).tolist()) for i in range(500)]
    rows += [(None, [1.0, None]), (None, [3.0, None, 5.0]), ("gone", None), ("gone", []), ("nan", [float("nan"), 2.0])]
    got = {r.k: r.centroid for r in centroid(spark.createDataFrame(rows, "k string, v array<double>").repartition(5), "k", "v").collect()}
    want = {k: np.mean([v for x, v in rows if x == k], axis=0) for k in {k for k, _ in rows[:500]}}
    assert set(got) == {*want, None, "nan"} and all(np.allclose(got[k], want[k]) for k in want)
    assert got[None] == [2.0, None, 5.0] and np.isnan(got["nan"][0]) and got["nan"][1] == 2.0
    assert centroid(spark.createDataFrame([], "k int, v array<float>"), "k", "v").count() == 0


def dense_run(n=1500, dims=60):
    """One language's articles without a gap: a few kinds that stories gather, and many that seed one each; copies beside them."""
    rng = np.random.default_rng(21)
    kinds = np.abs(rng.normal(size=(25, dims)))
    rows = []
    for i in range(n):
        if i % 3:
            places = np.sort(rng.choice(dims, 8, replace=False)).astype(np.int32)
            weights = rng.random(8) + 0.2
        else:
            places = np.arange(dims, dtype=np.int32)
            weights = kinds[rng.integers(0, 25)] + rng.random(dims) * 0.9
        if i % 50 == 49:
            places, weights = rows[-40][4], rows[-40][5]
        at = START + dt.timedelta(minutes=int(4.5 * i) - int(4.5 * i) % 60)  # many at one time
        rows.append((f"a{i:04d}", "en", at, "seed" if i % 7 else "join", places, weights / np.linalg.norm(weights)))
    return rows


def dense_vectors(rows, dims=60):
    out = np.zeros((len(rows), dims))
    for k, r in enumerate(rows):
        out[k, r[4]] = r[5]
    return out


def test_slices_equal_one_pass(spark):
    """A run of many windows, without a place that parts it, and vectors that are null or empty."""
    rows = dense_run()
    want = whole([(*r[:4], v) for r, v in zip(rows, dense_vectors(rows))], 0.8)
    more = [("n1", "en", START, "seed", None, None), ("n2", "en", START, "join", [], []), ("n3", "de", START, "seed", None, None)]
    df = spark.createDataFrame([(*r[:4], r[4].tolist(), r[5].tolist()) for r in rows] + more, "id string, language string, published_at timestamp, role string, idx array<int>, weight array<double>")
    got = {r.id: r.story for r in stories.cluster_stories(df, threshold=0.8).collect()}
    assert got == want | {"n1": "n1", "n2": None, "n3": "n3"}
    assert 200 < len(set(want.values())) < 1300


@pytest.mark.parametrize("guess", ["found", "none", "half"])
def test_any_guess_gives_the_plain_pass(monkeypatch, guess):
    """Stories are kept out of the product where the guess is good; where it is bad, the result is the same."""
    rows, day = dense_run(), 24 * 3_600_000_000
    times = [int((r[2] - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000 for r in rows]
    batches = []
    for k in sorted({t // day for t in times}):
        own = [i for i, t in enumerate(times) if t // day in (k - 1, k)]
        column = lambda j, kind: pa.array([rows[i][j] for i in own], kind)
        made_of = {
            "language": column(1, pa.string()), "run": column(1, pa.string()), "time": pa.array([times[i] for i in own]), "id": column(0, pa.string()),
            "seed": pa.array([rows[i][3] == "seed" for i in own]), "idx": column(4, pa.list_(pa.int32())), "weight": column(5, pa.list_(pa.float64())),
            "slice": pa.array([k] * len(own)), "own": pa.array([times[i] // day == k for i in own]),
        }
        whole_slice = pa.RecordBatch.from_arrays(list(made_of.values()), list(made_of))
        batches += [whole_slice.slice(at, 130) for at in range(0, len(own), 130)]
    chunk = stories._Leaders._chunk
    if guess != "found":
        monkeypatch.setattr(stories._Leaders, "_chunk", lambda self, t, n, p, w, seeds: chunk(self, t, n, p, w, seeds & (np.arange(len(t)) % 2 > 0) & (guess == "half")))
    led = []
    for key, group in itertools.groupby(batches, key=lambda b: b.column("slice")[0].as_py()):
        led += stories._find_leaders(0.8, 24, 60)(iter(group))
    most, batch = [], stories.OpenStories.batch
    monkeypatch.setattr(stories.OpenStories, "batch", lambda self, *a: [batch(self, *a), most.append((self.n_hot, len(self.names)))][0])
    got = {}
    for b in stories._place_articles(0.8, 24, 60)(iter(led)):
        got |= dict(zip(b.column("id").to_pylist(), b.column("story").to_pylist()))
    assert got == whole([(*r[:4], v) for r, v in zip(rows, dense_vectors(rows))], 0.8)
    assert guess != "found" or max(h for h, _ in most) * 4 < max(n for _, n in most) * 3


def test_bow_in_the_row_is_hashed_bow(spark):
    df = spark.createDataFrame([(1, "A a b"), (2, ""), (3, None), (4, "x y  z x")] + [(i, " ".join(f"w{j % i}" for j in range(99))) for i in range(5, 40)], "id int, t string").repartition(3)
    rows = {r.id: r.b for r in df.select("id", bow_of(F.col("t")).alias("b")).collect()}
    want = {}
    for r in hashed_bow(df, "id", "t").orderBy("id", "idx").collect():
        want.setdefault(r.id, []).append((r.idx, r.weight))
    assert {k: list(zip(b.idx, b.weight)) for k, b in rows.items() if b.idx} == want
    assert rows[2].idx == [] and rows[3].idx is None and len(rows) == 39


def test_counts_read_no_text(spark, write):
    """The counts come from the roles that the clustering has stored; the texts aren't read again for them."""
    import __spark_entry__

    texts = ["a " * 40, "a " * 20 + "b", "short", "c " * 20, "d " * 50]
    write("documents", [(i, x, "en", "src1", len(x)) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    write("events", [(i, START + dt.timedelta(hours=i), 1, "view", 1.0, "") for i in range(5)], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    write("embeddings", [(0, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    folder = write("pages", [(0, "", "")], "page_id long, url string, html string")
    got = __spark_entry__.queries()["story_counts"](spark, folder)
    assert tuple(got.first()) == (2, 1, 1, 1)
    assert not any("documents.parquet" in f for f in got.inputFiles())
