import math
import random

import pyarrow as pa
import pytest

from newsline.operators.fulltext import TextIndex, _postings
from newsline.plans.live import folders

SCHEMA = "id string, title string, body string, published_at int, token string"
VOCABULARY = ["the", "of", "Irmak", "ırmak", "İz", "sea", "a", "é"]


def made(rng, ids):
    return [(i, rng.choice([None, "Of the SEA"]), rng.choice([None, "", " ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(0, 60)))]), rng.randint(0, 3), "x") for i in ids]


def words(row):
    return " ".join(x for x in row[1:3] if x is not None).replace("İ", "i").replace("I", "ı").lower().split()


def check(index, have):
    """All queries against a scan of the newest texts."""
    texts = {r[0]: words(r) for r in have.values()}
    for query in ("the", "OF the", "the the of", "Irmak sea", "iz a é", "nowhere", "the nowhere", ""):
        own = [w.replace("İ", "i").replace("I", "ı").lower() for w in query.split()]
        assert {r.id for r in index.holding(query).collect()} == {i for i, t in texts.items() if own and set(own) <= set(t)}
        hits = {i: sum(t[j : j + len(own)] == own for j in range(len(t) - len(own) + 1)) for i, t in texts.items()}
        assert {r.id: r.n_hits for r in index.phrase(query).collect()} == {i: n for i, n in hits.items() if n and own}
        mean, want = sum(map(len, texts.values())) / max(1, len(texts)), {}
        for w in set(own):
            df = sum(w in t for t in texts.values())
            for i, t in texts.items():
                if w in t:
                    tf = t.count(w)
                    want[i] = want.get(i, 0) + math.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
        got = {r.id: r.score for r in index.ranked(query).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
        if own:
            top = [r.id for r in index.ranked(query, 5).collect()]
            assert top == sorted(got, key=lambda i: (-got[i], i))[:5]


def test_batches_equal_a_scan(spark, tmp_path):
    rng = random.Random(4)
    have, path = {}, f"{tmp_path}/index"
    newest = lambda rows: {r[0]: r for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[3], " ".join(x for x in r[1:3] if x is not None)))}
    first = made(rng, [*map(str, range(60)), "5", "5", "7", None])  # repeated ids and one without
    index = TextIndex.create(spark.createDataFrame(first, SCHEMA), path, buckets=8)
    have |= newest(first)
    check(index, have)
    second = made(rng, map(str, range(40, 90)))
    assert index.add(spark.createDataFrame(second, SCHEMA)) == 20
    have |= newest(second)
    third = made(rng, ["50", "95"])
    assert index.add(spark.createDataFrame(third, SCHEMA)) == 1
    have |= newest(third)
    assert index.add(spark.createDataFrame([], SCHEMA)) == 0
    index = TextIndex(spark, path)  # another session opens it
    check(index, have)
    before = len(index._notes()["segments"])
    index.compact()
    assert (before, len(index._notes()["segments"])) == (3, 1)
    fourth = made(rng, ["50", "0", "99"])
    assert index.add(spark.createDataFrame(fourth, SCHEMA)) == 2
    have |= newest(fourth)
    check(index, have)


def test_empty_index(spark, tmp_path):
    index = TextIndex.create(spark.createDataFrame([], SCHEMA), f"{tmp_path}/index")
    assert index.holding("a").count() == index.phrase("a b").count() == index.ranked("a").count() == 0


def test_reads_only_its_words(spark, tmp_path):
    """Files of other buckets aren't read, and a batch that lost the race is not seen."""
    rows = [(str(i), "", f"w{i % 50} common", 1, "") for i in range(200)]
    index = TextIndex.create(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/index", buckets=64)
    files = index._live(index._notes(), ["w7"]).inputFiles()
    assert len(folders(spark, f"{index.path}/segments/{index._notes()['segments'][0]}")) > 20
    plan = index._live(index._notes(), ["w7"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_bucket" in plan.replace("isnotnull(_bucket#", "_bucket").replace("[(_bucket", "[_bucket") and "EqualTo(token,w7)" in plan and files
    number = index.documents.manifest()["number"]
    index.add(spark.createDataFrame([("900", "", "w7", 1, "")], SCHEMA))
    with pytest.raises(RuntimeError):
        index.documents.note({}, number)
    assert index.holding("w7").count() == 5


def test_postings_are_put_together_in_place():
    """Each text's words become its rows where the text is: a row a distinct word, places in order, no word of its own moves."""
    rng = random.Random(8)
    texts = {str(i): [f"w{rng.randrange(30)}" for _ in range(rng.choice([0, 1, 40, 200]))] for i in range(700)}
    batch = pa.RecordBatch.from_pydict({"id": list(texts), "words": pa.array(list(texts.values()), pa.list_(pa.string()))})
    got = {(r["id"], r["token"]): (r["length"], r["positions"]) for part in _postings(iter([batch.slice(0, 300), batch.slice(300), batch.slice(0, 0)])) for r in part.to_pylist()}
    assert got == {(i, w): (len(t), [k for k, x in enumerate(t) if x == w]) for i, t in texts.items() for w in t}
