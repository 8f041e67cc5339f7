"""The filter audit against plain counting, with files that retract what earlier ones counted."""

import itertools
import random
import re
from collections import Counter

from newsline.llm import filter_audit as fa

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, source string, part string, bits int, n int, key string"
LABELS = "doc_id long, quality int, toxic int, said int"


def plain(rows, labels):
    """Every order applied to every document."""
    low = {}
    for i, t, _ in rows:
        if i is not None:
            low[t or ""] = min(i, low.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    parts, out = {}, {}
    for i, t, s in rows:
        t = t or ""
        words = WORD.findall(t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and low[t] < i}
        parts.setdefault(s or "", []).append((frozenset(f for f in fails if fails[f]), i is not None and i in good, i is not None and i in toxic))
    for part, docs in parts.items():
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                failing = sum(f in d[0] for d in docs)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[f])
    return out


def result(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def made(seed=5):
    rng = random.Random(seed)
    words = ["alpha", "BETA", "gamma", "é", "#1", "delta", "zeta", "eta", "theta", "x\x1cy", " "] + [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 45, 60, 120]))) for _ in range(25)] + [None, "", "A" * 30, "long " * 20_000]
    rows = [(rng.randint(0, 400), rng.choice(texts), rng.choice(["s1", "s2", None, ""])) for _ in range(220)]
    rows += [(None, texts[0], "s1"), (None, None, None), rows[0], rows[1], (rows[2][0], rows[2][1], "s9")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 400, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    return rows, labels


def put(spark, rows, path):
    spark.createDataFrame([(*r, "p", 1, 2, "k") for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_batches_retract(spark, tmp_path):
    """Ids come in falling order, a batch a file, so most first sightings are taken back; a second run takes new files only."""
    rows, labels = made()
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0)))
    said = spark.createDataFrame([(*x, 7) for x in labels], LABELS)
    path, counters, checkpoint = (str(tmp_path / x) for x in ("docs", "counters", "checkpoint"))

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
        fa.audit_stream(stream, said, counters, checkpoint).awaitTermination(200)
        changes = spark.read.schema("part string, bits int, n long").option("recursiveFileLookup", "true").parquet(counters)
        return changes, result(fa.interactions(changes))

    for k in range(0, 150, 75):
        put(spark, rows[k : k + 75], path)
    changes, got = run()
    assert got == plain(rows[:150], labels)
    assert changes.where("n < 0").count() > 0
    put(spark, rows[150:], path)
    changes, got = run()
    assert got == plain(rows, labels)
    assert len(list((tmp_path / "counters").glob("batch=*"))) == 3


def test_query_and_empty(spark, write, tmp_path):
    rows, labels = made(6)
    put(spark, rows[:100], f"{tmp_path}/documents.parquet")
    put(spark, rows[100:], f"{tmp_path}/documents.parquet")
    write("labels", [(*x, 7) for x in labels], LABELS)
    assert result(fa.op12_filter_audit(spark, str(tmp_path))) == plain(rows, labels)
    write("documents", [], SCHEMA)
    write("labels", [], LABELS)
    assert fa.op12_filter_audit(spark, str(tmp_path)).count() == 0
