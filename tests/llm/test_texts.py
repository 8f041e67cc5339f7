"""The text operators against plain Python on small tables with nulls, ties, copies and long texts."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsline.llm import bpe, decontaminate, jaccard_join, language_id, line_dedup, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, fp long, tokens int, ids int"


def made(seed=7, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, base = say(60), say(140)
    texts = []
    for i in range(n):
        words = say(rng.randint(0, 150)).split(" ")
        if i % 5 == 0:
            words[3:3] = passage.split(" ")
        if i % 7 == 0:
            words = base.split(" ")
            for _ in range(i // 7 % 4):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        text = " ".join(words)
        texts.append(re.sub(r" (\S+) (\S+) ", lambda m: f" {m[1]}\n{m[2]}\t ", text) if i % 3 else text)
    texts[11], texts[12] = texts[10], texts[10].upper()
    texts += [None, "", " \n", "one", "One", "two words", "a b c", "x " * 30_000, say(9000), "é" * 50, "\n".join(["l"] * 500)]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [(i, t, "en", "s", 0, 1, 2, 3, 4) for i, t in rows]


@pytest.fixture
def folder(write):
    return write("documents", made(), SCHEMA)


def windows(rows, size=20):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for a in range(len(words) - size + 1):
            key = tuple(words[a : a + size])
            if key in seen:
                gone[a : a + size] = [True] * size
            seen.add(key)
        out[i] = (len(words), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(words, gone) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_op2(spark, folder, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.op2_substring_dedup(spark, folder).collect()}
    assert got == windows(made())


def test_op2_in_batches(spark):
    """Batches with compaction between them, reopened each time, remove what one batch removes."""
    rows = made()
    df = substring_dedup.numbered(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"))
    cut = sorted(r[0] for r in rows)
    ends = [0, *(cut[len(cut) * k // 4] for k in (1, 2, 3)), 10**9]
    index = substring_dedup.FingerprintIndex(spark)
    total, counts = {}, []
    for a, b in zip(ends[:-1], ends[1:]):
        batch, past = df.where(f"doc_id >= {a} and doc_id < {b}"), df.where(f"doc_id < {a}")
        for r in substring_dedup.remove_repeats(batch, index.add(batch, past)).collect():
            total[r.doc_id] = (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest())
        counts.append([tier for _, tier in index.runs])
        for name, _ in index.runs:
            spark.sql(f"DROP TABLE {name}")
        index = substring_dedup.FingerprintIndex.open(spark, index.path)
    assert counts == [[0], [1], [1, 0], [2]] and total == windows(rows)
    index.drop()


@pytest.mark.parametrize("held", [1, 1_000_000])
def test_op2_null_and_repeated_ids(spark, monkeypatch, held):
    """Rows are separate documents: of equal ones the first keeps its text, and null ids come last; fingerprints may be common."""
    monkeypatch.setattr(substring_dedup, "HELD", held)
    monkeypatch.setattr(substring_dedup, "HOT", held)
    text, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(25))
    rows = [(1, text), (1, text), (1, other), (2, f"{other} {text}"), (None, text), (None, None), (None, f"x {other} y"), (None, " ".join(f"u{i}" for i in range(30))), (3, "")]
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed) for r in got) == [
        ("1", 25, 0), ("1", 40, 0), ("1", 40, 40), ("2", 65, 65), ("3", 0, 0), ("None", 0, 0), ("None", 27, 25), ("None", 30, 0), ("None", 40, 40),
    ]
    assert {r.kept for r in got if r.n_words == 27} == {"x y"}


def shingles(text, k=4):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def linked(rows, k, percent):
    sets = {r[0]: shingles(r[1], k) for r in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (3, 70)])
@pytest.mark.parametrize("tight", [False, True])
def test_op4(spark, monkeypatch, k, percent, tight):
    """Tight: nearly all tokens are frequent, buckets are large, blocks small."""
    if tight:
        for name, value in (("SMALL", 2), ("WIDE", 60), ("TILE", 3), ("BLOCK_TOKENS", 3000)):
            monkeypatch.setattr(jaccard_join, name, value)
        monkeypatch.setattr(jaccard_join.frequent_tokens, "__defaults__", (2, 1 << 20))
    rows = made(n=40 if tight else 60)
    got = jaccard_join.jaccard_components(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == linked(rows, k, percent)


def test_op8(spark, folder):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bpe.public_vocabulary()
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op8_byte_bpe(spark, folder).collect()}
    for i, t, *_ in made():
        ids = plain.encode_ordinary(t or "")
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_op8_null_and_repeated_ids(spark):
    """Each row by itself, whatever its id."""
    rows = [(None, "hello you"), (None, None), (1, "hello you"), (1, "hello you"), (1, "")]
    got = bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), *bpe.public_vocabulary()).collect()
    hello = [r for r in got if r.n_tokens]
    assert len(got) == 5 and len(hello) == 3 and len({r.ids_sha256 for r in hello}) == 1 and {r.decoded_sha256 for r in got} == {hashlib.sha256(x).hexdigest() for x in (b"", b"hello you")}


def test_bpe_odd_texts():
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bpe.public_vocabulary()
    own = bpe.Codec(bpe.read_ranks(path), pattern)
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["".join(rng.choice(" \n\t'sabtéß1!%　\x1c\x85🙂-") for _ in range(rng.randint(0, 14))) for _ in range(2000)] + ["ab" * 5000, "a" * 3001, " " * 999, "abcabd" * 999]
    for text, got in zip(texts, own.encode_all(texts)):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode_ordinary(text) and own.decode(got) == text.encode()


def test_encoded_column(spark):
    df = bpe.encode(spark.createDataFrame([(1, "hello hello"), (2, None)], "doc_id long, text string"), *bpe.public_vocabulary())
    assert [(r.doc_id, r.n_tokens, len(r.ids)) for r in df.orderBy("doc_id").collect()] == [(1, 2, 2), (2, 0, 0)] or df.first().n_tokens == len(df.first().ids)


def spans(lines):
    """The spans [begin, end) that are compared: chunks, and chunks with a line more on either side."""
    hashes = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    parts, begin = [], 0
    for j in range(len(lines)):
        if j == len(lines) - 1 or ((hashes[j] + 31 * (hashes[j - 1] if j else 0)) >> 5) % 4 > 0:
            parts.append((begin, j + 1))
            begin = j + 1
    wider = parts + [(a - 1, b) for a, b in parts if a] + [(a, b + 1) for a, b in parts if b < len(lines)]
    content = lambda a, b: sum(x.isalpha() or x.isnumeric() for x in "\n".join(lines[a:b]))
    return sorted({(a, b) for a, b in wider if b - a >= line_dedup.MIN_LINES and content(a, b) >= line_dedup.MIN_CONTENT})


def chunks(rows):
    out, first = {}, {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        if t is None:
            out[i] = (None, 0, 0)
            continue
        lines = t.split("\n")
        gone = set()
        for a, b in spans(lines):
            if first.setdefault("\n".join(lines[a:b]), (i, a)) != (i, a):
                gone |= set(range(a, b))
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone))
    return out


def test_op9(spark, folder):
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.op9_line_dedup(spark, folder).collect()}
    want = chunks(made())
    assert got == want and sum(x[2] for x in want.values()) > 0


def test_op9_leaves_form_and_takes_any_column(spark):
    """Blank lines, braces and rules stay where what stands between them differs; columns of any name come through."""
    name = lambda i, k: f"paragraph {k} of document {i} says something of its own"
    rows = [(i, "\n".join([name(i, 1), "", "", name(i, 2), "}", "}", "", "---", "", name(i, 3), ""]), i, "c", "x") for i in range(6)]
    rows += [(10 + i, f"own {i}\n\n" + "a passage that is told again,\n\nline for line, in each of these\nand then ends here" + f"\n\nown end {i}", i, "c", "x") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _lines int, _codes string, _further string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert all(got[i].text == t and got[i].n_removed == 0 for i, t, *_ in rows[:6])
    assert sum(got[i].n_removed for i in (11, 12, 13)) >= 6 and all((got[i]._lines, got[i]._codes, got[i]._further) == (n, "c", "x") for i, _, n, *_ in rows)
    with pytest.raises(ValueError, match="n_lines"):
        line_dedup.dedup_lines(docs.withColumn("n_lines", F.lit(1)))


def test_taken_names_raise(spark):
    docs = spark.createDataFrame([(1, "some text", "x")], "doc_id long, text string, _language string")
    with pytest.raises(ValueError, match="_language"):
        language_id.predict_rows(docs, language_id.Models({}))
    with pytest.raises(ValueError, match="ids"):
        bpe.encode(docs.withColumnRenamed("_language", "ids"), *bpe.public_vocabulary())


def test_op9_finds_repeated_passages():
    """Of all lines in runs of two or more that stand earlier, nine in ten go, and no other line."""
    rng = random.Random(11)
    fresh = lambda k: ["".join(rng.choice("abcdefgh ") for _ in range(30)) for _ in range(k)]
    passages = [fresh(rng.choice([2, 3, 4, 6, 9, 15])) for _ in range(40)]
    rows = [(i, "\n".join(fresh(rng.randint(1, 8)) + rng.choice(passages) + fresh(rng.randint(1, 8)))) for i in range(400)]
    seen, again = set(), 0
    for _, t in rows:
        lines, hit = t.split("\n"), set()
        for k in range(len(lines) - 1):
            hit |= {k, k + 1} if (lines[k], lines[k + 1]) in seen else set()
            seen.add((lines[k], lines[k + 1]))
        again += len(hit)
    removed = sum(x[2] for x in chunks(rows).values())
    assert 0.9 * again <= removed <= again


def test_op9_null_and_repeated_ids(spark):
    text = "one line\nanother line\nthird line\nfourth line"
    rows = [(1, text, 5), (1, text, 6), (2, text, 7), (None, text, 8), (None, None, 9), (3, None, 1), (4, "", 2), (5, "x\nx\nx\nx", 3)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_lines int"), counts=("lines", "removed")).collect()
    assert sorted(((str(r.doc_id), r.n_lines, r.text, r.lines, r.removed) for r in got), key=str) == sorted(
        [("1", 5, text, 4, 0), ("1", 6, text, 4, 0), ("2", 7, "", 4, 4), ("None", 8, text, 4, 0), ("None", 9, None, 0, 0), ("3", 1, None, 0, 0), ("4", 2, "", 1, 0), ("5", 3, chunks([(5, "x\nx\nx\nx")])[5][0], 4, chunks([(5, "x\nx\nx\nx")])[5][2])], key=str
    )


def test_op9_equal_fingerprints(spark, monkeypatch):
    """Texts under one fingerprint are told apart by their bytes."""
    monkeypatch.setattr(line_dedup.F, "xxhash64", lambda *a: F.lit(1).cast("long"))
    rows = made(n=30)
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert got == chunks(rows)


def test_op7(spark, write):
    rng = random.Random(1)
    words = {"aa": ["shtal", "ombra", "vent", "kelo"], "bb": ["ýrui", "çoqe", "ñamp", "luti"]}
    rows = [(i, " ".join(rng.choice(words[l]) for _ in range(rng.randint(3, 60))), l, "s", 0, 0, 0, 0, 0) for i in range(300) for l in [rng.choice(["aa", "bb"])]]
    rows += [(900, None, "aa", "s", 0, 0, 0, 0, 0), (901, "123 !!", "aa", "s", 0, 0, 0, 0, 0), (902, "ombra vent", None, "s", 0, 0, 0, 0, 0), (903, "xq" * 40_000, None, "s", 0, 0, 0, 0, 0)]
    got = {r.doc_id: r for r in language_id.op7_language_id(spark, write("documents", rows, SCHEMA)).collect()}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    assert all(got[r[0]].lang_pred == r[2] for r in rows[:300]) and not any(got[r[0]].rejected for r in rows[:300])
    assert (got[900].lang_pred, got[901].lang_pred, got[902].lang_pred) == ("und", "und", "aa") and got[903].rejected
    assert {r.lang_pred for r in language_id.op7_language_id(spark, write("documents", rows[300:302], SCHEMA)).collect()} == {"und"}


def test_op7_scores(spark):
    """Cross-entropies against interpolated Kneser-Ney written out by definition, with dictionaries and recursion."""
    from collections import Counter
    from math import log

    rng = random.Random(4)
    said = {"aa": [rng.choice(["shtal", "ombra", "vent", "kelo", "om"]) for _ in range(60)], "bb": [rng.choice(["ýrui", "ñamp", "luti", "om"]) for _ in range(50)]}
    order = language_id.ORDER
    rows = []
    for lang, words in said.items():
        rows += list(next(language_id._grams([language_id.pa.RecordBatch.from_pydict({"lang": [lang], "text": [" ".join(words)]})])).to_pylist())
    models = language_id.Models(language_id._counts([(r["lang"], r["gram"], r["n"]) for r in rows]))
    letters = {g for words in said.values() for w in words for g in f"{w} "}
    tests = ["ombra om", "luti ñamp shtal", "zzz q", "kel"]
    got, size = models.entropies(tests)
    for j, lang in enumerate(models.languages):
        marked = [f" {w} " for w in said[lang]]
        full = Counter(m[i - n + 1 : i + 1] for m in marked for i in range(1, len(m)) for n in [min(order, i + 1)])
        count = {order: Counter({g: n for g, n in full.items() if len(g) == order})}
        for n in range(order - 1, 0, -1):
            count[n] = Counter(g[1:] for g in count[n + 1]) + Counter({g: c for g, c in full.items() if len(g) == n})

        def p(gram):
            n = len(gram)
            if not n:
                return 1 / (len(letters) + 1)
            own = [c for g, c in count[n].items() if g[:-1] == gram[:-1]]
            if not own:
                return p(gram[1:])
            ones, twos = (sum(c == k for c in count[n].values()) for k in (1, 2))
            d = min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.1), 0.95)
            return max(count[n][gram] - d, 0) / sum(own) + d * len(own) / sum(own) * p(gram[1:])

        for t, text in enumerate(tests):
            marked = [f" {w} " for w in text.split()]
            probs = [p(m[max(0, i - order + 1) : i + 1]) for m in marked for i in range(1, len(m))]
            assert size[t] == len(probs) and abs(got[t, j] + sum(map(log, probs)) / len(probs)) < 1e-5


def test_op7_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(i % 5 or None, f"words of the kind {i % 3}", "en" if i % 2 else None) for i in range(30)], "doc_id long, text string, lang string")
    got = language_id.predict(docs, language_id.learn(docs)).collect()
    assert len(got) == 30 and {r.lang_pred for r in got} == {"en"} and sum(r.doc_id is None for r in got) == 6


def test_op10(spark, write):
    rng = random.Random(5)
    say = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(k))
    items = [say(rng.randint(15, 50)) for _ in range(30)] + ["tiny item", None, ""]
    items.append(items[0])
    rows, want = [], set()
    for i in range(80):
        text = say(rng.randint(0, 120))
        if i % 4 == 0:
            k = i % 30
            words = items[k].split(" ")
            if i % 8 == 0:
                words[-1] = "changed"  # one word at the end leaves most shingles
            text = f"{text} {' '.join(words).title()}, {say(20)}"
            want |= {(i, k)} | ({(i, 33)} if k == 0 else set())
        rows.append((i, text, "en", "s", 0, 0, 0, 0, 0))
    rows += [(900, None, "en", "s", 0, 0, 0, 0, 0), (901, "see TINY item here", "en", "s", 0, 0, 0, 0, 0), (902, " ".join(items[5].split(" ")[:8]), "en", "s", 0, 0, 0, 0, 0)]
    folder = write("documents", rows, SCHEMA)
    write("benchmark", list(enumerate(items)), "item_id long, text string")
    got = decontaminate.op10_decontaminate(spark, folder).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want | {(901, 30)}
    docs, bench = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    small = decontaminate.contaminated(docs, bench, max_index_bytes=10_000)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, got))
    assert {r.doc_id for r in decontaminate.without_items(docs, bench).collect()} == {r[0] for r in rows} - {r.doc_id for r in got}


def test_op10_against_all_windows(spark):
    """Every window of every item's size, compared by weighted shingles in plain Python."""
    import math
    from collections import Counter

    rng = random.Random(9)
    say = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    items = [say(rng.randint(3, 40)) for _ in range(12)]
    items[5] = items[4][:30] + say(3)
    docs = []
    for i in range(60):
        words = say(rng.randint(0, 60))
        own = list(items[i % 12])
        for _ in range(rng.choice([0, 0, 1, 2])):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        docs.append(words + own + say(rng.randint(0, 30)) if i % 3 else own[: max(1, len(own) - i % 4)])
    docs[1] = None
    grams = lambda words, k: [" ".join(words[j : j + k]) for j in range(len(words) - k + 1)]
    have = Counter(g for w in items for g in set(grams(w, min(5, len(w)))))
    weigh = lambda g: 1 + math.log(len(items) / max(have[g], 1)) if g in have else 1 + math.log(len(items))
    want = {}
    for i, words in enumerate(docs):
        for j, item in enumerate(items):
            k = min(5, len(item))
            b, size = Counter(grams(item, k)), min(len(item), len(words or []))
            for at in range(len(words or []) - size + 1 if size >= k else 0):
                a = Counter(grams(words[at : at + size], k))
                shared = sum(weigh(g) * n for g, n in (a & b).items())
                union = sum(weigh(g) * n for g, n in (a | b).items())
                if union and shared / union >= 0.8 - 1e-12 and shared / union > want.get((i, j), (0,))[0] + 1e-12:
                    want[i, j] = (shared / union, at, at + size)
    got = decontaminate.contaminated(
        spark.createDataFrame([(i, None if w is None else " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string"),
        spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(items)], "item_id long, text string"),
    ).collect()
    assert {(r.doc_id, r.item_id): (round(r.similarity, 9), r.first_word, r.end_word) for r in got} == {k: (round(v[0], 9), *v[1:]) for k, v in want.items()}
    assert len(got) > 25


def test_op10_null_and_repeated_ids(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"so {item} it is"), (1, f"so {item} it is"), (1, "clean"), (None, item), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (7, item), (None, item), (8, None)], "item_id long, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert sorted(str((r.doc_id, r.item_id)) for r in got) == sorted(str(x) for d in (1, 1, None) for x in ((d, 7), (d, 7), (d, None)))
    assert sorted(str(r.doc_id) for r in decontaminate.without_items(docs, bench).collect()) == ["1", "2"]


def test_block_tables_find_all_within_radius():
    """The tables give every item within the radius, repeated fingerprints included, and no other."""
    rng = np.random.default_rng(0)
    items = decontaminate.Items(list(range(300)), [" ".join(rng.choice(list("abcdefghij"), 30)) for _ in range(299)] + ["a b c d"])
    table = items.tables[30]
    table = decontaminate.Tables(table.items, np.concatenate([table.prints[:-5], table.prints[:5]]))
    probes = table.prints[rng.integers(0, 299, 1000)].view(np.uint8).copy()
    for row, n in zip(probes, rng.integers(0, 100, 1000)):  # 0 to 100 bits away
        for bit in rng.choice(decontaminate.BITS, n, replace=False):
            row[bit // 8] ^= 1 << (bit % 8)
    probes = probes.view(np.uint16)
    apart = np.bitwise_count(probes[:, None] ^ table.prints[None]).sum(axis=2)
    for radius in (decontaminate.RADIUS, 0, 40):
        rows, found, met = table.find(probes, radius)
        want = {(int(r), int(table.items[i])) for r, i in np.argwhere(apart <= radius)}
        assert set(zip(rows.tolist(), found.tolist())) == want and len(rows) == len(want) and len(rows) <= met < apart.size
    assert (apart == decontaminate.RADIUS).any() and (apart == decontaminate.RADIUS + 1).any()


def test_op10_candidates_come_from_the_tables():
    rng = random.Random(3)
    items = [[f"w{rng.randrange(400)}" for _ in range(25)] for _ in range(200)]
    index = decontaminate.Items(list(range(200)), [" ".join(w) for w in items])
    docs = [" ".join([*(f"x{rng.randrange(400)}" for _ in range(50)), *items[i], *(f"y{rng.randrange(400)}" for _ in range(50))]) for i in range(100)]
    assert [i for _, (i, *_) in decontaminate._matches(index, decontaminate.pa.array(docs))] == list(range(100))
    steps = index.steps
    assert steps["windows"] > 5 * steps["fingerprints"] >= 500 and steps["pairs_of_a_size"] == 200 * steps["fingerprints"]
    assert steps["pairs_of_a_size"] > 4 * steps["pairs_from_tables"] and steps["pairs_from_tables"] > 20 * steps["pairs_within_radius"] >= 20 * 100


@pytest.mark.parametrize("name", ["op2", "op4", "op7", "op8", "op9", "op10"])
def test_empty_tables(spark, write, name):
    folder = write("documents", [], SCHEMA)
    write("benchmark", [], "item_id long, text string")
    run = {"op2": substring_dedup.op2_substring_dedup, "op4": jaccard_join.op4_ngram_jaccard, "op7": language_id.op7_language_id, "op8": bpe.op8_byte_bpe, "op9": line_dedup.op9_line_dedup, "op10": decontaminate.op10_decontaminate}[name]
    assert run(spark, folder).count() == 0
