import random
import re

from newsline.operators.normalize import entity_vocabulary, extract_entities

FOLD = str.maketrans("ışğüöç", "isguoc")


def fold(text):
    return text.translate(str.maketrans("İI", "iı")).lower().translate(FOLD)


def slow(text, entries):
    """All forms at word boundaries; earliest start, then longest; later overlaps go."""
    hits = []
    for canonical, kind, aliases in entries:
        for form in (canonical, *aliases):
            for m in re.finditer(rf"(?<![^\W_]){re.escape(fold(form))}(?![^\W_])", fold(text)):
                hits.append((m.start(), -m.end(), canonical, kind))
    out, upto = [], 0
    for start, back, canonical, kind in sorted(hits):
        if start >= upto:
            out.append((start, -back, canonical, kind))
            upto = -back
    return out


ENTRIES = [
    ("Halkların Eşitlik ve Demokrasi Partisi", "PARTY", ("HEDEP",)), ("Koç A.Ş.", "COMPANY", ()), ("Koç", "COMPANY", ()), ("Merkez Bankası", "INSTITUTION", ("TCMB", "M.B.")), ("'x", "PERSON", ()), ("a\\Eb", "PERSON", ()), ("***", "PERSON", ()),
]


def run(spark, texts):
    vocabulary = entity_vocabulary(spark.createDataFrame(ENTRIES, "canonical string, type string, aliases array<string>"))
    rows = extract_entities(spark.createDataFrame(list(enumerate(texts)), "id int, body string"), vocabulary).collect()
    return {i: sorted((r.start, r.end, r.text, r.type) for r in rows if r.id == i) for i in range(len(texts))}


def test_names_of_any_length_and_edge(spark):
    texts = ["HALKLARIN EŞİTLİK VE DEMOKRASİ PARTİSİ ve Koç A.Ş. ile Koç A.", "Koçlar TCMB_x 'x y'x a\\Eb *** M.B. merkez bankasi", None, ""]
    got = run(spark, texts)
    assert got == {i: slow(t or "", [e for e in ENTRIES if e[0] != "***"]) for i, t in enumerate(texts)}
    assert got[0][0][2:] == ("Halkların Eşitlik ve Demokrasi Partisi", "PARTY") and got[0][1][2] == "Koç A.Ş."


def test_random_texts(spark):
    rng = random.Random(2)
    pieces = ["Koç", " ", " ", ".", "A.Ş.", "TCMB", "Merkez Bankası", "'x", "ı", "İ", "\n", "Halkların Eşitlik ve Demokrasi Partisi", "_", "M.B."]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(150)]
    assert run(spark, texts) == {i: slow(t, [e for e in ENTRIES if e[0] != "***"]) for i, t in enumerate(texts)}


def test_many_names_of_one_first_word_and_edges(spark):
    """A common first word with very many names; names that overlap themselves; edges that touch words or the text's ends; a long text."""
    entries = [(f"the {a} {b}", "PERSON", ()) for a in "abcdefgh" for b in "abcdefgh"] + [("the", "PARTY", ()), ("a the a", "COMPANY", ()), ("(x) y", "PERSON", ()), ("z..", "PARTY", ("'q'",))]
    rng = random.Random(4)
    pieces = ["the", "a", "b", "c", "x", "(x) y", "z..", "z.", "'q'", "'", "q", " ", " ", " ", "(", ")", "\n", "."]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    texts += ["the a the a the b", "q'q'q'", "'q'", "(x) y", "y(x) y", "z..", "z..z", "the a b " * 3000]
    vocabulary = entity_vocabulary(spark.createDataFrame(entries, "canonical string, type string, aliases array<string>"))
    found = extract_entities(spark.createDataFrame(list(enumerate(texts)), "id int, body string"), vocabulary).collect()
    for i, text in enumerate(texts):
        assert sorted((r.start, r.end, r.text, r.type) for r in found if r.id == i) == slow(text, entries), text[:60]


def test_texts_do_not_move(spark):
    """Only ids and what was found are dealt out, whatever joins Spark takes."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        vocabulary = entity_vocabulary(spark.createDataFrame(ENTRIES, "canonical string, type string, aliases array<string>"))
        found = extract_entities(spark.createDataFrame([(1, "Koç A.Ş. ile TCMB")], "id int, body string"), vocabulary)
        moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
        columns = {c.split("#")[0].strip() for x in moved for c in x.split(",")}
        assert columns and not columns & {"body", "t", "pieces", "runs"}, columns
        assert sorted(r.text for r in found.collect()) == ["Koç A.Ş.", "Merkez Bankası"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_full_tables_lose_nothing(spark, monkeypatch):
    """Two slots: every word and every run passes; long texts have several groups of sums and blocks of hits."""
    from newsline.operators import normalize

    entries = [("the", "PARTY", ()), ("a the a", "COMPANY", ()), ("the a", "PARTY", ("q.",)), ("x 1 x", "PERSON", ("'x'",))]
    rng = random.Random(7)
    texts = ["".join(rng.choice(["the", "a", "x", "1", "q", " ", " ", " ", "'", ".", "😀", "ß", "\n"]) for _ in range(n)) for n in (0, 1, 2, 15, 16, 17, 511, 512, 513, 1023, 1024, 1025, 3000)] + ["a the " * 700, " ".join("x1" * 300)]
    monkeypatch.setattr(normalize, "SLOTS", 2)
    vocabulary = entity_vocabulary(spark.createDataFrame(entries, "canonical string, type string, aliases array<string>"))
    found = extract_entities(spark.createDataFrame(list(enumerate(texts)), "id int, body string"), vocabulary).collect()
    for i, text in enumerate(texts):
        assert sorted((r.start, r.end, r.text, r.type) for r in found if r.id == i) == slow(text, entries), text[:60]


def test_query_equals_sql_on_odd_rows(spark, write):
    """Events that stand twice or are missing, null and short texts, heads with other white space, long words, sources without names."""
    import duckdb

    import __spark_entry__ as entry

    head = ["\talpha  beta\ngamma delta epsilon zeta eta", " one two three four five six", "a b c d e", "a b c d e ", "x" * 9000 + " y z y z y z", "İI ı Ş.  Ğ ü ö ç k", "\n\n a  b", "b b b b b b b b b"]
    rows = [(i, None if i % 11 == 5 else " ".join([head[i % 8], *(head[(i * k + j) % 8] for j, k in enumerate((3, 5, 7)))]) if i % 3 else head[i % 8], "en", f"src{i % 5}", 1) for i in range(60)]
    sf = write("documents", [*rows, (60, "", "en", "src9", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    write("events", [(i, None, 0, "view", 0.0) for i in [*range(0, 50), *range(20, 58), 99]], "event_id long, ts timestamp, user_id long, event_type string, value double")
    write("embeddings", [], "vec_id long, label int")
    write("pages", [], "page_id long, url string, html string")
    con = duckdb.connect()
    for name in ("documents", "events", "embeddings", "pages"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet/*.parquet'")
    for name in ("entity_vocabulary", "extracted_entities"):
        found = entry.queries()[name](spark, sf)
        assert sorted(map(tuple, found.collect())) == sorted(con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in found.columns)} from ({entry.oracle_sql()[name]})").fetchall())
