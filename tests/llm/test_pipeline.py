import importlib

from tests.llm.test_texts import SCHEMA, chunks, linked, made


def test_stages(spark, write):
    """Each stage keeps what it must, on its own input; the last returns a row a document."""
    cp = importlib.import_module("corpus_pipeline")
    rows = [r for r in made()]
    folder = write("documents", rows, SCHEMA)
    write("benchmark", [(1, rows[0][1] and " ".join(rows[0][1].split()[:30]) or "a b c d e f g h i j"), (2, "nothing like it at all in here today or tomorrow")], "item_id long, text string")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "decontaminate", "byte_bpe"]
    for name, stage in cp.STAGES[:-1]:
        have = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, folder)
        assert out.columns == columns
        kept = {r.doc_id: r.text for r in out.collect()}
        if name == "language_id":
            assert set(kept) >= {i for i, t in have if t and len(t) > 100} - {69 * 3} and not set(kept) & {i for i, t in have if not (t or "").strip()}
        if name == "line_dedup":
            want = chunks(have)
            assert kept == {i: w[0] for i, w in want.items() if not w[2] or w[0].strip()}
        if name == "ngram_jaccard":
            assert set(kept) == {i for i, (_, c) in linked(have, cp.SHINGLE, cp.PERCENT).items() if i == c}
        docs = spark.createDataFrame(out.collect(), out.schema) if kept else out
    last = cp.STAGES[-1][1](spark, docs, folder)
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == docs.count()
    assert cp.run(spark, folder).count() == docs.count()


def test_empty(spark, write):
    cp = importlib.import_module("corpus_pipeline")
    folder = write("documents", [], SCHEMA)
    write("benchmark", [], "item_id long, text string")
    assert cp.run(spark, folder).count() == 0


def test_null_and_repeated_ids(spark, write):
    """Every stage takes rows without id and repeated ones; each keeps or drops them by its own rule and none crashes."""
    cp = importlib.import_module("corpus_pipeline")
    text = "\n".join(f"some words of line number {i} that say a little more than nothing at all" for i in range(12))
    rows = [(1, text), (1, text), (None, text), (None, None), (2, text.replace("number 3", "nr 3")), (3, None), (4, "other words that stand for themselves here " * 9)]
    rows = [(i, t, "en", "s", len(t or ""), 0, 0, 0, 0) for i, t in rows] + [(10 + i, f"plain text of the kind that teaches {i} " * 5, "en", "s", 1, 0, 0, 0, 0) for i in range(40)]
    folder = write("documents", rows, SCHEMA)
    write("benchmark", [(1, "other words that stand for themselves here other words that stand for themselves here")], "item_id long, text string")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {name: [r.doc_id for r in stage(spark, docs, folder).collect()] for name, stage in cp.STAGES}
    count = lambda name, i: kept[name].count(i)
    assert (count("language_id", 1), count("language_id", None), count("language_id", 3)) == (2, 1, 0)
    assert (count("line_dedup", 1), count("line_dedup", None), count("line_dedup", 3)) == (2, 2, 1)
    assert (count("ngram_jaccard", 1), count("ngram_jaccard", None), count("ngram_jaccard", 2)) == (2, 2, 0)
    assert (count("decontaminate", 4), count("decontaminate", None)) == (0, 2)
    assert len(kept["byte_bpe"]) == len(rows)
    assert cp.run(spark, folder).count() > 0


def test_columns_of_any_name_come_through(spark, write):
    cp = importlib.import_module("corpus_pipeline")
    text = "\n".join(f"some words of line number {i} that say a little more than nothing at all" for i in range(12))
    rows = [(i, text.replace("number", f"number {i}"), "en", "s", 1, f"a{i}", i, -i, "b") for i in range(40)]
    folder = write("documents", rows, "doc_id long, text string, lang string, source string, n_chars long, _language string, _n_lines int, _n_removed int, component_id string")
    write("benchmark", [(1, "not in any of them")], "item_id long, text string")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        assert {(r.doc_id, r._language, r._n_lines, r._n_removed, r.component_id) for r in out.collect()} <= {(r[0], *r[5:]) for r in rows} and out.count() > 0
