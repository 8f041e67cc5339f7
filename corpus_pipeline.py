"""Corpus cleaning: languages, repeated lines, near copies, benchmark leaks, tokens.

STAGES run in order; each gets what its predecessor kept, as the columns of ``documents``, and
its own result is written as Parquet in the session's shared folder before the next one
reads it. The last returns the token ids' counts and digests.

Rows are judged alone by the first, fourth and fifth stage, whatever their ids. Line dedup leaves rows with a
null doc_id as they are, and repeated rows count as one document and stay; near dedup keeps rows with a null
doc_id and repeated rows of the document that stays. Columns of any further name pass through all stages but the last. Null and empty texts have no language, so the first stage drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsline.llm import bpe, decontaminate, jaccard_join, language_id, line_dedup
from newsline.llm.common import free_name
from newsline.plans.storage import scratch, table

#: Near copies: similarity in hundredths of sets of five-word shingles.
SHINGLE, PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence stay; the labels given teach it (rows held out don't)."""
    columns, told = docs.columns, free_name(docs, "_language")
    models = language_id.learn(docs.where(~language_id.held_out()))
    kept = language_id.predict_rows(docs, models, told).where(~F.col(told).getField("rejected"))
    return kept.select(columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that stand earlier go; a document goes only if it had text and nothing is left."""
    columns, removed = docs.columns, free_name(docs, "_n_removed")
    done = line_dedup.dedup_lines(docs, counts=(free_name(docs, "_n_lines"), removed))
    kept = done.where((F.col(removed) == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    return kept.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays; rows without doc_id stay."""
    found = jaccard_join.jaccard_components(docs, SHINGLE, PERCENT)
    copies = found.where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(copies.hint("shuffle_hash"), "doc_id", "left_anti").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    return bpe.round_trip(docs, *bpe.public_vocabulary())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", dedup_near),
    ("decontaminate", drop_leaks),
    ("byte_bpe", tokenize),
]

#: The character models and the byte-pair merges are no SQL; tests/llm compares every stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage_{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
