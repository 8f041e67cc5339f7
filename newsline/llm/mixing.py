"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Words are runs of anything but U+0020 and U+0009 to U+000D. Each source's documents are shuffled by
a hash of id and text and laid end to end; the stream is cut into blocks of ``block`` words. A source's
target says how many blocks it gives: whole epochs of its stream, then a beginning of it to the word. The
slots of the mix are the numbers 0, 1, 2 .. whose van der Corput points (bits mirrored) fall into the
source's part of the cumulative weights, so the sources alternate evenly from the first slot on. The r-th
slot of a source, counted in closed form without any sort, takes its block r modulo the number of blocks.

Nothing is ordered as a whole: running sums are taken within buckets of the hash and over the
buckets' sums, a slot's rank comes from arithmetic, and slots meet documents by (source, block),
about ``block`` words a key however large a source is.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating, and share all words; a target ends at
three times its source, the rest is shared anew. No document is taken more than three times. Equal
inputs give equal mixes on any cluster.

Null and empty texts have no words and aren't taken; a null source is a source; rows with null or repeated
ids are rows of their own (rows equal in id and text lie side by side); further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsline.plans.storage import materialize, partitions, table

BLOCK = 8192
CHUNK = 4096
BUCKET_ROWS = 1 << 15
WEIGHTS = 3
MOST = 3
WORD = r"[^\x20\x09-\x0D]+"


def _before(df: DataFrame, group: list[str], part: str, order: list, value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the group that come earlier by (part, order).

    Parts hold few rows each; only their sums are ordered together.
    """
    keys = [*group, part]
    parts = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).alias("a").join(parts.alias("b"), same)
    return both.select("a.*", (F.col("a._in") + F.col("b._base")).alias(name)).drop("_in")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, place): words of each text, and the hash that shuffles it."""
    text = F.coalesce("text", F.lit(""))
    place = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(text)))
    return docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), place.alias("place"))


def targets(sizes: DataFrame, weights: int = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_no, source_size, target) of (source, size) rows.

    Each round shares what is left among the sources below their limit; one row a round reaches the driver.
    """
    n = partitions(sizes.sparkSession)
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    spread = own.repartitionByRange(n, F.col("source").asc_nulls_last())
    spread = materialize(spread.select("*", F.lit(1).alias("one"), F.spark_partition_id().alias("part")), "sources")
    ranked = _before(spread, [], "part", [F.col("source").asc_nulls_last()], "one", "source_no")
    ranked = ranked.select("source", "source_no", "source_size", "part", (F.col("source_no") % weights + 1).alias("weight"))
    ranked = materialize(ranked, "ranked")
    total, share = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    left, over, known = total or 0, share or 1, 0
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    while True:
        above = exact("source_size") * most * F.lit(over) < exact("weight") * F.lit(left)
        sums = F.sum(F.when(above, F.col("source_size") * most)), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)
        ended, others, count = ranked.agg(*sums).first()
        if count == known:
            break
        left, over, known = total - (ended or 0), others or 1, count
    limit, fair = (F.col("source_size") * most).cast("double"), (F.lit(left) * F.col("weight")).cast("double") / F.lit(over).cast("double")
    return ranked.select("source", "source_no", "source_size", "part", F.when(above, limit).otherwise(fair).alias("target"))


def _mirror(x: np.ndarray, bits: int) -> np.ndarray:
    """The lowest ``bits`` bits in reverse order."""
    out = np.zeros_like(x)
    for b in range(bits):
        out |= ((x >> b) & 1) << (bits - 1 - b)
    return out


def _earlier(slot: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int) -> np.ndarray:
    """How many numbers below each slot have a mirror image in [low, high).

    A smaller number agrees with the slot above some set bit, has 0 there and anything below: its image
    is a multiple of 2 ** (bits - b) plus a fixed rest, so the count is that of multiples in a range.
    """
    out = np.zeros_like(slot)
    for b in range(bits):
        rest = _mirror((slot >> (b + 1)) << (b + 1), bits)
        step = bits - b
        count = -((rest - high) >> step) + ((rest - low) >> step)
        out += np.where((slot >> b) & 1, count, 0)
    return out


def _slots(block: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own = np.arange(r["lo"], min(r["lo"] + CHUNK, r["k"]), dtype=np.int64)
                low, k, size = r["first"], r["k"], r["source_size"]
                slot = _mirror(low + own, bits)
                rank = _earlier(slot, np.int64(low), np.int64(low + k), bits)
                blocks = -(-size // block)
                at = rank % blocks
                words = np.minimum(block, size - at * block)
                if r["tail"]:
                    words = np.where(rank == k - 1, np.minimum(words, (r["tail"] - 1) % block + 1), words)
                columns = [np.full(len(own), r["source_no"]), slot, rank // blocks, at, words]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["source_no", "slot", "epoch", "block", "words"])

    return run


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source_no, slot, epoch, block, words): which block each slot of the mix takes, and how many of its words."""
    spark = sources.sparkSession
    whole = F.floor(F.col("target") + 0.5).cast("long")
    some = sources.where("source_size > 0").select("*", whole.alias("goal"))
    some = some.select("*", F.expr("goal div source_size").alias("epochs"), (F.col("goal") % F.col("source_size")).alias("tail"))
    blocks = lambda c: F.expr(f"({c} + {block} - 1) div {block}")
    some = some.select("source_no", "source_size", "part", "tail", (F.col("epochs") * blocks("source_size") + blocks("tail")).alias("k"))
    some = materialize(_before(some, [], "part", ["source_no"], "k", "first").where("k > 0"), "quotas")
    bits = max(1, int(some.agg(F.sum("k")).first()[0] or 0).bit_length())
    chunks = some.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1, F.lit(CHUNK).cast("long"))).alias("lo"))
    dealt = chunks.repartition(partitions(spark), "source_no", "lo")
    return dealt.mapInArrow(_slots(block, bits), "source_no long, slot long, epoch long, block long, words long")


def laid_out(docs: DataFrame, weights: int = WEIGHTS, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(documents, sources): documents as (doc_id, size, source_no, source_size, target, start), start being their place in their source's stream."""
    spark = docs.sparkSession
    light = materialize(sized(docs), "sized")
    sources = materialize(targets(light, weights, most), "targets")
    buckets = max(4 * partitions(spark), light.count() // BUCKET_ROWS)
    bits = min(31, buckets.bit_length())
    bucket = F.shiftright(F.conv(F.substring("place", 1, 8), 16, 10).cast("long"), 32 - bits).alias("bucket")
    dealt = light.select("*", bucket)
    # A source's row travels once a bucket, so that documents meet it where their bucket is.
    parts = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    parts = parts.alias("p").join(sources.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")))
    parts = parts.select("p.source", "p.bucket", "p.base", "s.source_no", "s.source_size", "s.target")
    inside = Window.partitionBy("source", "bucket").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.bucket") == F.col("p.bucket"))
    rows = placed.alias("d").join(parts.alias("p"), same)
    rows = rows.select("d.doc_id", "d.size", "p.source_no", "p.source_size", "p.target", (F.col("p.base") + F.col("d.inside")).alias("start"))
    return materialize(rows, "laid"), sources


def spans(laid: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, at, doc_id, source_no, start, epoch, first, words): the mix, read by (slot, at).

    ``words`` words of the document from its word ``first`` stand at word ``at`` of the slot; start names the document within its source.
    """
    begin, end = F.col("start"), F.col("start") + F.col("size") - 1
    per = F.lit(block).cast("long")
    cut = laid.where("size > 0").select("*", F.explode(F.sequence(F.floor(begin / per).cast("long"), F.floor(end / per).cast("long"))).alias("block"))
    low = F.greatest(begin - F.col("block") * per, F.lit(0))
    high = F.least(end + 1 - F.col("block") * per, per)
    pieces = cut.select("doc_id", "source_no", "start", "block", low.alias("low"), high.alias("high"))
    met = pieces.join(schedule(sources, block), ["source_no", "block"]).where("low < words")
    first = F.col("block") * per + F.col("low") - F.col("start")
    return met.select("slot", F.col("low").alias("at"), "doc_id", "source_no", "start", "epoch", first.alias("first"), (F.least("high", "words") - F.col("low")).alias("words"))


def taken(laid: DataFrame, mix: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken): how many words of each document the mix takes."""
    used = mix.groupBy("source_no", F.col("start").alias("at")).agg(F.sum("words").alias("taken"))
    some = laid.where("size > 0").join(used.withColumnRenamed("at", "start"), ["source_no", "start"], "left")
    none = laid.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return some.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")).union(none)


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    laid, sources = laid_out(table(spark, sf_dir, "documents"))
    return taken(laid, spans(laid, sources))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', md5(coalesce(text, '')))) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
t AS (SELECT CAST(sum(s) AS BIGINT) AS t, CAST(sum(w) AS BIGINT) AS tw FROM s),
o AS (SELECT *, row_number() OVER v - 1 AS i, CAST(t - coalesce(sum(3 * s) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lt,
  CAST(tw - coalesce(sum(w) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lw FROM s, t WINDOW v AS (ORDER BY s / w, source NULLS LAST)),
c AS (SELECT i AS n, lt, lw FROM o WHERE 3 * s * lw >= lt * w ORDER BY i LIMIT 1),
g AS (SELECT source, s, CASE WHEN i < n THEN CAST(3 * s AS DOUBLE) ELSE CAST(c.lt * w AS DOUBLE) / c.lw END AS target FROM o, c),
p AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d),
q AS (SELECT doc_id, size, s AS source_size, target, start, CAST(floor(target + 0.5) AS BIGINT) AS goal FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE size * (goal // source_size) + greatest(0, least(start + size, goal % source_size) - start) END AS taken FROM q
"""
