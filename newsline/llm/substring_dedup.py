"""Incremental removal of repeated passages with a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words of one document. Every window holds ``WINDOW -
GRAM + 1`` word grams; the one with the smallest hash (leftmost on ties) is its anchor, so
equal windows have equal anchors at equal places, and about one gram in eight is an
anchor. The index holds only anchors: each batch of documents becomes one immutable run,
bucketed and sorted by fingerprint. A new batch is merge-joined with itself and with the
older runs, bucket by bucket and without a shuffle of the runs. Where a fingerprint
returns, the windows at it are hashed whole (64 bits, other base, beside the 64 bits of
the anchor) and compared; only windows equal in both are repeats, so a shared anchor alone
removes nothing. Older texts are read again only for documents whose fingerprints return: a run with
all window hashes would be larger than the texts.

Windows travel by fingerprint, but those at very common fingerprints (more than one in a hundred thousand rows
of a run, ``HOT`` at least) by their own hashes: there a task compares the windows of its own texts
first and hands on only the oldest of equal ones, so of a passage that a third of all documents share each
window is a row a task, not a row a document.

Runs have tiers: ``FAN`` runs of one tier are compacted into one of the next, so a row is
rewritten a logarithmic number of times. The list of runs is a small table written anew with
every change; ``FingerprintIndex.open`` reads the last one, in any session.

Nulls: a null text has no words. Rows that share a doc_id are separate documents, in order of
their place in the table as written; rows with null doc_id come after all others and are separate documents
too. So of equal rows the first keeps its text. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsline.llm.common import bounded_batches, firsts_with, lists, released, rolling, slices, text_of, word_hashes, words
from newsline.llm.membership import keep_wanted
from newsline.plans.storage import materialize, partitions, remove, scratch, table

WINDOW = 20
GRAM = 6
FAN = 2
BATCHES = 3
HOT = 1000
HELD = 1_000_000  # windows at common fingerprints that a task compares at a time
_LAST = (1 << 63) - 1
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _leftmost_min(values: np.ndarray, width: int) -> np.ndarray:
    """For each i the place of the leftmost smallest of values[i : i + width]."""
    n = len(values) - width + 1
    at, have = np.arange(len(values)), 1
    while 2 * have <= width:
        left, right = at[: len(at) - have], at[have:]
        at = np.where(values[left] <= values[right], left, right)
        have *= 2
    left, right = at[:n], at[width - have : width - have + n]
    return np.where(values[left] <= values[right], left, right)


def _anchored(data: np.ndarray, offsets: np.ndarray, window: int, gram: int):
    """(anchor word, first window, windows) of each anchor, gram hashes, window hashes, word bounds.

    The windows of an anchor are consecutive and start at most ``window - gram`` words before it.
    """
    starts, ends, bounds = words(data, offsets)
    none = np.zeros(0, np.int64)
    if len(starts) < window:
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64), bounds
    hashes = word_hashes(data, starts, ends)
    grams, whole = rolling(hashes, gram), rolling(word_hashes(data, starts, ends, 2), window, 4)
    at = np.flatnonzero(firsts_with(bounds, window, len(starts)))
    anchor = _leftmost_min(grams, window - gram + 1)[at]
    if not len(at):
        return none, none, none, grams, whole, bounds
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return anchor[first], at[first], np.diff(np.append(first, len(at))), grams, whole, bounds


def _fingerprints(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in slices(batch.column("text")):
                anchor, _, _, grams, _, bounds = _anchored(data, offsets, window, gram)
                doc = pa.array(text_of(bounds)[anchor] + row)
                if len(anchor):
                    yield pa.RecordBatch.from_arrays([pa.array(grams[anchor].view(np.int64)), batch.column("ord").take(doc), batch.column("copy").take(doc)], ["fp", "ord", "copy"])

    return run


_WINDOW_ROWS = "key long, fp long, is_new boolean, ord long, copy long, start int, again boolean, hashes array<long>"


def _windows(window: int, gram: int, packed):
    """Rows of ``_WINDOW_ROWS``: the windows, from start on, at the fingerprints that the document's list names.

    At a common fingerprint a row is one window. Of equal ones held together only the oldest is handed on
    to be compared; the other new ones are marked as repeats, and the other old ones are dropped.
    """
    names = [x.split()[0] for x in _WINDOW_ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.frombuffer(packed.value, np.uint64)
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            whole, fp, is_new, ord_, copy, start = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((start, copy, ord_, is_new, fp, whole))
            whole, fp, is_new, ord_, copy, start = (x[order] for x in (whole, fp, is_new, ord_, copy, start))
            again = np.append(False, (whole[1:] == whole[:-1]) & (fp[1:] == fp[:-1]))
            keep = is_new | ~again
            # Repeats are done with; a key of their own deals them out evenly.
            key = np.where(again, ord_ * 31 + start, whole)
            cols = [pa.array(x[keep]) for x in (key, fp, is_new, ord_, copy, start, again)]
            return pa.RecordBatch.from_arrays([*cols, lists(whole[keep], np.ones(int(keep.sum()), np.int64), pa.int64())], names)

        for batch in batches:
            batch = batch.filter(batch.column("fps").is_valid())
            fps = batch.column("fps")
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("is_new", "ord", "copy")]
            for row, data, offsets in slices(batch.column("text")):
                anchor, first, count, grams, whole, bounds = _anchored(data, offsets, window, gram)
                if not len(anchor):
                    continue
                doc, fp = text_of(bounds)[anchor], grams[anchor]
                wanted = np.unique(fps.slice(row, len(offsets) - 1).flatten().to_numpy(zero_copy_only=False).view(np.uint64))
                keep = np.isin(fp, wanted)
                common = np.isin(fp, hot) & keep
                for some in (keep & ~common, common):
                    if not some.any():
                        continue
                    f, n, d, key = first[some], count[some], doc[some], fp[some].view(np.int64)
                    at = np.repeat(f, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    hashes = whole[at].view(np.int64)
                    if some is common:
                        d = np.repeat(d, n)
                        held.append((hashes, np.repeat(key, n), *(x[row + d] for x in own), (at - bounds[d]).astype(np.int32)))
                        size += len(at)
                    else:
                        cols = [pa.array(x) for x in (key, key, *(x[row + d] for x in own), (f - bounds[d]).astype(np.int32), np.zeros(len(d), bool))]
                        yield pa.RecordBatch.from_arrays([*cols, lists(hashes, n, pa.int64())], names)
                if size >= HELD:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and then age, the starts of new windows that are marked or came before under the same key.

    Keeps the window hashes of one key at a time, each once.
    """
    last, seen = None, np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        key, fp, marked = batch.column("key").to_numpy(), batch.column("fp").to_numpy(), batch.column("again").to_numpy(zero_copy_only=False)
        col = batch.column("hashes")
        counts = np.diff(col.offsets.to_numpy())
        flat = col.flatten().to_numpy()
        row = np.repeat(np.arange(len(fp)), counts)
        group = np.cumsum(np.append(0, (key[1:] != key[:-1]) | (fp[1:] != fp[:-1]) | (marked[1:] != marked[:-1])))
        order = np.lexsort((flat, group[row]))
        g, h = group[row][order], flat[order]
        again = np.zeros(len(flat), bool)
        again[order[1:]] = (g[1:] == g[:-1]) & (h[1:] == h[:-1])
        if last == (key[0], fp[0], marked[0]):
            begun = group[row] == 0
            again[begun] |= np.isin(flat[begun], seen)
        else:
            seen = np.zeros(0, np.int64)
        tail = flat[group[row] == group[-1]]
        seen = np.union1d(seen, tail) if group[-1] == 0 else np.unique(tail)
        last = key[-1], fp[-1], marked[-1]
        again = (again | marked[row]) & batch.column("is_new").to_numpy(zero_copy_only=False)[row]
        if not again.any():
            continue
        inside = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = batch.column("start").to_numpy()[row] + inside
        hit = np.unique(row[again])
        per = np.bincount(row[again], minlength=len(fp))[hit]
        at = pa.array(hit)
        yield pa.RecordBatch.from_arrays([batch.column("ord").take(at), batch.column("copy").take(at), lists(start[again].astype(np.int32), per, pa.int32())], ["ord", "copy", "starts"])


class FingerprintIndex:
    """Runs of (fp, ord, copy): ``add`` finds the repeats of a batch and makes it a run."""

    def __init__(self, spark: SparkSession, window: int = WINDOW, gram: int = GRAM, path: str | None = None, fan: int = FAN) -> None:
        self.spark, self.window, self.gram, self.fan = spark, window, gram, fan
        self.path = path or scratch(spark, "fingerprints")
        self.runs: list[tuple[str, int]] = []  # (table, tier), oldest first
        self.version, self.made, self.buckets = 0, 0, partitions(spark)

    @classmethod
    def open(cls, spark: SparkSession, path: str, fan: int = FAN) -> FingerprintIndex:
        """The index as its last change left it."""
        rows = spark.read.schema("version long, made long, place int, name string, tier int, window int, gram int, buckets int").json(f"{path}/manifest-*").collect()
        rows = sorted((r for r in rows if r.version == max(x.version for x in rows)), key=lambda r: r.place)
        index = cls(spark, rows[0].window, rows[0].gram, path, fan)
        index.version, index.made, index.buckets = rows[0].version, rows[0].made, rows[0].buckets
        for r in rows:
            if r.name is not None:
                spark.sql(f"CREATE TABLE IF NOT EXISTS {r.name} (fp BIGINT, ord BIGINT, copy BIGINT) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {r.buckets} BUCKETS LOCATION '{path}/{r.name}'")
                index.runs.append((r.name, r.tier))
        return index

    def _save(self) -> None:
        """Write the list of runs; a reader sees the old one or the new one."""
        self.version += 1
        fixed = (self.window, self.gram, self.buckets)
        rows = [(self.version, self.made, i, name, tier, *fixed) for i, (name, tier) in enumerate(self.runs)] or [(self.version, self.made, 0, None, None, *fixed)]
        found = self.spark.createDataFrame(rows, "version long, made long, place int, name string, tier int, window int, gram int, buckets int")
        found.coalesce(1).write.json(f"{self.path}/manifest-{self.version:08d}")

    def _write(self, rows: DataFrame) -> str:
        self.made += 1
        name = f"run_{self.path.rstrip('/').rsplit('/', 1)[-1].replace('-', '_')}_{self.made}"
        (
            rows.repartition(self.buckets, "fp").sortWithinPartitions("fp").write.format("parquet").bucketBy(self.buckets, "fp").sortBy("fp")
            .option("path", f"{self.path}/{name}").option("compression", "zstd").mode("overwrite").saveAsTable(name)
        )
        return name

    def compact(self) -> None:
        """Merge runs of one tier, newest tiers first, as long as ``fan`` of them are there."""
        while self.runs:
            tier = self.runs[-1][1]
            same = [r for r in self.runs if r[1] == tier]
            if len(same) < self.fan:
                return
            rows = self.spark.table(same[0][0])
            for name, _ in same[1:]:
                rows = rows.union(self.spark.table(name))
            self.runs = [r for r in self.runs if r[1] != tier] + [(self._write(rows), tier + 1)]
            self._save()
            for name, _ in same:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                remove(self.spark, f"{self.path}/{name}")

    def drop(self) -> None:
        """Remove the index and its files."""
        for name, _ in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.runs = []
        remove(self.spark, self.path)

    def add(self, docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """(ord, copy, starts), written: the windows of ``docs`` that started earlier; ``history``: all documents added before.

        Both have (ord, copy, text), a row's age being (ord, copy); all of ``docs`` counts as newer than ``history``.
        """
        bounded_batches(self.spark)
        at = ["ord", "copy"]
        name = self._write(docs.select(*at, "text").mapInArrow(released(_fingerprints(self.window, self.gram)), "fp long, ord long, copy long"))
        run, olds = self.spark.table(name), [self.spark.table(r) for r, _ in self.runs]
        found = run.join(run.groupBy("fp").count().where("count > 1").select("fp"), "fp", "left_semi").select(*at, "fp", F.lit(True).alias("is_new"))
        for old in olds:
            found = found.union(run.join(old.select("fp"), "fp", "left_semi").select(*at, "fp", F.lit(True)))
            found = found.union(old.join(run.select("fp"), "fp", "left_semi").select(*at, "fp", F.lit(False)))
        wanted = materialize(found.groupBy("is_new", *at).agg(F.collect_set("fp").alias("fps")), "wanted")
        # A fingerprint is common if it has more than its share of a run's rows, so there are few of them at any size.
        most = [(x, max(HOT, x.count() // 100_000)) for x in (run, *olds)]
        hot = sorted({r[0] for x, m in most for r in x.groupBy("fp").count().where(F.col("count") > m).select("fp").collect()})
        packed = self.spark.sparkContext.broadcast(np.array(hot, np.int64).view(np.uint64).tobytes())
        texts = docs.select(*at, "text").join(wanted.where("is_new").hint("shuffle_hash"), at).select("is_new", *at, "text", "fps")
        if history is not None and olds:
            older = wanted.where("not is_new")
            kept = keep_wanted(history.select(*at, "text"), "ord", older.select("ord"))
            texts = texts.union(kept.join(older.hint("shuffle_hash"), at).select("is_new", *at, "text", "fps"))
        rows = texts.mapInArrow(released(_windows(self.window, self.gram, packed)), _WINDOW_ROWS)
        dealt = rows.repartition(partitions(self.spark), "key").sortWithinPartitions("key", "fp", "again", "is_new", *at, "start")
        starts = dealt.mapInArrow(_repeats, "ord long, copy long, starts array<int>")
        repeats = materialize(starts.groupBy(*at).agg(F.flatten(F.collect_list("starts")).alias("starts")), "repeats")
        self.runs.append((name, 0))
        self._save()
        self.compact()
        return repeats


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, copy, text): ord and copy name a row and give its age; null doc_ids come last.

    Rows are numbered, in a written table, only if doc_ids are null or repeated.
    """
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("ord"), F.lit(0).cast("long").alias("copy"), "text")
    if rows.groupBy("ord").agg(F.count("*").alias("n")).where(F.col("n") > 1).isEmpty():
        return rows
    return materialize(rows.withColumn("copy", F.monotonically_increasing_id()), "numbered")


def _cut(window: int, digest: bool):
    """(doc_id, n_words, n_removed, kept): kept words joined by one space, or their digest, so no second copy of the texts moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, starts in zip(batch.column("text"), batch.column("starts")):
                found = _WORD.findall(text.as_py() or "")
                n = len(found)
                if starts.is_valid:
                    at = starts.values.to_numpy()
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, at, 1)
                    np.add.at(step, at + window, -1)
                    found = [found[i] for i in np.flatnonzero(np.cumsum(step)[:n] == 0)]
                n_words.append(n)
                n_removed.append(n - len(found))
                joined = " ".join(found)
                kept.append(hashlib.sha256(joined.encode("utf-8", "surrogatepass")).hexdigest() if digest else joined)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(rows: DataFrame, starts: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of numbered rows: every word under a listed window is gone, the others joined by one space.

    With ``digest``, kept is the SHA-256 of that text.
    """
    found = rows.join(starts.hint("shuffle_hash"), ["ord", "copy"], "left").select("doc_id", "text", "starts")
    return found.mapInArrow(released(_cut(window, digest)), "doc_id long, n_words long, n_removed long, kept string")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES, digest: bool = False) -> DataFrame:
    """All of ``docs``, added to an empty index in batches in order of doc_id."""
    rows = numbered(docs)
    ends = sorted({min(int(x), _LAST - 1) for x in rows.approxQuantile("doc_id", [(i + 1) / batches for i in range(batches - 1)], 0.01)})
    index, found = FingerprintIndex(docs.sparkSession, window), None
    for low, high in zip([None, *ends], [*ends, None]):
        batch = rows if low is None else rows.where(F.col("ord") > low)
        starts = index.add(batch if high is None else batch.where(F.col("ord") <= high), None if low is None else rows.where(F.col("ord") <= low))
        found = starts if found is None else found.union(starts)
    index.drop()
    return remove_repeats(rows, found, window, digest)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 20-word windows of all documents, cut at every place but the first."""
    return dedup_substrings(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
s AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM w WHERE len(w) >= 20),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) > 1 AS again FROM s),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS i FROM k WHERE again),
c AS (SELECT x.doc_id, count(*) AS n_words, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY x.i) FILTER (WHERE g.i IS NULL) AS kept FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.i = x.i GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id
"""
