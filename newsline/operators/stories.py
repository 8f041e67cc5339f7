"""Articles to stories: roles, exact parallel greedy clustering, ids, tables.

Greedy clustering is sequential, yet most of its work is not: (1) a gap of more than the window
between neighbours of one language closes every story, so runs are apart; (2) most open stories
have one article, and whether another article is near that one doesn't depend on any story. Tasks
of one window of time each guess which articles seed stories (leaders) and find, by matrix products
with the window before, the leaders that each article is near. Each run is then read in order by
one task; an article meets the leaders it is near that did seed, and by a product only the stories
of two articles or more and those that were not guessed. Guesses only decide where a story is
met, so any guess gives the result of the plain pass. Only the open stories are held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsline.functions.text import word_count
from newsline.operators.vectors import centroid
from newsline.plans.storage import materialize, partitions

SKIP_BELOW, SEED_FROM = 10, 30


def eligible_articles(articles: DataFrame, sources: DataFrame, embedded: DataFrame, touched: DataFrame) -> DataFrame:
    """Articles of this run's sources without vector, with the defaults for missing values.

    ``articles`` has body, or word_count in its place; words are counted first, so no join moves a body.
    """
    counted = F.col("word_count") if "word_count" in articles.columns else word_count(F.col("body"))
    rows = articles.select("id", "source_id", "title", "lead", "published_at", "language", counted.alias("word_count"))
    rows = rows.join(touched.select("source_id").distinct(), "source_id", "left_semi").join(embedded.select("id").distinct(), "id", "left_anti")
    rows = rows.join(sources.select(F.col("id").alias("source_id"), "band"), "source_id", "left")
    return rows.select("id", "source_id", F.coalesce("band", F.lit("")).alias("band"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("lead", F.lit("")).alias("lead"), "published_at", F.coalesce("language", F.lit("unknown")).alias("language"), "word_count")


def length_gate(df: DataFrame, words: str = "word_count") -> DataFrame:
    """Adds role: skip under 10 words, join under 30, else seed."""
    return df.withColumn("role", F.when(F.col(words) < SKIP_BELOW, "skip").when(F.col(words) < SEED_FROM, "join").otherwise("seed"))


def gap_runs(df: DataFrame, hours: int = 24) -> DataFrame:
    """Adds run: articles of a language whose neighbours are at most ``hours`` apart share one.

    The table is cut by language and day first, so no task orders a whole language: only the days' ends meet.
    """
    days = df.withColumn("_day", F.to_date("published_at"))
    inner = Window.partitionBy("language", "_day").orderBy("published_at")
    gap = lambda later, earlier: later > earlier + F.expr(f"INTERVAL {hours} HOURS")
    ends = days.groupBy("language", "_day").agg(F.min("published_at").alias("_first"), F.max("published_at").alias("_last"))
    ends = ends.withColumn("_before", F.lag("_last").over(Window.partitionBy("language").orderBy("_day")))
    ends = ends.withColumn("_new", F.when(F.col("_before").isNull() | gap(F.col("_first"), F.col("_before")), F.col("_day")))
    ends = ends.withColumn("run", F.last("_new", ignorenulls=True).over(Window.partitionBy("language").orderBy("_day")))
    if hours >= 24:  # a gap inside one day is shorter
        return days.join(ends.select("language", "_day", "run"), ["language", "_day"]).drop("_day")
    inside = F.sum(F.when(gap(F.col("published_at"), F.lag("published_at").over(inner)), 1).otherwise(0)).over(inner)
    joined = days.withColumn("_part", inside).join(ends.select("language", "_day", "run"), ["language", "_day"])
    return joined.withColumn("run", F.concat("run", F.lit("/"), F.when(F.col("_part") > 0, F.concat("_day", F.lit("."), F.col("_part"))).otherwise(""))).drop("_day", "_part")


#: Articles that are compared with the open stories together, and how much less a cosine in single precision may say.
BATCH, MARGIN = 128, 1e-3


class OpenStories:
    """The stories that an article may still join; articles come in order of time.

    A batch of articles meets the open stories in one matrix product in single precision, and again each story that the
    batch itself changes. Only what comes within MARGIN of the threshold there is compared in double precision.
    A story of one article may be ``listed``: it is left out of the product until it takes a second article, and
    whoever calls gives its slot with each article that is near it.
    """

    def __init__(self, threshold: float, hours: int, dims: int):
        self.threshold, self.limit, self.dims = threshold, hours * 3_600_000_000, dims
        self.names, self.moved, self.now = [], None, None
        self._resize(np.arange(0), 16)

    def _resize(self, keep: np.ndarray, size: int) -> None:
        n, before = len(keep), len(self.names)
        for name, kind in (("sums", float), ("counts", np.int64), ("last", np.int64), ("lengths", float), ("hot", np.int64)):
            old = getattr(self, name, None)
            if before and size <= len(old):
                old[:n] = old[keep]
                old[n:before] = 0
            else:
                new = np.zeros((size, self.dims) if name == "sums" else size, kind)
                if n:
                    new[:n] = old[keep]
                setattr(self, name, new)
        self.names = [self.names[k] for k in keep]
        # Rows of the product: a unit vector and the slot of each story in it.
        self.hot[n:] = -1
        some = np.flatnonzero(self.hot[:n] >= 0)
        units, slots = np.zeros((max(16, 2 * len(some)), self.dims), np.float32), np.zeros(max(16, 2 * len(some)), np.int64)
        if len(some):
            units[: len(some)], slots[: len(some)] = self.units[self.hot[some]], some
        self.units, self.slots, self.n_hot = units, slots, len(some)
        self.hot[some] = np.arange(len(some))
        if self.moved and before:
            slot = np.full(before, -1)
            slot[keep] = np.arange(n)
            self.moved(slot)

    def heat(self, at: int) -> None:
        """From now on the story is in the product."""
        if self.hot[at] < 0:
            if self.n_hot == len(self.units):
                self.units, self.slots = (np.concatenate([x, np.zeros_like(x)]) for x in (self.units, self.slots))
            self.hot[at], self.slots[self.n_hot] = self.n_hot, at
            self.n_hot += 1
        row = self.hot[at]
        self.units[row] = self.sums[at] / (self.counts[at] * self.lengths[at]) if self.lengths[at] > 0 else 0.0
        if self.now:
            vectors, like = self.now
            like[:, row] = vectors @ self.units[row]

    def _put(self, at: int, time: int, listed: bool) -> None:
        self.lengths[at] = np.linalg.norm(self.sums[at] / self.counts[at])
        self.last[at] = max(self.last[at], time)
        if not listed:
            self.heat(at)

    def place(self, time: int, places: np.ndarray, weights: np.ndarray, seed: bool, name):
        """The name of the story that takes the article, ``name`` itself if it seeds one, None if it does neither."""
        return self.place_all([time], [places], [weights], [seed], [name])[0]

    def place_all(self, times: list, places: list, weights: list, seeds: list, names: list) -> list:
        """What ``place`` gives for each article in turn."""
        out = []
        for at in range(0, len(times), BATCH):
            out += self.batch(*(x[at : at + BATCH] for x in (times, places, weights, seeds, names)))
        return out

    def batch(self, times: list, places: list, weights: list, seeds: list, names: list, listed: list | None = None, near=None) -> list:
        """As place_all. ``listed``: which articles would seed listed stories; ``near`` (i) the slots of those that the i-th is near, as they are when it comes."""
        n, size = len(self.names), len(times)
        if n + size > len(self.sums):
            # Closed stories go, and the tables grow only if half of the rows are still open.
            keep = np.flatnonzero(times[0] - self.last[:n] <= self.limit)
            self._resize(keep, max(16, 2 * (len(keep) + size)) if 2 * (len(keep) + size) > len(self.sums) else len(self.sums))
        norms, sizes = [np.linalg.norm(w) for w in weights], [len(p) for p in places]
        vectors = np.zeros((size, self.dims), np.float32)
        scale = np.repeat([1 / x if x > 0 else 0.0 for x in norms], sizes)
        vectors[np.repeat(np.arange(size), sizes), np.concatenate(places)] = np.concatenate(weights) * scale
        like = np.empty((size, self.n_hot + size), np.float32)  # an article makes one column new at most
        np.matmul(vectors, self.units[: self.n_hot].T, out=like[:, : self.n_hot])
        self.now, out = (vectors, like), []
        for i, time in enumerate(times):
            some = self.slots[np.flatnonzero(like[i, : self.n_hot] >= self.threshold - MARGIN)].tolist()
            if near is not None:
                some += near(i, out)
            out.append(self._one(time, places[i], weights[i], norms[i], seeds[i], names[i], some, listed is not None and listed[i]))
        self.now = None
        return out

    def _one(self, time: int, places: np.ndarray, weights: np.ndarray, norm: float, seed: bool, name, some: list, listed: bool):
        if some and norm > 0:
            near = np.array(sorted(some))
            means = self.sums[near[:, None], places].T / self.counts[near]
            length = self.lengths[near]
            like = np.where(length > 0, weights @ means / np.where(length > 0, length, 1) / norm, 0.0)
            like[time - self.last[near] > self.limit] = -2.0
            best = int(np.argmax(like))
            if like[best] >= self.threshold:
                at = int(near[best])
                self.sums[at, places] += weights
                self.counts[at] += 1
                self._put(at, time, False)
                return self.names[at]
        if not seed:
            return None
        n = len(self.names)
        self.sums[n, places], self.counts[n], self.last[n] = weights, 1, time
        self.names.append(name)
        self._put(n, time, listed)
        return name


def greedy(times: np.ndarray, vectors: np.ndarray, seeds: np.ndarray, threshold: float, hours: int) -> np.ndarray:
    """Story number of each article in order of time, -1 for those that neither join nor seed.

    An article joins the story with the highest cosine at the threshold among those updated within ``hours``; the earliest on ties.
    """
    micros = times.astype("datetime64[us]").astype(np.int64)
    found, begun = OpenStories(threshold, hours, vectors.shape[1]), 0
    out = np.full(len(times), -1)
    for i in range(len(times)):
        some = np.flatnonzero(vectors[i])
        story = found.place(int(micros[i]), some, vectors[i][some], bool(seeds[i]), begun)
        out[i] = -1 if story is None else story
        begun += story == begun
    return out


#: Articles that look for their leaders together.
CHUNK = 512


class _Leaders:
    """Guesses which articles seed stories: those that no leader of the last window is near. It only has to be right often."""

    def __init__(self, threshold: float, hours: int, dims: int):
        self.threshold, self.limit, self.n, self.seen = threshold, hours * 3_600_000_000, 0, 0
        self.units, self.times, self.ranks = np.zeros((16, dims), np.float32), np.zeros(16, np.int64), np.zeros(16, np.int64)

    def add(self, times: np.ndarray, sizes: np.ndarray, places: np.ndarray, weights: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lead, sizes, ranks): whether each article is a leader, and the leaders before it that are near it, by the number of articles that came before them."""
        lead, near = [], []
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for at in range(0, len(times), CHUNK):
            to = min(at + CHUNK, len(times))
            part = slice(ends[at], ends[to])
            own, rows, ranks = self._chunk(times[at:to], sizes[at:to], places[part], weights[part], seeds[at:to])
            lead.append(own)
            near.append((at + rows, ranks))
        rows, ranks = (np.concatenate([x[k] for x in near]) for k in (0, 1))
        return np.concatenate(lead), np.bincount(rows, minlength=len(times)), ranks

    def _chunk(self, times, sizes, places, weights, seeds):
        keep = np.flatnonzero(times[0] - self.times[: self.n] <= self.limit)
        if self.n + len(times) > len(self.units) or 4 * len(keep) < 3 * self.n:
            size = max(16, 2 * (len(keep) + len(times)))
            for name in ("units", "times", "ranks"):
                old = getattr(self, name)
                new = np.zeros((size, *old.shape[1:]), old.dtype)
                new[: len(keep)] = old[keep]
                setattr(self, name, new)
            self.n = len(keep)
        m = len(times)
        vectors, row = np.zeros((m, self.units.shape[1]), np.float32), np.repeat(np.arange(m), sizes)
        norms = np.sqrt(np.bincount(row, weights * weights, m))
        vectors[row, places] = weights / np.where(norms > 0, norms, 1)[row]
        product, inside = vectors @ self.units[: self.n].T, vectors @ vectors.T
        rows, cols = np.nonzero(product >= self.threshold - MARGIN)
        later, earlier = np.nonzero(np.tril(inside >= self.threshold - MARGIN, -1))
        lead = seeds & (norms > 0)
        lead[rows[product[rows, cols] >= self.threshold]] = False
        for i, j in zip(*(x[lead[later] & lead[earlier] & (inside[later, earlier] >= self.threshold)] for x in (later, earlier))):
            if lead[j]:
                lead[i] = False
        some = lead[earlier]
        rows, ranks = np.concatenate([rows, later[some]]), np.concatenate([self.ranks[cols], self.seen + earlier[some]])
        order = np.argsort(rows, kind="stable")
        own = np.flatnonzero(lead)
        new = slice(self.n, self.n + len(own))
        self.units[new], self.times[new], self.ranks[new] = vectors[own], times[own], self.seen + own
        self.n, self.seen = new.stop, self.seen + m
        return lead, rows[order], ranks[order]


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(ends, values) of a column of lists, ends from 0."""
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.flatten().to_numpy(zero_copy_only=False)


def _parts(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of rows with the same keys."""
    rows, begin = list(zip(*(batch.column(c).to_pylist() for c in keys))), 0
    for end in range(1, len(rows) + 1):
        if end == len(rows) or rows[end] != rows[begin]:
            yield rows[begin], batch.slice(begin, end - begin)
            begin = end


def _find_leaders(threshold: float, hours: int, dims: int):
    """Rows come by slice in order of time, those of the slice before it first; gives the slice's own rows with their leaders."""

    def told(found: _Leaders, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ends, places = _lists(part.column("idx"))
        seeds = part.column("seed").to_numpy(zero_copy_only=False).astype(bool)
        return found.add(part.column("time").to_numpy(), np.diff(ends), places, _lists(part.column("weight"))[1], seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found, held, before = None, None, [], []
        for batch in batches:
            for key, part in _parts(batch, ["language", "run", "slice", "own"]):
                if key[:3] != at:
                    at, found, held = key[:3], None, []
                if not key[3]:
                    held.append(part)  # a window; without rows that follow there is nothing to find
                    continue
                first = found is None
                if first:
                    found = _Leaders(threshold, hours, dims)
                    guessed = [told(found, x)[0] for x in held]
                    before, held = np.flatnonzero(np.concatenate(guessed)) if guessed else np.arange(0), []
                lead, sizes, ranks = told(found, part)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                old = np.full(part.num_rows + 1, len(before) if first else 0)
                old[0] = 0
                more = {"lead": pa.array(lead), "near": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ranks, pa.int32())), "before": pa.ListArray.from_arrays(pa.array(old, pa.int32()), pa.array(before if first else [], pa.int32()))}
                columns = {c: part.column(c) for c in part.schema.names if c != "own"} | more
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


class _Run:
    """One language's run of articles, read in order."""

    def __init__(self, threshold: float, hours: int, dims: int):
        self.found, self.slice, self.begun = OpenStories(threshold, hours, dims), None, 0
        self.slots = np.arange(0)  # by rank: of the slice before and this one, the slot of the story that the article has seeded, or -1
        self.found.moved = self._moved

    def _moved(self, slot: np.ndarray) -> None:
        some = self.slots >= 0
        self.slots[some] = slot[self.slots[some]]

    def _open(self, number: int, before: np.ndarray) -> None:
        """A new slice; what its rows don't have as a leader of the slice before goes into the product."""
        self.slots = self.slots[self.begun :] if self.slice == number - 1 else np.arange(0)
        self.slice, self.begun = number, len(self.slots)
        other = self.slots >= 0
        other[before] = False
        for at in self.slots[other].tolist():
            self.found.heat(at)

    def place(self, number: int, part: pa.RecordBatch) -> list:
        """The stories of the next rows, all of one slice."""
        if number != self.slice:
            self._open(number, _lists(part.column("before").slice(0, 1))[1])
        (ends, places), weights, (to, near) = _lists(part.column("idx")), _lists(part.column("weight"))[1], _lists(part.column("near"))
        ids, times, seeds, lead = (part.column(c).to_pylist() for c in ("id", "time", "seed", "lead"))
        found, out = self.found, []
        for at in range(0, len(ids), BATCH):
            some = range(at, min(at + BATCH, len(ids)))
            rank = len(self.slots)
            self.slots = np.concatenate([self.slots, np.full(len(some), -1)])

            def listed(i: int, told: list) -> list:
                if i and told[-1] == ids[at + i - 1]:
                    self.slots[rank + i - 1] = len(found.names) - 1
                if to[at + i] == to[at + i + 1]:
                    return []
                slots = self.slots[near[to[at + i] : to[at + i + 1]]]
                return slots[(slots >= 0) & (found.hot[slots] < 0)].tolist()

            told = found.batch([times[i] for i in some], [places[ends[i] : ends[i + 1]] for i in some], [weights[ends[i] : ends[i + 1]] for i in some], [seeds[i] for i in some], [ids[i] for i in some], [lead[i] for i in some], listed)
            if told[-1] == ids[some[-1]]:
                self.slots[rank + len(some) - 1] = len(found.names) - 1
            out += told
        return out


def _place_articles(threshold: float, hours: int, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found = None, None
        for batch in batches:
            out = []
            for key, part in _parts(batch, ["language", "run", "slice"]):
                if key[:2] != at:
                    at, found = key[:2], _Run(threshold, hours, dims)
                out += found.place(key[2], part)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string())], ["id", "story"])

    return run


def cluster_stories(articles: DataFrame, sparse: DataFrame | None = None, threshold: float = 0.7, hours: int = 24) -> DataFrame:
    """(id, story): story is the id of its seed; articles that neither join nor seed have null (D3).

    ``articles``: id, language, published_at, role; ``sparse``: (id, idx, weight) unit vectors, none for
    a zero vector; without it ``articles``, which is read several times, has them as arrays idx and weight, null or empty
    for a zero vector. Nothing is approximated, and a run may have any size.
    """
    if sparse is not None:
        entries = sparse.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("idx", "weight"))).alias("e"))
        articles = articles.join(entries, "id", "left").select("id", "language", "published_at", "role", F.col("e.idx").alias("idx"), F.col("e.weight").alias("weight"))
        articles = materialize(articles, "vectors")
    window, kept = hours * 3_600_000_000, articles.where("role != 'skip'")
    rows = gap_runs(kept.select("id", "language", "published_at", (F.col("role") == "seed").alias("seed"), "idx", "weight"), hours)
    rows = rows.select("language", F.col("run").cast("string").alias("run"), F.unix_micros(F.col("published_at").cast("timestamp")).alias("time"), "id", "seed", "idx", "weight")
    empty = F.coalesce(F.size("idx") <= 0, F.lit(True))
    alone = rows.where(empty).select("id", F.when(F.col("seed"), F.col("id")).alias("story"))
    own = F.expr(f"(time - pmod(time, {window}L)) div {window}L")
    there = rows.where(~empty).withColumn("own", own)
    size = kept.agg(F.max(F.array_max("idx")).alias("dims"), F.count_distinct("language", F.expr(f"unix_micros(CAST(published_at AS TIMESTAMP)) div {window}L")).alias("n")).first()
    dims = (size.dims or 0) + 1
    # Each slice meets the slice before it: a window. Few slices are much work each, so they are dealt into many parts.
    dealt = there.withColumn("slice", F.explode(F.array("own", F.col("own") + 1))).withColumn("own", F.col("own") == F.col("slice"))
    dealt = dealt.repartition(max(partitions(articles.sparkSession), min(4 * size.n, 2000)), "language", "run", "slice").sortWithinPartitions("language", "run", "slice", "time", "id")
    kinds = "language string, run string, time bigint, id string, seed boolean, idx array<int>, weight array<double>, slice bigint, lead boolean, near array<int>, before array<int>"
    led = dealt.select("language", "run", "time", "id", "seed", "idx", "weight", "slice", "own").mapInArrow(_find_leaders(threshold, hours, dims), kinds)
    ordered = led.repartition(partitions(articles.sparkSession), "language", "run").sortWithinPartitions("language", "run", "time", "id")
    return ordered.mapInArrow(_place_articles(threshold, hours, dims), "id string, story string").union(alone)


def mint_ids(df: DataFrame, prefix: str, day: str, order: list[str], taken: DataFrame | None = None) -> DataFrame:
    """Adds new_id: prefix_YYYYMMDD_NNNN counted within the day from the highest number taken.

    Numbers come from counts a time slice and a running offset, so no task orders a whole day.
    """
    n = 64
    spread = df.withColumn("_d", F.date_format(day, "yyyyMMdd")).repartitionByRange(n, "_d", *order).withColumn("_p", F.spark_partition_id())
    spread = materialize(spread.sortWithinPartitions("_d", *order), "mint")
    counts = spread.groupBy("_d", "_p").count()
    offsets = counts.withColumn("_off", F.coalesce(F.sum("count").over(Window.partitionBy("_d").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    ranked = spread.withColumn("_r", F.row_number().over(Window.partitionBy("_d", "_p").orderBy(*order))).join(offsets, ["_d", "_p"])
    if taken is not None:
        top = taken.select(F.regexp_extract("id", r"_(\d{8})_(\d+)$", 1).alias("_d"), F.regexp_extract("id", r"_(\d{8})_(\d+)$", 2).cast("long").alias("_t")).groupBy("_d").agg(F.max("_t").alias("_t"))
        ranked = ranked.join(top, "_d", "left")
    else:
        ranked = ranked.withColumn("_t", F.lit(0))
    number = (F.col("_r") + F.col("_off") + F.coalesce("_t", F.lit(0))).cast("string")
    padded = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    return ranked.withColumn("new_id", F.concat(F.lit(prefix), F.lit("_"), F.col("_d"), F.lit("_"), padded)).drop("_d", "_p", "_r", "_off", "_t")


def cluster_tables(members: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(cluster_id, created_at, bands, n_articles): first publication, sorted distinct bands, size."""
    rows = members.join(articles.select(F.col("id").alias("article_id"), "source_id", "published_at"), "article_id").join(sources.select(F.col("id").alias("source_id"), "band"), "source_id", "left")
    return rows.groupBy("cluster_id").agg(F.min("published_at").alias("created_at"), F.sort_array(F.collect_set("band")).alias("bands"), F.count("*").alias("n_articles"))


def story_tables(articles: DataFrame, sources: DataFrame, stories: DataFrame, vectors: DataFrame, taken: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clusters, members, centroids) of (id, story) rows.

    Clusters are numbered within the day of their seed's publication, in order of (published_at, id); members:
    (cluster_id, article_id); centroids: (cluster_id, centroid), the mean of the members' vectors (id, vector).
    """
    seeds = stories.where("id = story").select("id").join(articles.select("id", "published_at"), "id")
    named = mint_ids(seeds, "cl", "published_at", ["published_at", "id"], taken).select(F.col("id").alias("story"), F.col("new_id").alias("cluster_id"))
    members = materialize(stories.where("story is not null").join(named, "story").select("cluster_id", F.col("id").alias("article_id")), "members")
    placed = members.join(vectors.select(F.col("id").alias("article_id"), "vector"), "article_id")
    return cluster_tables(members, articles, sources), members, centroid(placed, "cluster_id", "vector")


def run_counts(roles: DataFrame, stories: DataFrame) -> DataFrame:
    """One row: new stories, joins, skipped for length, skipped for a story neither joined nor seeded."""
    rows = roles.select("id", "role").join(stories, "id", "left")
    return rows.agg(F.count_if(F.col("story") == F.col("id")).alias("new"), F.count_if(F.col("story") != F.col("id")).alias("joins"), F.count_if(F.col("role") == "skip").alias("skipped_short"), F.count_if((F.col("role") != "skip") & F.col("story").isNull()).alias("skipped_headline"))

