"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact check.

Texts are lower-cased and cut into words of letters, digits and anything beyond ASCII. A
benchmark item is its ``GRAM``-word shingles (all its words, if fewer); a window of a
document is as many words as the item has; a document shorter than an item is one window.
Shingles are weighted: a benchmark shingle by the logarithm of how few items have it, any other as
the rarest.

Steps of a document: 1. For each size of items, windows whose shingles of any items of that size weigh
``THRESHOLD`` times the lightest of these items or more get a weighted SimHash of ``BITS`` bits (others can't be similar to an
item of that size). 2. Fingerprints within ``RADIUS`` agree in one of ``BLOCKS`` blocks up to ``RADIUS // BLOCKS`` bits
(pigeonhole): for each size and block a table holds the items by their block's value, and a window looks up every value
so near to its own. These tables alone find a window's items. 3. Pairs found that are within the radius in all bits are compared
exactly: weighted Jaccard similarity of the window's and the item's shingle multisets, kept at ``THRESHOLD`` or more.

Recall: the radius is the only inexact step; ``tests/llm`` compares with a search of all windows and finds no difference.
README states the distances measured at the threshold and how many candidates each step lets through.

The benchmark is the bounded side: it is collected and broadcast as an index of at most about
``MAX_INDEX_BYTES`` (``INDEX_FACTOR`` bytes for a byte of text, checked first); a larger one is processed
in several passes over parts of the items, with the same results.

Nulls: null and empty texts have no words and match nothing, as items or documents; null ids
stay null; further columns of the documents are ignored by contaminated() and kept by without_items(). Several rows with one doc_id each give rows; equal items all match. Empty tables give no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsline.llm.common import bounded_batches, firsts_with, mix, rolling, slices, text_of, word_hashes, words
from newsline.plans.storage import table

GRAM = 5
THRESHOLD = 0.8
BITS = 256
BLOCKS = BITS // 16
RADIUS = 63
STRETCH = 8192
MAX_INDEX_BYTES = 256 << 20
INDEX_FACTOR = 20

_SEPARATES = np.ones(256, bool)
_SEPARATES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_ONES = np.bitwise_count(np.arange(1 << 16, dtype=np.uint16))
_SEEDS = mix(np.arange(1, BITS // 64 + 1, dtype=np.uint64))


def _signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle."""
    bits = np.unpackbits(mix(hashes[:, None] ^ _SEEDS).view(np.uint8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints as ``BLOCKS`` numbers of 16 bits a row."""
    return np.packbits(sums > 0, axis=1).view(np.uint16)


class Tables:
    """Items of one size by the values of their fingerprints' blocks."""

    def __init__(self, items: np.ndarray, prints: np.ndarray) -> None:
        self.items, self.prints = items, prints
        self.order = np.argsort(prints, axis=0, kind="stable")
        self.values = np.take_along_axis(prints, self.order, axis=0)

    def find(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(fingerprint number, item) of every pair within the radius, and how many pairs the tables gave before all bits were compared."""
        masks = np.flatnonzero(_ONES <= radius // BLOCKS).astype(np.uint16)
        rows, items, met = [], [], 0
        for first in range(0, len(prints), 256):
            own, pairs = prints[first : first + 256], []
            for b in range(BLOCKS):
                there = np.zeros(1 << 16, bool)
                there[self.values[:, b]] = True
                keys = own[:, b, None] ^ masks
                row, mask = np.nonzero(there[keys])
                low, high = (np.searchsorted(self.values[:, b], keys[row, mask], side) for side in ("left", "right"))
                many = high - low
                inside = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                pairs.append(np.repeat(row, many) * len(self.items) + self.order[np.repeat(low, many) + inside, b])
            row, item = np.divmod(np.unique(np.concatenate(pairs)), len(self.items))
            near = np.bitwise_count(own[row] ^ self.prints[item]).sum(axis=1) <= radius
            met += len(row)
            rows.append(row[near] + first)
            items.append(self.items[item[near]])
        return np.concatenate(rows), np.concatenate(items), met


class Items:
    """The benchmark: shingles, weights, fingerprints and block tables."""

    def __init__(self, ids: list, texts: list[str], gram: int = GRAM, radius: int = RADIUS, counts: tuple | None = None, threshold: float = THRESHOLD) -> None:
        """``counts``: (shingles, how many items have each, number of items) of the whole benchmark, if this is a part of it."""
        self.gram, self.radius, self.threshold = gram, radius, threshold
        self.steps = dict.fromkeys(("windows", "fingerprints", "pairs_of_a_size", "pairs_from_tables", "pairs_within_radius", "matches"), 0)
        lowered = pa.array([(x or "").lower() for x in texts], pa.large_string())
        self.ids, self.sizes, self.shingles = [], [], []
        for row, data, offsets in slices(lowered):
            starts, ends, bounds = words(data, offsets, _SEPARATES)
            hashes = word_hashes(data, starts, ends)
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                if b > a:
                    self.ids.append(ids[row + i])
                    self.sizes.append(int(b - a))
                    self.shingles.append(np.sort(rolling(hashes[a:b], min(gram, int(b - a)))))
        self.known, have = np.unique(np.concatenate([np.unique(x) for x in self.shingles] or [np.zeros(0, np.uint64)]), return_counts=True)
        self.counts = (self.known, have, len(self.ids))
        every, times, total = counts or self.counts
        self.weights = 1 + np.log(max(total, 1) / np.maximum(times[np.searchsorted(every, self.known)], 1)) if len(self.known) else np.zeros(0)
        self.rare = 1 + np.log(max(total, 1))
        self.prints = self.fingerprints(self.shingles)
        mass = np.array([self.weigh(x).sum() for x in self.shingles])
        sizes = np.array(self.sizes, np.int64)
        self.tables = {n: Tables(np.flatnonzero(sizes == n), self.prints[sizes == n]) for n in np.unique(sizes).tolist()}
        self.least = {n: float(mass[t.items].min()) * threshold - 1e-9 for n, t in self.tables.items()}
        self.own = {n: np.searchsorted(self.known, np.unique(np.concatenate([self.shingles[i] for i in t.items]))) for n, t in self.tables.items()}

    def fingerprints(self, windows: list[np.ndarray]) -> np.ndarray:
        """The weighted SimHash of each run of shingles."""
        return np.concatenate([_packed((self.units(x)[:, None] * _signs(x)).sum(0)[None]) for x in windows] or [np.zeros((0, BLOCKS), np.uint16)])

    def units(self, hashes: np.ndarray) -> np.ndarray:
        """Weights as whole numbers, so that sums don't depend on their order."""
        return np.rint(self.weigh(hashes) * 256).astype(np.int32)

    def weigh(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        return np.where(self.known[at] == hashes, self.weights[at], self.rare) if len(self.known) else np.full(len(hashes), self.rare)

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of shingle multisets."""
        a, n = np.unique(window, return_counts=True)
        b, m = np.unique(self.shingles[item], return_counts=True)
        both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        shared = (self.weigh(both) * np.minimum(n[i], m[j])).sum()
        union = (self.weigh(a) * n).sum() + (self.weigh(b) * m).sum() - shared
        return float(shared / union) if union else 0.0

    def search(self, hashes: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, end word) of the best window, leftmost on ties, for each item at the threshold."""
        best: dict[int, tuple[float, int, int]] = {}
        for k in sorted({min(self.gram, n) for n in self.tables}):
            grams = rolling(hashes, k)
            if not len(grams):
                continue
            at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
            hits = np.flatnonzero(self.known[at] == grams)
            worth = []  # (size, shingles a window, first shingles of windows)
            for size in self.tables:
                if min(self.gram, size) == k:
                    inner = min(size - k + 1, len(grams))
                    worth.append((size, inner, self.worth(size, inner, at[hits], hits, len(grams))))
            for size, begin, item in self.meet(grams, worth):
                end = begin + min(size - k + 1, len(grams))
                like = self.similarity(grams[begin:end], item)
                if like >= self.threshold and like > best.get(item, (0.0,))[0]:
                    best[item] = (like, begin, end + k - 1)
        self.steps["matches"] += len(best)
        return [(i, *best[i]) for i in sorted(best)]

    def worth(self, size: int, inner: int, known: np.ndarray, hits: np.ndarray, n: int) -> np.ndarray:
        """Windows of ``inner`` of ``n`` shingles that hold weight enough of items of a size; shingles ``hits`` have the numbers ``known``."""
        own = self.own[size]
        here = own[np.minimum(np.searchsorted(own, known), len(own) - 1)] == known
        weights = self.weights[known[here]]
        if weights.sum() < self.least[size]:
            return np.zeros(0, np.int64)
        shared = np.zeros(n + 1)
        shared[hits[here] + 1] = weights
        shared = np.cumsum(shared)
        begins = np.flatnonzero(shared[inner:] - shared[: n + 1 - inner] >= self.least[size])
        self.steps["windows"] += n - inner + 1
        self.steps["fingerprints"] += len(begins)
        self.steps["pairs_of_a_size"] += len(begins) * len(self.tables[size].items)
        return begins

    def meet(self, grams: np.ndarray, worth: list[tuple[int, int, np.ndarray]]) -> Iterator[tuple[int, int, int]]:
        """(size, first shingle of a window, item) of every pair within the radius, windows of a size in order.

        Signed weights are summed once along each stretch of ``STRETCH`` first shingles, so a window's sum is a difference.
        """
        for low in range(0, len(grams), STRETCH):
            parts = [(n, inner, x[np.searchsorted(x, low) : np.searchsorted(x, low + STRETCH)] - low) for n, inner, x in worth]
            parts = [(n, inner, x) for n, inner, x in parts if len(x)]
            if not parts:
                continue
            own = grams[low : low + STRETCH + max(inner for _, inner, _ in parts)]
            used = np.zeros(len(own) + 1, np.int64)
            for _, inner, x in parts:
                used[x] += 1
                np.subtract.at(used, x + inner, 1)
            used = np.cumsum(used[:-1]) > 0
            sums = np.zeros((int(used.sum()) + 1, BITS), np.int32)
            np.cumsum(self.units(own[used])[:, None] * _signs(own[used]), axis=0, out=sums[1:])
            place = np.append(0, np.cumsum(used))
            for n, inner, x in parts:
                for some in np.array_split(x, len(x) // 1024 + 1):
                    if not len(some):
                        continue
                    first = place[some]
                    rows, items, met = self.tables[n].find(_packed(sums[first + inner] - sums[first]), self.radius)
                    self.steps["pairs_from_tables"] += met
                    self.steps["pairs_within_radius"] += len(rows)
                    for begin, item in zip(some[rows].tolist(), items.tolist()):
                        yield n, begin + low, item


def _matches(items: Items, texts: pa.Array) -> Iterator[tuple[int, tuple[int, float, int, int]]]:
    """(row, match) for every item that a text holds."""
    kinds = sorted({min(items.gram, x) for x in items.sizes})
    lowered = pa.array([(x or "").lower() for x in texts.to_pylist()], pa.large_string())
    for row, data, offsets in slices(lowered):
        starts, ends, bounds = words(data, offsets, _SEPARATES)
        hashes = word_hashes(data, starts, ends)
        touched = np.zeros(len(offsets) - 1, bool)
        for k in kinds:
            grams = rolling(hashes, k)
            if len(grams):
                at = np.minimum(np.searchsorted(items.known, grams), len(items.known) - 1)
                touched[text_of(bounds)[np.flatnonzero((items.known[at] == grams) & firsts_with(bounds, k, len(hashes)))]] = True
        for d in np.flatnonzero(touched).tolist():
            for match in items.search(hashes[bounds[d] : bounds[d + 1]]):
                yield row + d, match


def _search(packed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = pickle.loads(packed.value)
        for batch in batches:
            rows = [(row, *match) for row, match in _matches(items, batch.column("text"))]
            if rows:
                where, item, like, begin, end = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(where)), pa.array([items.ids[i] for i in item], pa.int64()), pa.array(like, pa.float64()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())],
                    ["doc_id", "item_id", "similarity", "first_word", "end_word"],
                )

    return run


def _packs(benchmark: DataFrame, most: int, threshold: float) -> list:
    """The benchmark's items as broadcast indexes of about ``most`` bytes each."""
    bounded_batches(benchmark.sparkSession)
    items = benchmark.select("item_id", "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    passes = max(1, -(-(INDEX_FACTOR * size[0] + 512 * size[1]) // most))

    def part(i: int) -> tuple[list, list]:
        rows = (items.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == i) if passes > 1 else items).collect()
        return [r[0] for r in rows], [r[1] for r in rows]

    counts = None
    if passes > 1:  # weights are those of the whole benchmark, so passes don't change results
        parts = [Items(*part(i)).counts for i in range(passes)]
        every, where = np.unique(np.concatenate([c[0] for c in parts]), return_inverse=True)
        counts = every, np.bincount(where, np.concatenate([c[1] for c in parts]), len(every)), sum(c[2] for c in parts)
    return [benchmark.sparkSession.sparkContext.broadcast(pickle.dumps(Items(*part(i), counts=counts, threshold=threshold))) for i in range(passes)]


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, end_word): every item that a document holds, with its best window."""
    out = None
    for packed in _packs(benchmark, max_index_bytes, threshold):
        found = docs.select("doc_id", "text").mapInArrow(_search(packed), "doc_id long, item_id long, similarity double, first_word long, end_word long")
        out = found if out is None else out.union(found)
    return out


def without_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no item, unchanged; nothing is shuffled."""
    at = docs.columns.index("text")

    def run(packed):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items: Items = pickle.loads(packed.value)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[row for row, _ in _matches(items, batch.column(at))]] = False
                yield batch.filter(pa.array(clean))

        return keep

    for packed in _packs(benchmark, max_index_bytes, threshold):
        docs = docs.mapInArrow(run(packed), docs.schema)
    return docs


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark items, with the items and their places."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
