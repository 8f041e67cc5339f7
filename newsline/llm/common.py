"""Word and shingle hashes over whole Arrow batches, shared by the text operators.

Words are runs of anything but U+0020 and U+0009 to U+000D. A batch of texts is one run of
UTF-8 bytes; hashes are computed with numpy over slices of whole texts, so a task holds
about a slice at a time however long the table is.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SLICE_BYTES = 1 << 20
ARROW_BYTES = "8m"
_ODD = 0x9E3779B97F4A7C15


def bounded_batches(spark: SparkSession) -> None:
    """Let Spark hand texts to Python by bytes: ten thousand long texts at once could fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def free_name(df, name: str) -> str:
    """``name``, with underscores until the table has no such column."""
    while name in df.columns:
        name += "_"
    return name


def released(run):
    """``run`` over batches, giving freed memory back to the system when the task ends: workers live on and serve other operators."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # the C library may have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def _table(seed: int, n: int = 256) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTES = {seed: _table(seed) for seed in (1, 2)}
_powers: dict[int, np.ndarray] = {}


def powers(seed: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(seed)
    if have is None or len(have) < n:
        base = int(_table(seed + 100, 1)[0])
        have = np.full(max(64, n, 2 * (0 if have is None else len(have))), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[seed] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts of about ``limit`` bytes; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and the end): words never cross texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    is_word = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1] | edge[1:-1]
    finishes = is_word.copy()
    finishes[:-1] &= ~is_word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    inside = np.arange(total) - np.repeat(first, lengths)
    parts = _BYTES[seed][data[np.repeat(starts, lengths) + inside]] * powers(seed, int(lengths.max()))[inside]
    return mix(np.add.reduceat(parts, first) + lengths.astype(np.uint64) * np.uint64(_ODD))


def rolling(hashes: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """Hash of hashes[i : i + k] for every i with k values left, by doubling."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, have, width, out, done = powers(seed, k + 1), hashes, 1, None, 0
    while True:
        if k & width:
            part = have[done : done + n]
            out = part.copy() if out is None else out + part * power[done]
            done += width
        if done == k:
            return mix(out)
        have = have[: len(have) - width] + have[width:] * power[width]
        width *= 2


def firsts_with(bounds: np.ndarray, k: int, total: int) -> np.ndarray:
    """Whether a run of k words that starts at word i stays in its text, for i up to total - k."""
    n = total - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    counts = np.diff(bounds)
    end = np.repeat(bounds[1:], counts)
    return np.arange(n) + k <= end[:n]


def text_of(bounds: np.ndarray) -> np.ndarray:
    """The text number of each word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def lists(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array of ``counts`` values each."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def lowest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row that the links (i, j) reach."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low
