"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of tokens. Each adjacent pair that the vocabulary can merge
sits in the bucket of its merge rank; a 64-ary bitmap over the ranks (three levels for 50
thousand) finds the lowest non-empty bucket by find-first-set, and its places are merged
from the left. Places whose pair has changed meanwhile are stale and skipped.
A merge costs a few word operations however long the pre-token is, so a pre-token of a
million bytes takes about n log n steps where a rescan takes n squared.

Each task keeps two bounded caches (words with the space before them, and pre-tokens) of two
generations; a full one becomes the older, which the one before it leaves, so memory doesn't grow with the corpus and results don't depend on it.

Nulls are encoded as empty texts; empty texts have no tokens. Rows with the same text, null
ids and extra columns are fine: nothing is grouped. Decoding gives back the exact bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType

from newsline.llm.common import bounded_batches, released
from newsline.plans.storage import table

CACHE_ENTRIES = 250_000
CACHED_CHARS = 64
GROUP_CHARS = 1_500_000


class RankQueue:
    """Buckets of places by rank; a 64-ary bitmap finds the lowest rank that has any."""

    def __init__(self, size: int) -> None:
        self.levels = []
        while True:
            size = (size + 63) // 64
            self.levels.append([0] * size)
            if size == 1:
                break
        self.buckets: dict[int, list[int]] = {}

    def bucket(self, rank: int) -> list[int]:
        """The rank's bucket, made and marked in the bitmap if new."""
        found = self.buckets.get(rank)
        if found is None:
            found = self.buckets[rank] = []
            for level in self.levels:
                word, bit = rank >> 6, 1 << (rank & 63)
                had = level[word]
                level[word] = had | bit
                if had:
                    break
                rank = word
        return found

    def take(self) -> tuple[int, list[int]] | None:
        """Remove the lowest rank with its bucket."""
        if not self.buckets:
            return None
        rank = 0
        for level in reversed(self.levels):
            bits = level[rank]
            rank = (rank << 6) | ((bits & -bits).bit_length() - 1)
        at = rank
        for level in self.levels:
            word = at >> 6
            level[word] &= ~(1 << (at & 63))
            if level[word]:
                break
            at = word
        return rank, self.buckets.pop(rank)


def _refresh(wanted: set[str], young: dict[str, bytes], old: dict[str, bytes]) -> set[str]:
    """Move what the older cache has into the younger; the rest is returned."""
    known = wanted & old.keys()
    young.update((x, old[x]) for x in known)
    return wanted - known


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.token = [b""] * self.size
        for token, rank in ranks.items():
            self.token[rank] = token
        self.token_bytes, self.token_size = np.frombuffer(b"".join(self.token), np.uint8), np.array([len(x) for x in self.token])
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.two = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int64)
        self.pairs: dict[int, int] = {}
        self.queue = RankQueue(self.size)
        self.find = regex.compile(pattern).findall
        self.space = frozenset(regex.findall(r"\s", "".join(map(chr, range(0xD800)))))
        self.glued = regex.compile(r" (?:\s|$)").search
        self.words, self.older_words = {}, {}
        self.pieces, self.older_pieces = {}, {}

    def _pair(self, key: int) -> int:
        """The merge rank of a pair of ids, -1 if it has none."""
        rank = self.ranks.get(self.token[key // self.size] + self.token[key % self.size], -1)
        if len(self.pairs) >= 2 * CACHE_ENTRIES:
            self.pairs.clear()
        self.pairs[key] = rank
        return rank

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each non-empty pre-token. One queue serves them all: their lists don't touch, so each is merged as if alone."""
        if not pieces:
            return []
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n, ends = len(data), np.cumsum([len(x) for x in pieces])
        ranks = np.full(n, -1)
        ranks[:-1] = self.two[data[:-1], data[1:]]
        ranks[ends - 1] = -1
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[np.append(0, ends[:-1])] = -1
        places = np.flatnonzero(ranks >= 0)
        places = places[np.argsort(ranks[places], kind="stable")]
        queue, pairs, pair, size = self.queue, self.pairs, self._pair, self.size
        cuts = np.flatnonzero(np.diff(ranks[places])) + 1
        for group in np.split(places, cuts) if len(places) else []:
            queue.bucket(int(ranks[group[0]])).extend(group.tolist())
        ids, rank, after, before = self.byte[data].tolist(), ranks.tolist(), after.tolist(), before.tolist()
        bucket, buckets = queue.bucket, queue.buckets
        while (top := queue.take()) is not None:
            r, todo = top
            todo.sort()
            more: list[int] = []  # places that get this very rank meanwhile
            todo.reverse()
            while todo or more:
                i = heapq.heappop(more) if more and (not todo or more[0] < todo[-1]) else todo.pop()
                if rank[i] != r:
                    continue
                j = after[i]
                k = after[j]
                h = before[i]
                ids[i], ids[j], rank[j], after[i] = r, -1, -1, k
                if k >= 0:
                    before[k] = i
                    key = r * size + ids[k]
                    new = pairs.get(key)
                    if new is None:
                        new = pair(key)
                    rank[i] = new
                    if new == r:
                        heapq.heappush(more, i)
                    elif new >= 0:
                        (buckets.get(new) or bucket(new)).append(i)
                else:
                    rank[i] = -1
                if h >= 0:
                    key = ids[h] * size + r
                    new = pairs.get(key)
                    if new is None:
                        new = pair(key)
                    rank[h] = new
                    if new == r:
                        heapq.heappush(more, h)
                    elif new >= 0:
                        (buckets.get(new) or bucket(new)).append(h)
        got = np.array(ids)
        live = got >= 0
        out = got[live].astype("<u4").tobytes()
        upto = (4 * np.cumsum(live)[ends - 1]).tolist()
        return [out[a:b] for a, b in zip([0, *upto[:-1]], upto)]

    def _parts(self, text: str) -> list[str]:
        """The text cut before each space that a non-space follows; those spaces are left out.

        Such a space always begins a pre-token, so the parts can be encoded apart.
        """
        parts = text.split(" ")
        if self.glued(text):
            joined = [parts[0]]
            for p in parts[1:]:
                if p and p[0] not in self.space:
                    joined.append(p)
                else:
                    joined[-1] += " " + p
            parts = joined
        return parts

    def _found(self, parts: list[str] | set[str]) -> dict[str, list[str]]:
        """The pre-tokens of each part behind a space; all are found in one pass, as such a space begins one."""
        found, out = iter(self.find(" " + " ".join(parts)) if parts else ()), {}
        for p in parts:
            own, left = [], len(p) + 1
            while left:
                piece = next(found)
                own.append(piece)
                left -= len(piece)
            out[p] = own
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self._parts(x) for x in texts]
        heads = [x.pop(0) for x in cut]
        if len(self.words) > CACHE_ENTRIES:
            self.words, self.older_words = {}, self.words
        if len(self.pieces) > CACHE_ENTRIES:
            self.pieces, self.older_pieces = {}, self.pieces
        words, pieces = self.words, self.pieces
        new = _refresh(set().union(*cut).difference(words), words, self.older_words)
        chunks = self._found(new)
        starts = {p: self.find(p) for p in set(heads)}
        unknown = list(_refresh(set().union(*chunks.values(), *starts.values()).difference(pieces), pieces, self.older_pieces))
        split = []
        for x, data in [(x, x.encode("utf-8", "surrogatepass")) for x in unknown]:
            whole = self.ranks.get(data)
            if whole is None:
                split.append((x, data))
            else:
                pieces[x] = whole.to_bytes(4, "little")
        pieces.update(zip([x for x, _ in split], self.merge([data for _, data in split])))
        words.update((p, b"".join([pieces[x] for x in found])) for p, found in chunks.items())
        out = [b"".join([*[pieces[x] for x in starts[head]], *map(words.__getitem__, rest)]) for head, rest in zip(heads, cut)]
        for p in new:
            if len(p) > CACHED_CHARS:
                del words[p]
        for x in unknown:
            if len(x) > CACHED_CHARS:
                del pieces[x]
        return out

    def encode(self, text: str) -> bytes:
        """Ids of one text."""
        return self.encode_all([text])[0]

    def shrink(self) -> None:
        """Forget the older generations, so a worker that serves other operators next holds less."""
        self.older_words, self.older_pieces = {}, {}

    def decode_all(self, texts: list[bytes]) -> list[bytes]:
        """The bytes of the ids of each text; all tokens' bytes lie in one array and are gathered, some at a time."""
        ids = np.frombuffer(b"".join(texts), "<u4")
        size = self.token_size[ids]
        parts = []
        for at in range(0, len(ids), 200_000):
            own, n = ids[at : at + 200_000], size[at : at + 200_000]
            first = np.cumsum(n) - n
            parts.append(self.token_bytes[np.repeat(self.token_start[own] - first, n) + np.arange(int(n.sum()))].tobytes())
        data, upto = b"".join(parts), np.append(0, np.cumsum(size))[np.cumsum([0, *(len(x) // 4 for x in texts)])].tolist()
        return [data[a:b] for a, b in zip(upto[:-1], upto[1:])]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the ids of one text."""
        return self.decode_all([ids])[0]


def _encoded(own: Codec, texts: pa.Array) -> Iterator[list[bytes]]:
    """Ids of each text, in groups of some megabytes of whole texts."""
    at, todo = 0, []
    for x in texts:
        todo.append(x.as_py() or "")
        at += len(todo[-1])
        if at >= GROUP_CHARS:
            yield own.encode_all(todo)
            at, todo = 0, []
    yield own.encode_all(todo)


_codecs: dict[tuple[str, str], Codec] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token, a space, its rank; any file system that pyarrow knows."""
    store, at = pa.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    with store.open_input_stream(at) as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines()) if a}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a rank file, read once."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ids array<int> and n_tokens long; a column of these names in ``df`` is an error."""
    if clash := {"ids", "n_tokens"} & {*df.columns}:
        raise ValueError(f"df has columns {sorted(clash)} already")
    bounded_batches(df.sparkSession)
    kept = df.columns
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            found = [x for group in _encoded(own, batch.column(at)) for x in group]
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(x) // 4 for x in found]]), pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, pa.array([len(x) // 4 for x in found], pa.int64())], [*kept, "ids", "n_tokens"])
        own.shrink()

    schema = df.select(kept).schema.add("ids", ArrayType(IntegerType())).add("n_tokens", "long")
    return df.select(kept).mapInArrow(released(run), schema)


def round_trip(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, decodes what it encoded, and digests both."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            n, ids, back = [], [], []
            for group in _encoded(own, batch.column("text")):
                n += [len(x) // 4 for x in group]
                ids += [hashlib.sha256(x).hexdigest() for x in group]
                back += [hashlib.sha256(x).hexdigest() for x in own.decode_all(group)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        own.shrink()

    return df.select("doc_id", "text").mapInArrow(released(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def public_vocabulary() -> tuple[str, str]:
    """(rank file, pattern) of the multilingual public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    return round_trip(table(spark, sf_dir, "documents"), *public_vocabulary())
