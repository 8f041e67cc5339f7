"""Similarity join of word-shingle sets with token-combination prefixes.

Tokens have one global order: rare ones before frequent ones, by hash within each. Two
sets of Jaccard similarity t or more share at least two tokens of their prefixes of
``n - ceil(t n) + 2`` tokens. So each set is indexed under every rare token of its prefix and,
for the frequent class, under every pair of frequent tokens of its prefix; sets of
``WIDE`` tokens or more, which would have very many pairs, go under single frequent tokens too
(sets small enough to match a narrower one go under both), so no partner is missed.

Frequent is a table of at most ``MAX_FREQUENT`` tokens, with counts over all documents: what
repeats in a run of texts counts exactly, the rest by a sample of one in ``SAMPLED``. It only
orders tokens, results don't depend on it.

A set's sketch is how many of its tokens fall into each of about n / 6 cells of the hash
space. Two sets share at most the sum of their cells' smaller counts, so the sketch, a fiftieth
of the set, rejects nearly all sets that only share a passage. Buckets of up to ``SMALL`` sets
give pairs, which must share as many prefix tokens as their sizes demand; a larger one is cut
into classes of sizes, of which only neighbours can link, and into tiles of ``TILE`` sets, and each two
tiles return a spanning forest of the pairs that their sketches let through. The
candidates' connected groups are then verified whole: sets go in blocks of
``BLOCK_TOKENS``, every two blocks of a group meet in one task, intersections are counted exactly by a
matrix product, and each task returns a spanning forest of its links, not its pairs.
Documents with equal sets are one class from the start and stand for their smallest doc_id.

Nulls and texts without words have empty sets and link with nothing; rows with null doc_id
get the component of their class; repeated rows are copies; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsline.llm.common import bounded_batches, firsts_with, lists, lowest, mix, released, rolling, slices, text_of, word_hashes, words
from newsline.llm.membership import keep_wanted
from newsline.plans.components import connected_components
from newsline.plans.storage import materialize, partitions, table

FREQUENT_FROM = 160
SAMPLED = 32
MAX_FREQUENT = 1 << 20
SMALL = 32
WIDE = 64
TILE = 1024
BLOCK_TOKENS = 1_000_000  # a block of sets in one task; small sets count as SET_COST
SET_COST = 1000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text numbers, token hashes), distinct in each text and sorted; fewer than k words are one token."""
    data = _LOWER[data]
    starts, ends, bounds = words(data, offsets)
    hashes, owner = word_hashes(data, starts, ends), text_of(bounds)
    at = np.flatnonzero(firsts_with(bounds, k, len(hashes)))
    docs, tokens = [owner[at]], [rolling(hashes, k)[at]]
    counts = np.diff(bounds)
    for j in range(1, k):
        short = np.flatnonzero(counts == j)
        if len(short):
            docs.append(short)
            tokens.append(rolling(hashes, j, 10 + j)[bounds[short]])
    doc, token = np.concatenate(docs), np.concatenate(tokens)
    order = np.lexsort((token, doc))
    doc, token = doc[order], token[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])
    return doc[new], token[new]


def _token_counts(k: int, sampled: int):
    """(token, n) of the tokens that several documents of a run of slices have, and of a sample of the others, weighted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held or [np.zeros(0, np.uint64)]), return_counts=True)
            held.clear()
            picked = mix(token ^ mix(token[:1] + np.uint64(len(token)))) % np.uint64(sampled) == 0  # another sample in every run
            weight = np.where(n > 1, n, sampled)
            keep = (n > 1) | picked
            return pa.RecordBatch.from_arrays([pa.array(token[keep].view(np.int64)), pa.array(weight[keep].astype(np.int64))], ["token", "n"])

        for batch in batches:
            for _, data, offsets in slices(batch.column("text")):
                held.append(shingle_sets(data, offsets, k)[1])
                size += len(held[-1])
                if size > 1_000_000:
                    yield flush()
                    size = 0
        yield flush()

    return run


def frequent_tokens(docs: DataFrame, k: int, least: int = FREQUENT_FROM, most: int = MAX_FREQUENT) -> np.ndarray:
    """The tokens counted ``least`` times or more, doubled until at most ``most`` remain."""
    counts = docs.select("text").mapInArrow(released(_token_counts(k, SAMPLED)), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    counts = materialize(counts, "frequent")
    levels = {r[0]: r[1] for r in counts.groupBy(F.floor(F.log2("n")).alias("l")).count().collect()}
    while sum(v for level, v in levels.items() if level >= int(np.log2(least))) > most:
        least *= 2
    return np.sort(counts.where(F.col("n") >= least).select("token").toPandas().token.to_numpy(np.int64).view(np.uint64))


def smallest(percent: int) -> int:
    """Below this many tokens, sets that link are equal."""
    return -(-percent // (100 - percent))


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(n, n - (percent * n + 99) // 100 + 2)


def sketch_cells(n: np.ndarray) -> np.ndarray:
    """The number of a sketch's cells as a power of two: 4 to 8 tokens a cell, 16 cells at least."""
    return np.maximum(4, np.floor(np.log2(np.maximum(n, 1))).astype(np.int64) - 2)


def _sketches(doc: np.ndarray, token: np.ndarray, n: np.ndarray) -> pa.Array:
    """The sketch of each text as bytes; 255 stands for that many or more."""
    power = sketch_cells(n)
    cells = np.where(n > 0, 1 << power, 0)
    at = np.append(0, np.cumsum(cells))
    counts = np.bincount(at[doc] + (token >> (64 - power[doc]).astype(np.uint64)).astype(np.int64), minlength=at[-1])
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(np.minimum(counts, 255).astype(np.uint8).tobytes())])


def unfolded(sketches: list[bytes], cells: int) -> np.ndarray:
    """Sketches as rows of ``cells`` counts, neighbouring cells added up where there are more."""
    out = np.zeros((len(sketches), cells), np.int32)
    for i, x in enumerate(sketches):
        own = np.frombuffer(x, np.uint8).astype(np.int32)
        own[own == 255] = 1 << 24
        out[i] = own.reshape(cells, -1).sum(1)
    return out


def most_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bounds of the intersections of all sketches in a with all in b: sums of the smaller counts, level by level."""
    out = np.zeros((len(a), len(b)), np.float32)
    level = 1
    while True:
        some = np.flatnonzero((a >= level).any(0) & (b >= level).any(0))
        if not len(some):
            return out
        # From level 64 on one step stands for all that may follow: a bound need not be tight there.
        step = 1 if level < 64 else 1 << 24
        out += step * ((a[:, some] >= level).astype(np.float32) @ (b[:, some] >= level).astype(np.float32).T)
        level += step


def _signatures(k: int, percent: int, packed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.frombuffer(packed.value, np.uint64)
        for batch in batches:
            ids = batch.column("doc_id")
            for row, data, offsets in slices(batch.column("text")):
                m = len(offsets) - 1
                doc, token = shingle_sets(data, offsets, k)
                n = np.bincount(doc, minlength=m)
                has = np.flatnonzero(n)
                first = np.searchsorted(doc, has)
                c1, c2 = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
                if len(has):
                    c1[has] = np.add.reduceat(mix(token), first)
                    c2[has] = np.add.reduceat(mix(token ^ np.uint64(0x5851F42D4C957F2D)), first)
                sketches = _sketches(doc, token, n)
                common = frequent[np.minimum(np.searchsorted(frequent, token), len(frequent) - 1)] == token if len(frequent) else np.zeros(len(token), bool)
                order = np.lexsort((token, common, doc))
                doc, token, common = doc[order], token[order], common[order]
                place = np.arange(len(doc)) - np.repeat(first, n[has])
                inside = (place < prefix_length(n, percent)[doc]) & (n[doc] >= smallest(percent))
                rare, often = inside & ~common, inside & common
                f = np.bincount(doc[often], minlength=m)
                owners, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for d in np.flatnonzero(f).tolist():
                    lo, hi = np.searchsorted(doc, d), np.searchsorted(doc, d, "right")
                    own = token[lo:hi][often[lo:hi]]
                    if n[d] < WIDE * 100 / percent:
                        i, j = np.triu_indices(len(own), 1)
                        keys.append(mix(own[i] * np.uint64(3) + mix(own[j])))
                        owners.append(np.full(len(i), d))
                    if n[d] >= WIDE:
                        keys.append(own)
                        owners.append(np.full(len(own), d))
                owner = np.concatenate(owners)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(row, m), pa.array(n.astype(np.int64)), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), pa.array(f.astype(np.int64)),
                        lists(token[rare].view(np.int64), np.bincount(doc[rare], minlength=m), pa.int64()), lists(np.concatenate(keys).view(np.int64), np.bincount(owner, minlength=m), pa.int64()), sketches,
                    ],
                    ["doc_id", "n", "c1", "c2", "f", "rare", "often", "sketch"],
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in slices(batch.column("text")):
                m = len(offsets) - 1
                doc, token = shingle_sets(data, offsets, k)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(row, m) for c in ("doc_id", "gid", "tiles")), lists(token.view(np.int64), np.bincount(doc, minlength=m), pa.int64())], ["doc_id", "gid", "tiles", "tokens"])

    return run


def forest(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges that span the links between these sets, found by exact intersections."""
    n = np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), n)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    again = np.append(False, flat[1:] == flat[:-1])
    shared = again | np.append(again[1:], False)
    token, owner = np.cumsum(~again[shared]) - 1, owner[shared]
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = 2048
    cuts = np.searchsorted(token, np.arange(0, (int(token[-1]) + 1 if len(token) else 0) + width, width))
    for c, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        has = np.zeros((len(sets), width), np.float32)
        has[owner[a:b], token[a:b] - c * width] = 1
        both += has @ has.T
    linked = np.zeros(both.shape, bool)
    for a in range(0, len(sets), 256):  # sizes add up in 64 bits, a few rows at a time
        part = np.rint(both[a : a + 256]).astype(np.int64)
        linked[a : a + 256] = 100 * part >= percent * (n[a : a + 256, None] + n[None, :] - part)
    np.fill_diagonal(linked, True)
    label = np.arange(len(sets), dtype=np.int32)
    while True:
        low = np.array([label[row].min() for row in linked], np.int32)
        if (low == label).all():
            break
        label = low
    return [(int(ids[a]), int(ids[b])) for a, b in enumerate(label.tolist()) if a != b]


def _links(percent: int):
    """Rows sorted by tile: the links of each tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

        def close() -> pa.RecordBatch:
            edges = forest(np.array(ids), sets, percent) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], schema=schema)

        for batch in batches:
            tokens = batch.column("tokens")
            flat, at = tokens.flatten().to_numpy(), np.append(0, np.cumsum(np.diff(tokens.offsets.to_numpy())))
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("gid", "i", "j"))))
            for r, (own, doc) in enumerate(zip(keys, batch.column("doc_id").to_pylist())):
                if own != key:
                    if key is not None:
                        yield close()
                    key, ids, sets = own, [], []
                ids.append(doc)
                sets.append(flat[at[r] : at[r + 1]].copy())
        if key is not None:
            yield close()

    return run


def _need(a: str, b: str, percent: int) -> Column:
    """How many prefix tokens two linked sets of sizes a and b share at least."""
    alpha = F.ceil((F.col(a) + F.col(b)) * percent / (100 + percent) - 1e-9)
    prefix = lambda n: F.least(F.col(n), F.col(n) - F.ceil(F.col(n) * percent / 100 - 1e-9) + 2)
    return F.least(prefix(a) - F.col(a) + alpha, prefix(b) - F.col(b) + alpha)


def _enough(shared: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    shared = np.rint(shared).astype(np.int64)
    return 100 * shared >= percent * (na + nb - shared)


def _let_through(percent: int):
    """The rows (u, v, nu, nv, su, sv) whose sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nu, nv = (batch.column(c).to_numpy() for c in ("nu", "nv"))
            shared = np.zeros(batch.num_rows)
            for i, (a, b) in enumerate(zip(batch.column("su").to_pylist(), batch.column("sv").to_pylist())):
                x, y = (unfolded([s], min(len(a), len(b)))[0] for s in (a, b))
                shared[i] = np.minimum(np.minimum(x, y).sum(), min(nu[i], nv[i]))
            yield batch.select(["u", "v"]).filter(pa.array(_enough(shared, nu, nv, percent)))

    return run


def _tile_forests(percent: int):
    """Rows sorted by tile pair, (key, s, across, i, j): edges that span the pairs that the sketches let through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> pa.RecordBatch:
            left = [r for r in held if not r[0]]
            right = [r for r in held if r[0]] if key[2] else left
            u = v = np.zeros(0, np.int64)
            if left and right and (key[2] or len(left) > 1):
                cells = min(len(r[3]) for r in (*left, *right))
                a = unfolded([r[3] for r in left], cells)
                b = unfolded([r[3] for r in right], cells) if key[2] else a
                na, nb = np.array([r[2] for r in left]), np.array([r[2] for r in right])
                shared = np.minimum(most_shared(a, b), np.minimum(na[:, None], nb[None, :]))
                i, j = np.nonzero(_enough(shared, na[:, None], nb[None, :], percent))
                both = left + right if key[2] else left
                low = lowest(len(both), i, j + len(left) if key[2] else j)
                far = np.flatnonzero(low != np.arange(len(both)))
                ids = np.array([r[1] for r in both])
                u, v = ids[far], ids[low[far]]
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("key", "s", "across", "i", "j")))
            for own, *row in zip(keys, *(batch.column(c).to_pylist() for c in ("right", "doc_id", "n", "sketch"))):
                if own != key:
                    if key is not None:
                        yield close()
                    key, held = own, []
                held.append(row)
        if key is not None:
            yield close()

    return run


def _size_class(n: str, percent: int) -> Column:
    """Sizes that may link are at most a factor of 100 / percent apart, so in the same or neighbouring classes."""
    return F.floor(F.log(F.col(n)) / (math.log(100 / percent) * (1 + 1e-9))).cast("int")


def _large_buckets(rows: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) of the buckets in (key, doc_id, n): classes of sizes meet themselves and the next one, tile by tile."""
    rows = rows.select("key", "doc_id", "n", _size_class("n", percent).alias("s"))
    counts = rows.groupBy("key", "s").agg(F.count("*").alias("m"))
    sized = counts.select("key", "s", "m", F.ceil(F.col("m") / TILE).cast("int").alias("r"))
    beside = lambda d, name: sized.select("key", (F.col("s") + d).alias("s"), F.col("r").alias(name))
    sized = sized.join(beside(-1, "after"), ["key", "s"], "left").join(beside(1, "before"), ["key", "s"], "left").where("m > 1 or after is not null or before is not null")
    dealt = rows.join(sized, ["key", "s"]).withColumn("b", F.pmod(F.xxhash64("doc_id"), F.col("r")).cast("int"))
    tile = lambda s, across, i, j, right: F.struct(s.alias("s"), F.lit(across).alias("across"), i.alias("i"), j.alias("j"), F.lit(right).alias("right"))
    each = lambda n, f: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)).otherwise(F.array().cast("array<struct<s:int,across:boolean,i:int,j:int,right:boolean>>"))
    tiles = F.concat(
        each("r", lambda j: tile(F.col("s"), False, F.least("b", j), F.greatest("b", j), False)),
        each("after", lambda j: tile(F.col("s"), True, F.col("b"), j, False)),
        each("before", lambda i: tile(F.col("s") - 1, True, i, F.col("b"), True)),
    )
    met = dealt.select("key", "doc_id", F.explode(tiles).alias("t")).join(sketches.hint("shuffle_hash"), "doc_id").select("key", "t.*", "doc_id", "n", "sketch")
    at = ["key", "s", "across", "i", "j"]
    return met.repartition(partitions(rows.sparkSession), *at).sortWithinPartitions(*at).mapInArrow(released(_tile_forests(percent)), "u long, v long")


def _candidates(sets: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) whose connected groups hold every linked pair of the classes in ``sets``."""
    keyed = sets.select("doc_id", "n", "f", F.explode(F.concat(F.transform("rare", lambda x: F.struct(x.alias("key"), F.lit(False).alias("free"))), F.transform("often", lambda x: F.struct(x.alias("key"), F.lit(True).alias("free"))))).alias("p"))
    keyed = keyed.select("doc_id", "n", "f", "p.key", "p.free")
    buckets = materialize(keyed.groupBy("key").agg(F.count("*").alias("g")).where("g > 1"), "buckets")
    rows = materialize(keep_wanted(keyed, "key", buckets.select("key")).join(buckets, "key"), "postings")
    met = rows.where(F.col("g") <= SMALL).groupBy("key").agg(F.collect_list(F.struct("doc_id", "n", "f", "free")).alias("all"))
    fits = lambda a, b: (b.doc_id > a.doc_id) & (F.least(a.n, b.n) * 100 >= F.greatest(a.n, b.n) * percent)
    pairs = met.select(F.explode("all").alias("a"), "all").select("a", F.explode(F.filter("all", lambda b: fits(F.col("a"), b))).alias("b"))
    pairs = pairs.groupBy(F.col("a.doc_id").alias("u"), F.col("b.doc_id").alias("v")).agg(
        F.count("*").alias("c"), F.max("a.free").alias("free"), F.min("a.n").alias("na"), F.min("b.n").alias("nb"), F.min(F.least("a.f", "b.f")).alias("f")
    )
    # What two sets share in large buckets isn't in c, but the tiles of these find such pairs too.
    pairs = pairs.where(F.col("free") | (F.col("c") + F.col("f") >= _need("na", "nb", percent))).select("u", "v")
    sketches = sets.select("doc_id", "n", "sketch")
    side = lambda c: sketches.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")).hint("shuffle_hash")
    near = pairs.join(side("u"), "u").join(side("v"), "v").mapInArrow(released(_let_through(percent)), "u long, v long")
    return near.union(_large_buckets(rows.where(F.col("g") > SMALL).select("key", "doc_id", "n"), sketches, percent))


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of (doc_id, text): documents link at a Jaccard similarity of ``percent`` hundredths or more."""
    if not 67 <= percent < 100:
        raise ValueError("two shared prefix tokens are only sure from 67 hundredths on")
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("doc_id", "text")
    packed = spark.sparkContext.broadcast(frequent_tokens(docs, k).tobytes())
    marks = materialize(docs.mapInArrow(released(_signatures(k, percent, packed)), "doc_id long, n long, c1 long, c2 long, f long, rare array<long>, often array<long>, sketch binary"), "signatures")
    classes = materialize(marks.where("n > 0").groupBy("c1", "c2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    # A class may keep a few more of its documents here; they link with each other and end in the same component.
    # Written, so that no task runs two Python filters, and two pairs of workers, at once.
    columns = ("doc_id", "n", "f", "rare", "often", "sketch")
    reps = materialize(keep_wanted(marks.where(f"n >= {smallest(percent)}").select(*columns), "doc_id", classes.select("rep")), "reps")
    groups = connected_components(_candidates(reps, percent), "u", "v")
    sized = groups.join(marks.select(F.col("doc_id").alias("node"), "n").dropDuplicates(["node"]), "node")
    # A group's blocks are shares of its size classes, by a hash, so no task orders a group.
    sized = sized.select(F.col("node").alias("doc_id"), F.col("component").alias("gid"), "n", _size_class("n", percent).alias("s"))
    shares = sized.groupBy("gid", "s").agg(F.ceil(F.sum(F.greatest(F.col("n"), F.lit(SET_COST))) / BLOCK_TOKENS).cast("int").alias("r"))
    block = F.col("s").cast("long") * (1 << 32) + F.pmod(F.xxhash64("doc_id"), F.col("r"))
    members = materialize(sized.join(shares, ["gid", "s"]).select("doc_id", "gid", "n", block.alias("block")), "members")
    # Blocks are in order of size, so a block meets only those whose sizes are near enough.
    ranges = members.groupBy("gid", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    later = ranges.select("gid", F.col("block").alias("j"), F.col("lo").alias("lo2"))
    met = ranges.join(later, "gid").where(f"block <= j and 100 * hi >= {percent} * lo2").select("gid", F.col("block").alias("i"), "j")
    both = met.select("gid", F.col("i").alias("block"), "i", "j").union(met.where("i < j").select("gid", F.col("j").alias("block"), "i", "j"))
    partners = both.groupBy("gid", "block").agg(F.collect_list(F.struct("i", "j")).alias("tiles"))
    listed = materialize(members.drop("n").join(partners, ["gid", "block"]).select("doc_id", "gid", "tiles"), "partners")
    sets = keep_wanted(docs, "doc_id", listed.select("doc_id")).join(listed.hint("shuffle_hash"), "doc_id").mapInArrow(released(_sets(k)), "doc_id long, gid long, tiles array<struct<i:long,j:long>>, tokens array<long>")
    tiles = sets.select("gid", F.explode("tiles").alias("t"), "doc_id", "tokens").select("gid", "t.i", "t.j", "doc_id", "tokens").repartition(partitions(spark), "gid", "i", "j")
    links = tiles.sortWithinPartitions("gid", "i", "j").mapInArrow(released(_links(percent)), "u long, v long")
    found = connected_components(links, "u", "v").select(F.col("node").alias("rep"), "component")
    named = classes.join(found, "rep", "left").select("c1", "c2", "n", F.coalesce("component", "rep").alias("own"))
    return marks.select("doc_id", "n", "c1", "c2").join(named, ["c1", "c2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("own", "doc_id").alias("component_id"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at a similarity of 0.85 on four-word shingles."""
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS token FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS both_ FROM t a JOIN t b ON a.token = b.token AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * both_ >= 85 * (na + nb - both_)),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node)
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id FROM s JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY node) c ON c.node = s.doc_id
"""
