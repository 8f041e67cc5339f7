"""All pairs of sparse unit vectors at a cosine, by a weighted prefix index.

Equal vectors are one class, and classes are joined. Places are ordered from rare to common. What two vectors can
still have in common from some place on is at most the norm of the rest of either, and at most the rest's weights
times the largest weight that any vector has there; a class is indexed under its rarest places only, up to where
that bound falls below the threshold. The rarest place that a similar pair shares is in both prefixes, so the pair
meets there, and only pairs whose weights where they meet and whose rests (norm, sum and largest weight) allow the
threshold go on to an exact product.

A place in very many prefixes is split. With W its largest weight, a class of weight w there is light if w * W is
below the threshold: a similar pair with a light class then shares a second place, so light classes meet others
under (place, second place), again cut by the rest's bound. Only heavy ones, to which the place is most
of the vector, meet each other under the place itself. Keys that are still large are dealt into tiles.

Every vector counts, in any number of copies; pairs of copies are put back at the end. Weights may be negative. Zero
vectors have no rows and no pairs. The threshold must be above 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsline.plans.storage import materialize

#: Prefixes that a place may be in before it is split, and rows of a key that meet in one tile.
HOT, TILE = 4096, 4096
EPS = 1e-9
POSTING = "blk string, p long, q long, c long, w1 double, w2 double, rest double, total double, most double"
_NAMES = ["blk", "p", "q", "c", "w1", "w2", "rest", "total", "most"]
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.float64()] * 5]


class _Rests:
    """What lies at and behind each place of one vector, places from rare to common."""

    def __init__(self, weights: np.ndarray, tops: np.ndarray):
        size = np.abs(weights)
        back = lambda x, f: np.append(f(x[::-1])[::-1], 0.0)
        self.norm = np.sqrt(back(size * size, np.cumsum))
        self.total, self.most = back(size, np.cumsum), back(size, np.maximum.accumulate)
        #: The largest product that this place and those behind can give with any vector.
        self.bound = np.minimum(self.norm, back(size * tops, np.cumsum))


def _prefixes(threshold: float):
    """Postings of each class under single places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c, blk, places in zip(*(batch.column(x).to_pylist() for x in ("c", "blk", "places"))):
                w, rests = _read(places)
                for i in np.flatnonzero(rests.bound[:-1] >= threshold - EPS):
                    out.append((blk, places[i]["idx"], -1, c, w[i], 0.0, rests.norm[i + 1], rests.total[i + 1], rests.most[i + 1]))
            yield _batch(out)

    return run


def _read(places: list[dict]) -> tuple[np.ndarray, _Rests]:
    w = np.array([x["weight"] for x in places])
    return w, _Rests(w, np.array([x["top"] for x in places]))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [()] * 9, _KINDS)], _NAMES)


def _second(threshold: float):
    """Postings of classes under (hot place, second place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c, blk, places, hot in zip(*(batch.column(x).to_pylist() for x in ("c", "blk", "places", "hot"))):
                w, rests = _read(places)
                at = {x["idx"]: i for i, x in enumerate(places)}
                for h in hot:
                    i = at[h["idx"]]
                    own = abs(w[i])
                    light = own * h["top"] < threshold - EPS
                    partner = h["top"] if light else h["light"]
                    if partner is None:  # heavy classes only: none of them needs a second place
                        continue
                    need = threshold - EPS - own * partner
                    for j in i + 1 + np.flatnonzero(rests.bound[i + 1 : -1] >= need):
                        out.append((blk, h["idx"], places[j]["idx"], c, w[i], w[j], rests.norm[j + 1], rests.total[j + 1], rests.most[j + 1]))
            yield _batch(out)

    return run


def classes(sparse: DataFrame, key: str, block: str | None) -> tuple[DataFrame, DataFrame]:
    """(classes, members): (c, blk, idx, weight, n) of distinct vectors, and (c, id)."""
    rows = sparse.select((F.col(block).cast("string") if block else F.lit("")).alias("blk"), F.col(key).alias("id"), F.col("idx").cast("long").alias("idx"), F.col("weight").cast("double").alias("weight"))
    rows = rows.where("id is not null and weight != 0").groupBy("blk", "id").agg(F.sort_array(F.collect_list(F.struct("idx", "weight"))).alias("e"))
    rows = materialize(rows.select("blk", "id", F.xxhash64("e").alias("sig"), F.col("e.idx").alias("idx"), F.col("e.weight").alias("weight")), "vectors")
    found = rows.groupBy("blk", "sig", "idx", "weight").agg(F.count("*").alias("n"))
    found = materialize(found.withColumn("c", F.monotonically_increasing_id()), "classes")
    same = [F.col(f"r.{x}").eqNullSafe(F.col(f"f.{x}")) for x in ("blk", "sig", "idx", "weight")]
    members = rows.alias("r").join(found.alias("f"), same).select("f.c", "r.id")
    return found.select("c", F.coalesce("blk", F.lit("\0")).alias("blk"), "idx", "weight", "n"), materialize(members, "members")


def postings(found: DataFrame, threshold: float, hot: int = HOT) -> DataFrame:
    """The rows that meet, with parts: the number of tiles of their key."""
    entries = found.select("c", "blk", F.explode(F.arrays_zip("idx", "weight")).alias("e")).select("c", "blk", "e.idx", "e.weight")
    places = entries.groupBy("blk", "idx").agg(F.count("*").alias("n"), F.max(F.abs("weight")).alias("top")).where("n > 1")  # no pair shares the others
    placed = entries.join(places, ["blk", "idx"]).groupBy("blk", "c").agg(F.sort_array(F.collect_list(F.struct("n", "idx", "weight", "top"))).alias("places"))
    placed = materialize(placed, "placed")
    single = materialize(placed.mapInArrow(_prefixes(threshold), POSTING), "single")
    loads = single.groupBy("blk", "p").agg(F.count("*").alias("n"), F.max(F.abs("w1")).alias("top")).where(F.col("n") > hot)
    marked = single.join(loads.select("blk", "p", "top"), ["blk", "p"], "left")
    light = F.abs("w1") * F.col("top") < threshold - EPS
    lights = marked.where(light).groupBy("blk", "p").agg(F.max(F.abs("w1")).alias("light"))
    split = materialize(loads.select("blk", "p", "top").join(lights, ["blk", "p"], "left"), "split")
    alone = marked.where(F.col("top").isNull() | ~light).select(*_NAMES)
    asked = single.join(split, ["blk", "p"]).groupBy("c").agg(F.collect_list(F.struct(F.col("p").alias("idx"), "top", "light")).alias("hot"))
    second = placed.join(asked, "c").mapInArrow(_second(threshold), POSTING)
    both = materialize(alone.union(second), "postings")
    sizes = both.groupBy("blk", "p", "q").agg(F.count("*").alias("n")).where("n > 1")
    return both.join(sizes.select("blk", "p", "q", F.ceil(F.col("n") / TILE).cast("int").alias("parts")), ["blk", "p", "q"])


def sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each posting where it meets others: tiles (lo, hi) with lo <= hi, as the left and as the right side."""
    tile = F.pmod(F.xxhash64("c"), F.col("parts")).cast("int").alias("tile")
    dealt = rows.select("*", tile)
    left = dealt.select(*_NAMES, F.col("tile").alias("lo"), F.explode(F.sequence(F.col("tile"), F.col("parts") - 1)).alias("hi"))
    right = dealt.select(*_NAMES, F.explode(F.sequence(F.lit(0), F.col("tile"))).alias("lo"), F.col("tile").alias("hi"))
    return left, right


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, cosine) of rows with both vectors, as sorted lists of places and weights."""
    for batch in batches:
        n, flat = batch.num_rows, {}
        for side in "ab":
            idx, weight = batch.column(f"idx_{side}"), batch.column(f"weight_{side}")
            row = np.repeat(np.arange(n), np.diff(idx.offsets.to_numpy()))
            flat[side] = (row, idx.flatten().to_numpy(), weight.flatten().to_numpy())
        # A common numbering of (row, place) pairs.
        values = np.unique(np.concatenate([flat["a"][1], flat["b"][1]]))
        code = {s: flat[s][0] * max(1, len(values)) + np.searchsorted(values, flat[s][1]) for s in "ab"}
        _, i, j = np.intersect1d(code["a"], code["b"], assume_unique=True, return_indices=True)
        cosine = np.bincount(flat["a"][0][i], flat["a"][2][i] * flat["b"][2][j], n)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(cosine)], ["a", "b", "cosine"])


def sparse_join(sparse: DataFrame, key: str, threshold: float, block: str | None = None, hot: int = HOT) -> DataFrame:
    """(a, b, cosine) of (key, idx, weight) unit vectors at the threshold, a < b, within a block."""
    found, members = classes(sparse, key, block)
    left, right = sides(postings(found, threshold, hot))
    on = ["blk", "p", "q", "lo", "hi"]
    met = left.alias("l").join(right.alias("r"), on)
    own = F.abs(F.col("l.w1") * F.col("r.w1")) + F.abs(F.col("l.w2") * F.col("r.w2"))
    rest = F.least(F.col("l.rest") * F.col("r.rest"), F.col("l.total") * F.col("r.most"), F.col("l.most") * F.col("r.total"))
    met = met.where((F.col("lo") < F.col("hi")) | (F.col("l.c") < F.col("r.c")))
    met = met.select(F.least("l.c", "r.c").alias("a"), F.greatest("l.c", "r.c").alias("b"), own.alias("own"), rest.alias("rest")).where("a != b")
    # Up to the last place where a pair meets it meets at every place it shares, so its product is at most what it
    # has met with and the rest behind there.
    pairs = met.groupBy("a", "b").agg((F.sum("own") + F.min("rest")).alias("most")).where(F.col("most") >= threshold - EPS)
    pairs = materialize(pairs.select("a", "b"), "candidates")
    side = lambda s: found.select(F.col("c").alias(s), F.col("idx").alias(f"idx_{s}"), F.col("weight").alias(f"weight_{s}"))
    product = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_products, "a long, b long, cosine double").where(F.col("cosine") >= threshold)
    norm = F.aggregate("weight", F.lit(0.0), lambda s, x: s + x * x)
    copies = found.where("n > 1").select(F.col("c").alias("a"), F.col("c").alias("b"), norm.alias("cosine")).where(F.col("cosine") >= threshold)
    whole = product.union(copies)
    one, two = (members.select(F.col("c").alias(s), F.col("id").alias(f"id_{s}")) for s in "ab")
    put = whole.join(one, "a").join(two, "b").where((F.col("a") != F.col("b")) | (F.col("id_a") < F.col("id_b")))
    return put.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "cosine")
