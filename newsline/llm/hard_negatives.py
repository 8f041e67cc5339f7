"""Hard negatives by angular triangle filtering.

A vector's components become floor(256 x), so scores are exact integers. Stored with each vector are its norm,
its angles to reference directions (leading principal axes of all vectors, orthonormal), and the angle to what
they span, each as a step of ``UNIT`` radians in two bytes. For an anchor and a row these give an interval of
their cosine: the sum of products of the angles' cosines, plus or minus the product of the sines of the last
angles (for one reference that is the triangle inequality of angles). Widened by the rounding of the angles and
multiplied by the norms it bounds the score, and only rows whose bounds reach a wanted window are scored.

Anchors are a stated query set and meet all rows in passes: a pass broadcasts anchors of at most about
``PASS_BYTES`` to every task, rows never move, and a task sends on its best few an anchor. A pass first finds each
anchor's positives (window: at least the worst of its best so far), then for each positive the negatives whose
score is within its share of the positive's, again at least the worst of the best so far.

Rows with null id, label or vector, or null or non-finite components take no part, nor does a row whose integer
norm could make a score leave 64 bits (2 ** 31 or more). Vectors of different lengths don't meet. Rows of one
vec_id are separate rows but no partners of each other: an anchor's others have another vec_id. Ties go to the
smaller vec_id. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsline.llm.common import released
from newsline.plans.storage import materialize, table

REFERENCES = 48
#: Lengths of vectors that get fitted references; others take their leading coordinates.
FITTED = 8
#: Leading components that references are fitted to.
TURNED = 512
PASS_BYTES = 64 << 20
TILE, ROWS = 4096, 256
UNIT = np.pi / 65535
NORM_LIMIT = float(1 << 31)
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90


def _packed(q: np.ndarray) -> bytes:
    """Integers in as few bytes as they fit, the width in front."""
    top = max(int(np.abs(q).max()), 1) if len(q) else 1
    width = next(w for w in (2, 4, 8) if top < 1 << (8 * w - 1))
    return bytes([width]) + q.astype(f"<i{width}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.float64)


def _quantized(scale: int):
    """(vec_id, label, dim, norm, q) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, label, x in zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), batch.column("embedding")):
                if i is None or label is None or not x.is_valid or x.values.null_count:
                    continue
                v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(v).all() or np.abs(v).max(initial=0) * scale >= NORM_LIMIT:
                    continue
                q = np.floor(v * scale)
                if (norm := float(np.sqrt(q @ q))) < NORM_LIMIT:
                    rows.append((i, label, len(q), norm, _packed(q.astype(np.int64))))
            columns = zip(*rows) if rows else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["vec_id", "label", "dim", "norm", "q"])

    return run


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, dim, norm, q) of (vec_id, label, embedding): integer vectors, packed."""
    return vectors.select("vec_id", F.col("label").cast("long").alias("label"), "embedding").mapInArrow(_quantized(scale), "vec_id long, label long, dim int, norm double, q binary")


def _moments(dims: list[int]):
    """(dim, sums): products of leading components of unit vectors, summed over the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            held = {}
            for d, norm, q in zip(batch.column("dim").to_pylist(), batch.column("norm").to_pylist(), batch.column("q").to_pylist()):
                if d in dims and norm > 0:
                    held.setdefault(d, []).append(_unpacked(q)[:TURNED] / norm)
            for d, rows in held.items():
                x = np.stack(rows)
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, x in sums.items():
            cells = np.arange(x.size)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(x.size, d), pa.int32()), pa.array(cells, pa.int32()), pa.array(x.ravel())], ["dim", "cell", "value"])

    return run


def references(rows: DataFrame, count: int = REFERENCES) -> dict[int, np.ndarray]:
    """For the commonest lengths of vectors, orthonormal reference directions as columns: the leading principal axes.

    At most ``FITTED`` times ``TURNED`` squared numbers reach the driver.
    """
    common = rows.where("dim > 0").groupBy("dim").count().orderBy(F.col("count").desc(), "dim").limit(FITTED).collect()
    dims = [r.dim for r in common]
    sums = rows.mapInArrow(_moments(dims), "dim int, cell int, value double").groupBy("dim", "cell").agg(F.sum("value").alias("value")).toPandas()
    out = {}
    for d, own in sums.groupby("dim"):
        m = min(int(d), TURNED)
        gram = np.zeros(m * m)
        gram[own.cell] = own.value
        gram = gram.reshape(m, m)
        axes = np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1][:, :count]
        out[int(d)] = np.vstack([axes, np.zeros((int(d) - m, axes.shape[1]))])
    return out


def _angles(packed, count: int):
    """Adds angles: to each reference and, last, to the space of all of them, in steps of UNIT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = pickle.loads(packed.value)
        for batch in batches:
            out = []
            for d, norm, q in zip(batch.column("dim").to_pylist(), batch.column("norm").to_pylist(), batch.column("q").to_pylist()):
                x = _unpacked(q) / norm if norm else np.zeros(d)
                c = np.clip(x @ axes[d] if d in axes else x[:count], -1, 1)
                rest = np.sqrt(max(0.0, min(1.0, float(x @ x)) - float(c @ c)))
                out.append(np.rint(np.append(np.arccos(c), np.arcsin(min(1.0, rest))) / UNIT).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "angles"])

    return run


class Block:
    """Rows of one length of vectors as matrices."""

    def __init__(self, ids, labels, norms, vectors, angles):
        self.ids, self.labels, self.norms = np.array(ids, np.int64), np.array(labels, np.int64), np.array(norms)
        self.vectors = np.stack([_unpacked(v) for v in vectors])
        turns = np.frombuffer(b"".join(angles), "<u2").reshape(len(self.ids), -1) * UNIT
        self.cosines, self.sines = np.cos(turns[:, :-1]), np.sin(turns[:, -1])

    def take(self, at: slice) -> Block:
        own = object.__new__(Block)
        for name, value in self.__dict__.items():
            setattr(own, name, value[at])
        return own


def bounds(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) score of each pair, never too narrow."""
    step = UNIT / 2 + 1e-9
    slack = step * (2 * np.sqrt(a.cosines.shape[1]) + 2) + step * step * (a.cosines.shape[1] + 1) + 1e-9
    middle, spread = a.cosines @ b.cosines.T, np.multiply.outer(a.sines, b.sines) + slack
    size = np.multiply.outer(a.norms, b.norms)
    return (middle - spread) * size - 1, (middle + spread) * size + 1


def scores(a: Block, b: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact integer inner products of pairs: in doubles where every partial sum is below 2 ** 53, else in integers."""
    out = np.empty(len(i), np.int64)
    small = a.norms.max(initial=0) * b.norms.max(initial=0) < float(1 << 52)
    for at in range(0, len(i), 1 << 16):
        p = slice(at, at + (1 << 16))
        x, y = a.vectors[i[p]], b.vectors[j[p]]
        out[p] = np.einsum("ij,ij->i", x, y) if small else np.einsum("ij,ij->i", x.astype(np.int64), y.astype(np.int64))
    return out


class Best:
    """The best ``k`` (score, id) of each query: higher scores, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.worst = np.full(n, -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(query):
            return
        q, s, i = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.id, ids)))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.searchsorted(q, q)
        keep = np.arange(len(q)) - first < self.k
        self.query, self.score, self.id = q[keep], s[keep], i[keep]
        full = np.arange(len(q)) - first == self.k - 1
        self.worst[q[full]] = s[full]


def _tiles(batches: Iterator[pa.RecordBatch], dims) -> Iterator[tuple[int, Block]]:
    """(dim, rows) of about TILE rows whose length some anchor has."""
    held: dict[int, list] = {}
    names = ("dim", "vec_id", "label", "norm", "q", "angles")
    for batch in batches:
        for d, *row in zip(*(batch.column(c).to_pylist() for c in names)):
            if d in dims:
                own = held.setdefault(d, [])
                own.append(row)
                if len(own) == TILE:
                    yield d, Block(*zip(*held.pop(d)))
    for d, own in held.items():
        yield d, Block(*zip(*own))


def _positives(packed, k: int):
    """(anchor, score, vec_id): each anchor's best rows of its label within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = {d: (np.array(n), Block(*rest)) for d, (n, *rest) in pickle.loads(packed.value).items()}
        best = {d: Best(len(n), k) for d, (n, _) in anchors.items()}
        for d, rows in _tiles(batches, anchors):
            names, all_anchors = anchors[d]
            for at in range(0, len(names), ROWS):
                own = all_anchors.take(slice(at, at + ROWS))
                hit = own.labels[:, None] == rows.labels[None]
                hit &= own.ids[:, None] != rows.ids[None]
                hit &= bounds(own, rows)[1] >= best[d].worst[at : at + ROWS, None]
                i, j = np.nonzero(hit)
                best[d].add(i + at, scores(own, rows, i, j), rows.ids[j])
        for d, (names, _) in anchors.items():
            own = best[d]
            yield pa.RecordBatch.from_arrays([pa.array(names[own.query], pa.int64()), pa.array(own.score), pa.array(own.id)], ["anchor", "score", "vec_id"])

    return run


def _negatives(packed, k: int, low: int, high: int):
    """(anchor, place, score, vec_id): for each of an anchor's positives the best rows of other labels in its window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = {}
        for d, (names, *rest, found) in pickle.loads(packed.value).items():
            places = max(map(len, found), default=0)
            limits = np.zeros((len(names), places, 2), np.int64)
            limits[..., 0] = 1  # places without a positive: an empty window
            for a, own in enumerate(found):
                limits[a, : len(own)] = np.array([(-((-low * s) // 100), high * s // 100) for s in own], np.int64).reshape(-1, 2)
            if places:
                anchors[d] = (np.array(names), Block(*rest), limits)
        best = {d: Best(x[..., 0].size, k) for d, (_, _, x) in anchors.items()}
        for d, rows in _tiles(batches, anchors):
            names, all_anchors, limits = anchors[d]
            places = limits.shape[1]
            worst = best[d].worst.reshape(-1, places)
            for at in range(0, len(names), ROWS):
                own, p = all_anchors.take(slice(at, at + ROWS)), slice(at, at + ROWS)
                least, most = bounds(own, rows)
                # The windows of an anchor as one: from the lowest to the highest score that some positive still wants.
                floor, top = np.maximum(limits[p, :, 0].astype(float), worst[p]), limits[p, :, 1].astype(float)
                wants = floor <= top
                lowest, highest = np.where(wants, floor, np.inf).min(1), np.where(wants, top, -np.inf).max(1)
                hit = (most >= lowest[:, None]) & (least <= highest[:, None])
                hit &= own.labels[:, None] != rows.labels[None]
                hit &= own.ids[:, None] != rows.ids[None]
                i, j = np.nonzero(hit)
                s = scores(own, rows, i, j)
                for w in range(places):
                    within = (s >= limits[at + i, w, 0]) & (s <= limits[at + i, w, 1])
                    best[d].add((at + i[within]) * places + w, s[within], rows.ids[j[within]])
        for d, (names, _, limits) in anchors.items():
            own, places = best[d], limits.shape[1]
            columns = [pa.array(names[own.query // places], pa.int64()), pa.array(own.query % places, pa.int32()), pa.array(own.score), pa.array(own.id)]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "place", "score", "vec_id"])

    return run


def _ranked(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")
    return df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _pass(spark: SparkSession, rows: DataFrame, anchors: DataFrame, positives: int, negatives: int, window: tuple[int, int]) -> DataFrame:
    """The result for the anchors of one pass, which fit on the driver."""
    own = sorted(anchors.select("dim", "row", "vec_id", "label", "norm", "q", "angles").collect(), key=lambda r: r.row)
    columns: dict[int, list] = {}
    for r in own:
        for column, value in zip(columns.setdefault(r.dim, [[] for _ in range(6)]), (r.row, r.vec_id, r.label, r.norm, r.q, r.angles)):
            column.append(value)
    sent = spark.sparkContext.broadcast(pickle.dumps(columns))
    near = rows.mapInArrow(released(_positives(sent, positives)), "anchor long, score long, vec_id long")
    near = materialize(_ranked(near, ["anchor"], positives), "positives")
    held: dict[int, list] = {}
    for r in near.orderBy("anchor", "rank").collect():  # at most ``positives`` an anchor of the pass
        held.setdefault(r.anchor, []).append(r.score)
    windows = spark.sparkContext.broadcast(pickle.dumps({d: [*c, [held.get(n, []) for n in c[0]]] for d, c in columns.items()}))
    far = rows.mapInArrow(released(_negatives(windows, negatives, *window)), "anchor long, place int, score long, vec_id long")
    far = _ranked(far, ["anchor", "place"], negatives)
    near = near.select("anchor", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = far.join(near, ["anchor", "place"]).join(named, "anchor")
    return materialize(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")


def hard_negatives(
    rows: DataFrame, is_anchor: str, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = (LOW, HIGH), pass_bytes: int = PASS_BYTES, count: int = REFERENCES
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows from ``quantized``.

    ``is_anchor`` is a condition on them; ``window`` is in hundredths of the positive's score.
    """
    spark = rows.sparkSession
    rows = materialize(rows, "quantized")
    axes = spark.sparkContext.broadcast(pickle.dumps(references(rows, count)))
    angled = rows.mapInArrow(_angles(axes, count), "vec_id long, label long, dim int, norm double, q binary, angles binary")
    rows = materialize(angled.withColumn("row", F.monotonically_increasing_id()), "angled")
    anchors = rows.where(is_anchor)
    size = anchors.agg(F.sum(F.length("q") + F.length("angles") + 64)).first()[0] or 0
    passes = max(1, -(-size // pass_bytes))
    out = None
    for p in range(passes):
        own = anchors if passes == 1 else anchors.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == p)
        found = _pass(spark, rows, own, positives, negatives, window)
        out = found if out is None else out.union(found)
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector against all."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(quantized(vectors.withColumn("label", label)), "vec_id % 100 = 0")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q, len(embedding) AS d
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.d = b.d AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.a, p.b AS pos, p.score AS ps, s.b AS neg, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT a AS anchor_id, pos AS positive_id, CAST(rank AS INT) AS rank, neg AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 10
"""
