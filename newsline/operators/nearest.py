"""A stored index for nearest neighbours by cosine, with an exact mode.

Centroids are trained on a bounded sample; every vector is filed under the list of its nearest centroid, with its
angle to it. A list is stored as pieces: rows of up to ``PIECE`` vectors in order of that angle, so a list that a
third of all vectors fall into is many pieces, and new vectors are further pieces of a new segment.

``search`` scans the lists of the ``probes`` nearest centroids. ``search_exact`` starts from a few lists, which gives
each query a k-th best cosine, then scans only the pieces that can beat it: an angle of ``a`` to the centroid and a
piece between angles ``low`` and ``high`` allow a cosine of cos(low - a) or cos(a - high) at most (triangle inequality
of angles). ``calibrate`` finds how many probes give a wanted recall, from exact searches for a bounded sample.

A scan moves the queries' vectors and each wanted piece once a 4096 queries that want it; the centroids (at most
``LISTS_BYTES``) are broadcast. How much a search saves depends on the vectors: where they lie in clusters a query
meets few lists, where they spread alike over many directions most lists stay possible.

Null or zero vectors, those with null or non-finite components or of another length than the index aren't filed, and
queries of that kind find nothing. Ids are longs; a row of a query's own id is no neighbour of it. Cosines are compared
rounded to 9 places, ties go to the smaller id; rows that repeat an id are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsline.plans.storage import bounded_batches, materialize, partitions, scratch

LISTS_BYTES = 32 << 20
#: Sampled vectors that centroids are trained on, at most; and those kept for calibration.
TRAIN, HELD_OUT = 1 << 17, 256
ROUNDS, TRAINERS = 6, 8
PIECE, QUERIES, AT_ONCE = 1024, 4096, 256
SEEDS = 4
SLACK = 1e-6  # of angles
PIECES = "list int, n int, low double, high double, ids binary, angles binary, data binary"
FOUND = "query long, id long, cosine double, list int"


def _units(rows: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, unit vectors) of the usable vectors among rows of floats or null."""
    at, out = [], []
    for k, v in enumerate(rows):
        if v is None or len(v) != dim:
            continue
        x = np.array([np.nan if y is None else y for y in v], np.float64) if not isinstance(v, np.ndarray) else v.astype(np.float64)
        top = np.abs(x).max(initial=0.0)
        if np.isfinite(top) and top > 0:
            x = x / top
            at.append(k)
            out.append(x / np.sqrt(x @ x))
    return np.array(at, np.int64), np.array(out).reshape(len(at), dim)


def _vectors(column: pa.Array) -> list:
    return [x.values.to_numpy(zero_copy_only=False) if x.is_valid and not x.values.null_count else None for x in column]


def _packed(dim: int):
    """(id, data): unit vectors in double precision, usable ones only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, units = _units(_vectors(batch.column("vector")), dim)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array([u.tobytes() for u in units], pa.binary())], ["id", "data"])

    return run


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(-1, dim)


def _nearest(units: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(list, cosine) of each vector."""
    lists, cosines = [np.zeros(0, np.int64)], [np.zeros(0)]
    for at in range(0, len(units), AT_ONCE):
        c = units[at : at + AT_ONCE] @ centres.T
        best = c.argmax(1)
        lists.append(best)
        cosines.append(c[np.arange(len(best)), best])
    return np.concatenate(lists), np.concatenate(cosines)


def _sums(sent, dim: int):
    """(list, n, data): sums of the task's vectors by their list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        sums, counts = np.zeros_like(centres), np.zeros(len(centres), np.int64)
        for batch in batches:
            units = _matrix(batch.column("data"), dim)
            lists, _ = _nearest(units, centres)
            np.add.at(sums, lists, units)
            counts += np.bincount(lists, minlength=len(centres))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some]), pa.array([sums[i].tobytes() for i in some], pa.binary())], ["list", "n", "data"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, data in zip(batch.column("list").to_pylist(), batch.column("data").to_pylist()):
            sums[i] = sums.get(i, 0) + np.frombuffer(data)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["list", "data"])


def _filed(sent, dim: int):
    """(list, angle, id, data): each vector with its list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, cosines = _nearest(_matrix(batch.column("data"), dim), sent.value)
            angles = np.arccos(np.clip(cosines, -1, 1))
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), pa.array(angles), batch.column("id"), batch.column("data")], ["list", "angle", "id", "data"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (list, angle) to pieces."""
    held: list[tuple] = []

    def piece() -> pa.RecordBatch:
        lists, angles, ids, data = zip(*held)
        row = [[lists[0]], [len(ids)], [angles[0]], [angles[-1]], [np.array(ids, np.int64).tobytes()], [np.array(angles).tobytes()], [b"".join(data)]]
        held.clear()
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], ["list", "n", "low", "high", "ids", "angles", "data"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("list", "angle", "id", "data"))):
            if held and (row[0] != held[0][0] or len(held) == PIECE):
                yield piece()
            held.append(row)
    if held:
        yield piece()


def _probed(sent, dim: int, probes: int):
    """(query, list, alpha): the lists of the nearest centroids with the query's angle to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        few = min(probes, len(centres))
        for batch in batches:
            units, ids = _matrix(batch.column("data"), dim), batch.column("id").to_numpy()
            for at in range(0, len(units), AT_ONCE):
                c = units[at : at + AT_ONCE] @ centres.T
                near = np.argsort(-c, axis=1, kind="stable")[:, :few]
                alpha = np.arccos(np.clip(np.take_along_axis(c, near, 1), -1, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at : at + len(c)], few)), pa.array(near.ravel(), pa.int32()), pa.array(alpha.ravel())], ["query", "list", "alpha"])

    return run


def _possible(sent, dim: int, probes: int):
    """(query, list, alpha, floor): lists beyond the ``probes`` nearest that may hold a cosine of ``floor`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, low, high = sent.value
        few = min(probes, len(centres))
        for batch in batches:
            units, ids, floors = _matrix(batch.column("data"), dim), batch.column("id").to_numpy(), batch.column("floor").to_numpy()
            for at in range(0, len(units), AT_ONCE):
                c = units[at : at + AT_ONCE] @ centres.T
                alpha, floor = np.arccos(np.clip(c, -1, 1)), floors[at : at + len(c)]
                gap = np.maximum(np.maximum(low - alpha, alpha - high) - SLACK, 0)
                may = np.cos(np.minimum(gap, np.pi)) >= floor[:, None]
                may[np.arange(len(c))[:, None], np.argsort(-c, axis=1, kind="stable")[:, :few]] = False
                i, j = np.nonzero(may)
                columns = [pa.array(ids[at + i]), pa.array(j, pa.int32()), pa.array(alpha[i, j]), pa.array(floor[i])]
                yield pa.RecordBatch.from_arrays(columns, ["query", "list", "alpha", "floor"])

    return run


def _scan(dim: int, k: int):
    """The best k of each query in each piece, at its floor; a piece comes before the queries that want it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, held = None, []

        def meet() -> Iterator[pa.RecordBatch]:
            at, ids, angles, units = piece
            queries, alpha, floor = (np.array(x) for x in zip(*((q, a, f) for q, a, f, _ in held)))
            floor = np.where(np.isfinite(floor), floor, -2.0)
            # Members whose angle to the centroid allows some query its floor: a run of the piece.
            reach = np.arccos(np.clip(floor - 1e-9, -1, 1)) + SLACK
            first, last = np.searchsorted(angles, (alpha - reach).min()), np.searchsorted(angles, (alpha + reach).max(), "right")
            c = np.round(np.frombuffer(b"".join(d for *_, d in held)).reshape(-1, dim) @ units[first:last].T, 9)
            own = ids[first:last]
            held.clear()
            hit = (c >= floor[:, None]) & (queries[:, None] != own[None])
            if k < c.shape[1]:
                hit &= c >= np.partition(np.where(hit, c, -3.0), c.shape[1] - k, axis=1)[:, [c.shape[1] - k]]
            i, j = np.nonzero(hit)
            order = np.lexsort((own[j], -c[i, j], i))
            i, j = i[order], j[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            i, j = i[keep], j[keep]
            yield pa.RecordBatch.from_arrays([pa.array(queries[i]), pa.array(own[j]), pa.array(c[i, j]), pa.array(np.full(len(i), at), pa.int32())], ["query", "id", "cosine", "list"])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("kind", "list", "query", "alpha", "floor", "ids", "angles", "data"))
            for kind, at, query, alpha, floor, ids, angles, data in zip(*columns):
                if held and (kind == 0 or len(held) == AT_ONCE):
                    yield from meet()
                if kind == 0:
                    piece = (at, np.frombuffer(ids, np.int64), np.frombuffer(angles), np.frombuffer(data).reshape(-1, dim))
                else:
                    held.append((query, alpha, floor, data))
        if held:
            yield from meet()

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.col("cosine").desc(), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


class VectorIndex:
    """An index below ``path``; all that it knows is stored there, so any session can open it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        rows = spark.read.parquet(f"{self.path}/centroids").orderBy("list").collect()
        self.dim = len(rows[0].data) // 8
        self.centres = np.stack([np.frombuffer(r.data) for r in rows])
        self.sent = spark.sparkContext.broadcast(self.centres)

    @classmethod
    def build(cls, df: DataFrame, key: str, vector: str, path: str, dim: int, lists: int | None = None) -> VectorIndex:
        """Trains centroids on a sample of ``df`` and files all its vectors; ``lists`` is the root of the number of vectors if not given."""
        spark = df.sparkSession
        rows = cls._rows(df, key, vector, dim)
        total = rows.count()
        lists = max(1, min(lists or round(total**0.5), LISTS_BYTES // (8 * dim), TRAIN, total or 1))
        share = min(1.0, TRAIN / max(total, 1))
        chosen = F.pmod(F.xxhash64("id", "data"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + (share == 1.0))
        sample = materialize(rows.where(chosen).select("id", "data").limit(TRAIN).repartition(TRAINERS), "sample")
        seeds = sample.select("data").distinct().orderBy(F.xxhash64("data", F.lit(1)), "data").limit(lists).collect()
        centres = np.stack([np.frombuffer(r.data) for r in seeds]) if seeds else np.eye(1, dim)
        for _ in range(ROUNDS if seeds else 0):
            sent = spark.sparkContext.broadcast(centres)
            # The sample is bounded: a few tasks sum it, one adds their sums, a row a list.
            sums = sample.coalesce(TRAINERS).mapInArrow(_sums(sent, dim), "list int, n long, data binary").repartition(1)
            for r in sums.mapInArrow(_merged, "list int, data binary").collect():  # at most LISTS_BYTES in all
                x = np.frombuffer(r.data)
                if (norm := np.linalg.norm(x)) > 0:
                    centres[r.list] = x / norm
            sent.destroy()
        table = spark.createDataFrame([(i, c.tobytes()) for i, c in enumerate(centres)], "list int, data binary")
        table.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        sample.orderBy(F.xxhash64("data", F.lit(2)), "id").limit(HELD_OUT).coalesce(1).write.mode("overwrite").parquet(f"{path}/sample")
        out = cls(spark, path)
        out._add(rows, "overwrite", 0)
        return out

    @staticmethod
    def _rows(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
        given = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")).where("id is not null")
        return materialize(given.mapInArrow(_packed(dim), "id long, data binary"), "units")

    def add(self, df: DataFrame, key: str, vector: str) -> None:
        """Files further vectors under the centroids at hand, as one more segment."""
        last = self.spark.read.parquet(f"{self.path}/pieces").agg(F.max("segment")).first()[0]
        self._add(self._rows(df, key, vector, self.dim), "append", (last or 0) + 1)

    def _add(self, rows: DataFrame, mode: str, segment: int) -> None:
        n = partitions(self.spark)
        filed = rows.mapInArrow(_filed(self.sent, self.dim), "list int, angle double, id long, data binary")
        ordered = filed.repartitionByRange(n, "list", "angle", "id").sortWithinPartitions("list", "angle", "id")
        with bounded_batches(self.spark):
            ordered.mapInArrow(_cut, PIECES).withColumn("piece", F.monotonically_increasing_id()).withColumn("segment", F.lit(segment)).write.mode(mode).parquet(f"{self.path}/pieces")

    def _pieces(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/pieces")

    def _scanned(self, queries: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
        """(query, id, cosine, list) of (query, list, alpha, floor) rows: every piece of the lists that may reach the floor."""
        n, name = partitions(self.spark), ["segment", "piece"]
        pieces = self._pieces()
        gap = F.greatest(F.col("low") - F.col("alpha"), F.col("alpha") - F.col("high")) - SLACK
        met = wanted.join(pieces.select("list", "low", "high", *name), "list").where(F.cos(F.greatest(gap, F.lit(0.0))) >= F.col("floor"))
        met = materialize(met.select(*name, "query", "alpha", "floor"), "met")
        # A piece that very many queries want is sent to several tasks, each with a part of them.
        loads = met.groupBy(*name).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64("query"), F.col("parts")).cast("int").alias("part")
        asked = met.join(loads, name).select(*name, part, "query", "alpha", "floor")
        asked = asked.join(queries.select(F.col("id").alias("query"), "data"), "query")
        none = lambda c, kind: F.lit(None).cast(kind).alias(c)
        asked = asked.select(*name, "part", F.lit(1).alias("kind"), none("list", "int"), "query", "alpha", "floor", none("ids", "binary"), none("angles", "binary"), "data")
        blocks = pieces.join(loads, name).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        blocks = blocks.select(*name, "part", F.lit(0).alias("kind"), "list", none("query", "long"), none("alpha", "double"), none("floor", "double"), "ids", "angles", "data")
        dealt = blocks.union(asked).repartition(n, *name, "part").sortWithinPartitions(*name, "part", "kind")
        with bounded_batches(self.spark):
            return materialize(dealt.mapInArrow(_scan(self.dim, k), FOUND), "found")

    def _asked(self, queries: DataFrame, key: str, vector: str) -> DataFrame:
        """One row an id: of repeated ids with different vectors all are asked under that id."""
        return self._rows(queries, key, vector, self.dim)

    def search(self, queries: DataFrame, key: str, vector: str, k: int, probes: int) -> DataFrame:
        """(query, id, cosine, rank): the nearest within the lists of the ``probes`` nearest centroids; query ids are unique."""
        return self._ranked(self._near(self._asked(queries, key, vector), k, probes), k)

    def _near(self, asked: DataFrame, k: int, probes: int) -> DataFrame:
        wanted = asked.mapInArrow(_probed(self.sent, self.dim, probes), "query long, list int, alpha double").withColumn("floor", F.lit(-2.0))
        return self._scanned(asked, wanted, k)

    def search_exact(self, queries: DataFrame, key: str, vector: str, k: int, seeds: int = SEEDS) -> DataFrame:
        """(query, id, cosine, rank): the nearest of all vectors; query ids are unique."""
        return self._ranked(self._exact(self._asked(queries, key, vector), k, seeds), k)

    def _exact(self, asked: DataFrame, k: int, seeds: int = SEEDS) -> DataFrame:
        first = self._near(asked, k, seeds)
        full = _top(first, k).groupBy("query").agg(F.count("*").alias("n"), F.min("cosine").alias("worst"))
        floors = asked.join(full.withColumnRenamed("query", "id"), "id", "left")
        floors = floors.select("id", "data", F.when(F.col("n") == k, F.col("worst") - 2e-9).otherwise(-2.0).alias("floor"))
        ranges = self._pieces().groupBy("list").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()  # a row a list
        low, high = np.full(len(self.centres), 4.0), np.full(len(self.centres), -4.0)
        for r in ranges:
            low[r.list], high[r.list] = r.low, r.high
        low[low > 3.5], high[high < -3.5] = 9.0, 9.0  # lists without members reach no floor but -2, and have no piece
        sent = self.spark.sparkContext.broadcast((self.centres, low, high))
        wanted = floors.mapInArrow(_possible(sent, self.dim, seeds), "query long, list int, alpha double, floor double")
        return first.union(self._scanned(asked, wanted, k))

    def _ranked(self, found: DataFrame, k: int) -> DataFrame:
        return _top(found, k).select("query", "id", "cosine", F.col("rank").cast("int").alias("rank"))

    def calibrate(self, recall: float = 0.95, k: int = 10) -> int:
        """The fewest probes with which the stored sample (at most HELD_OUT vectors, searched exactly) finds that share of its k nearest."""
        sample = materialize(self.spark.read.parquet(f"{self.path}/sample").dropDuplicates(["id"]), "asked")
        true = _top(self._exact(sample, k), k).select("query", "list").collect()
        if not true:
            return 1
        units = {r.id: np.frombuffer(r.data) for r in sample.collect()}
        order = {q: np.argsort(np.argsort(-(self.centres @ u), kind="stable")) for q, u in units.items()}
        depth = np.sort([order[r.query][r.list] + 1 for r in true])
        return int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))) - 1)])


def temporary_index(df: DataFrame, key: str, vector: str, dim: int, lists: int | None = None) -> VectorIndex:
    """An index in the session's shared folder."""
    return VectorIndex.build(df, key, vector, scratch(df.sparkSession, "index"), dim, lists)
