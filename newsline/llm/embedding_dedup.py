"""Exact cosine joins of dense vectors by PCA-ordered tiled comparison.

Vectors are scaled to unit length and turned into the axes of the principal components of all
of them (any turn keeps cosines; this one puts most of a vector into its leading axes; of vectors
longer than ``TURNED`` only that many leading components are turned). Equal vectors are one class.
Unit vectors of cosine t or more are at most sqrt(2 - 2t) apart on every axis, so classes go into
cells of that width on the two leading axes and only neighbouring cells meet. Cells are dealt
into tiles of about ``TILE`` classes. Each two tiles meet twice. First only the ``STEP`` leading axes
travel, with the norm of the rest, a tenth of a vector: a product bounded by the product of the
suffixes' norms tells which vectors may have a partner in the other tile. Then those vectors meet
whole: the same product again, then the next axes, with what can't reach t dropped at each step,
and the survivors are decided by a double-precision dot product of the given vectors. A
task returns counts a vector and a spanning forest of its links, not its pairs.

How much the leading axes prune depends on the vectors: the first meeting stays quadratic in the classes of
neighbouring cells, and vectors spread alike over many axes have few cells.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing,
nor do vectors of different lengths. Every row is a vector, so repeated rows link with each
other, and rows of one vec_id share a component; a row with null vec_id counts as a vector and gives its
component no name. Ids are below 2 ** 62; few lengths of vectors are expected.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsline.llm.common import lowest
from newsline.plans.components import connected_components
from newsline.plans.storage import materialize, partitions, table

#: A vector with more copies is answered in shares.
HOT = 1000
TILE = 4096
STEP = 16
TURNED = 512
UNNAMED = 1 << 62  # nodes from here on stand for vectors without id
SLACK = 1e-5  # of the turned single-precision vectors; the final test has none


def _unit(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, float]]:
    """(row, vector, norm) of the usable vectors."""
    for i, x in enumerate(batch.column("embedding")):
        if not x.is_valid or x.values.null_count or not len(x.values):
            continue
        v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
        norm = float(np.sqrt((v / (top := np.abs(v).max() or 1.0)) @ (v / top)) * top) if np.isfinite(v).all() else 0.0
        if norm > 0 and np.isfinite(norm):
            yield i, v, norm


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, key, dim, unit): key names the given vector, unit is its direction in double precision."""
    for batch in batches:
        keys, dims, units = [None] * batch.num_rows, [0] * batch.num_rows, [None] * batch.num_rows
        for i, v, norm in _unit(batch):
            keys[i], dims[i], units[i] = hashlib.md5((v + 0.0).tobytes()).digest(), len(v), (v / norm).tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], ["vec_id", "key", "dim", "unit"])


def _gram(most: int):
    """(dim, cell, value): sums of products of leading components over the rows of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            units = batch.column("unit")
            for d in np.unique(dims[dims > 0]).tolist():
                x = np.frombuffer(b"".join(units[i].as_py() for i in np.flatnonzero(dims == d).tolist())).reshape(-1, d)[:, :most]
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(x.size, d), pa.int32()), pa.array(np.arange(x.size), pa.int32()), pa.array(x.ravel())], ["dim", "cell", "value"])

    return run


def _turns(units: DataFrame, most: int) -> dict[int, np.ndarray]:
    """The principal axes for each length of vectors; at most ``most`` squared numbers a length are collected."""
    rows = units.mapInArrow(_gram(most), "dim int, cell int, value double").groupBy("dim", "cell").agg(F.sum("value").alias("value")).toPandas()
    out = {}
    for d, own in rows.groupby("dim"):
        m = min(int(d), most)
        gram = np.zeros(m * m)
        gram[own.cell] = own.value
        gram = gram.reshape(m, m)
        out[int(d)] = np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1]
    return out


def _place(packed, width: float, most: int):
    """The class with its cell on the two leading axes, its leading axes with the norm of the rest, and all axes turned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = pickle.loads(packed.value)
        for batch in batches:
            rows = []
            for d, unit in zip(batch.column("dim").to_pylist(), batch.column("unit").to_pylist()):
                x = np.frombuffer(unit)
                y = np.concatenate([x[:most] @ turns[d], x[most:]])
                lead = np.zeros(STEP + 1, np.float32)
                lead[: len(y[:STEP])] = y[:STEP]
                lead[STEP] = np.sqrt((y[STEP:] ** 2).sum())
                rows.append((int(np.floor(y[0] / width)), int(np.floor(y[1] / width)) if d > 1 else 0, lead.tobytes(), y.astype(np.float32).tobytes()))
            a, b, lead, turned = zip(*rows) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(lead, pa.binary()), pa.array(turned, pa.binary())], [*batch.schema.names, "a", "b", "lead", "turned"])

    return run


def compare(x: np.ndarray, y: np.ndarray, ux: np.ndarray, uy: np.ndarray, threshold: float, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs at the threshold: x, y in turned axes, ux, uy as given."""
    dims = x.shape[1]
    tail = lambda v: np.sqrt(np.maximum(np.cumsum((v.astype(np.float64) ** 2)[:, ::-1], axis=1)[:, ::-1], 0))
    tx, ty = tail(x), tail(y)
    # One product gives the leading axes and, from a further column, the bound of the rest.
    if dims > step:
        lx, ly = np.column_stack([x[:, :step], tx[:, step].astype(np.float32)]), np.column_stack([y[:, :step], ty[:, step].astype(np.float32)])
    else:
        lx, ly = x, y
    rows, cols, bounds = [], [], []
    for a in range(0, len(x), 512):
        part = lx[a : a + 512] @ ly.T
        hit = np.flatnonzero(part.ravel() >= threshold - SLACK)
        bounds.append(part.ravel()[hit])
        rows.append(a + hit // part.shape[1])
        cols.append(hit % part.shape[1])
    i, j, bound = np.concatenate(rows), np.concatenate(cols), np.concatenate(bounds)
    at = step
    while at < dims and len(i):
        to = min(at + step, dims)
        # The bound so far less the old suffixes' product, plus the products of the next axes and the new suffixes.
        bound = bound - tx[i, at] * ty[j, at] + np.einsum("ij,ij->i", x[i, at:to], y[j, at:to])
        if to < dims:
            bound = bound + tx[i, to] * ty[j, to]
        keep = bound >= threshold - SLACK
        i, j, bound, at = i[keep], j[keep], bound[keep], to
    keep = np.zeros(len(i), bool)
    for a in range(0, len(i), 1 << 16):
        b = slice(a, a + (1 << 16))
        keep[b] = np.einsum("ij,ij->i", ux[i[b]], uy[j[b]]) >= threshold
    return i[keep], j[keep]


def _matrix(rows: list, k: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(r[k] for r in rows), kind).reshape(len(rows), -1)


def _by_tiles(columns: tuple[str, ...], close):
    """``close(tiles, left rows, right rows)`` for each tile pair of rows sorted by (tiles, side); rows hold ``columns``. A tile with itself has no right rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, held = None, ([], [])
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("tiles", "side", *columns)]
            for own, side, *row in zip(*cols):
                if own != tiles:
                    if held[0]:
                        yield from close(tiles, *held)
                    tiles, held = own, ([], [])
                held[side].append(row)
        if held[0]:
            yield from close(tiles, *held)

    return run


def _may_meet(threshold: float):
    """Rows (tiles, side, key): the vectors whose leading axes allow a partner in the other tile."""

    def close(tiles: str, left: list, right: list) -> Iterator[pa.RecordBatch]:
        x = _matrix(left, 1, np.float32)
        y = _matrix(right, 1, np.float32) if right else x
        one, two = np.zeros(len(x), bool), np.zeros(len(y), bool)
        for a in range(0, len(x), 512):
            hit = x[a : a + 512] @ y.T >= threshold - SLACK
            if not right:
                hit[np.arange(len(hit)), a + np.arange(len(hit))] = False
            one[a : a + 512] = hit.any(1)
            two |= hit.any(0)
        found = [(0, r[0]) for r, k in zip(left, one) if k] + [(1, r[0]) for r, k in zip(right, two) if k]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([tiles] * len(found)), pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int64())], ["tiles", "side", "id"])

    return _by_tiles(("id", "lead"), close)


def _meet(threshold: float):
    """(id, links, other): other spans the links of the tile pair."""

    def close(_: str, left: list, right: list) -> Iterator[pa.RecordBatch]:
        other = right or left
        i, j = compare(_matrix(left, 2, np.float32), _matrix(other, 2, np.float32), _matrix(left, 3, np.float64), _matrix(other, 3, np.float64), threshold)
        if right:
            j = j + len(left)
        else:
            i, j = i[i < j], j[i < j]
        if not len(i):
            return
        rows = left + right
        n = np.array([r[1] for r in rows], np.float64)
        links = np.bincount(i, n[j], len(rows)) + np.bincount(j, n[i], len(rows))
        low, ids = lowest(len(rows), i, j), np.array([r[0] for r in rows])
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(ids[low[some]])], ["id", "links", "other"])

    return _by_tiles(("id", "n", "turned", "unit"), close)


def cosine_links(vectors: DataFrame, threshold: float = 0.95, tile: int = TILE, turned: int = TURNED, hot: int = HOT) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of (vec_id, embedding)."""
    spark, n = vectors.sparkSession, partitions(vectors.sparkSession)
    rows = materialize(vectors.select("vec_id", "embedding").mapInArrow(_prepare, "vec_id long, key binary, dim int, unit binary"), "units")
    good = rows.where("key is not null")
    packed = spark.sparkContext.broadcast(pickle.dumps(_turns(good, turned)))
    classes = good.groupBy("key", "dim").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"), F.first("unit").alias("unit"))
    width = float(np.sqrt(2 - 2 * threshold)) + SLACK
    placed = classes.mapInArrow(_place(packed, width, turned), "key binary, dim int, low long, n long, unit binary, a int, b int, lead binary, turned binary")
    placed = materialize(placed.withColumn("id", F.monotonically_increasing_id()), "placed")
    # Tiles of a cell by a hash; the number of cells is bounded by the width.
    cells = placed.groupBy("dim", "a", "b").agg(F.ceil(F.count("*") / tile).cast("int").alias("r"))
    cell = F.struct("dim", "a", "b").alias("cell")
    tiled = placed.select("id", "lead", "dim", "a", "b").join(cells, ["dim", "a", "b"]).select("id", "lead", cell, F.pmod(F.xxhash64("id"), F.col("r")).cast("int").alias("t"))
    names = cells.select(cell, F.explode(F.sequence(F.lit(0), F.col("r") - 1)).alias("t"))
    # Each two tiles meet once: a cell with itself (t <= u) and with half of its neighbours.
    steps = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
    shifted = names.select("cell", "t", F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in steps))).alias("s"))
    shifted = shifted.select("cell", "t", "s", F.struct(F.col("cell.dim").alias("dim"), (F.col("cell.a") + F.col("s.x")).alias("a"), (F.col("cell.b") + F.col("s.y")).alias("b")).alias("to"))
    right = names.select(F.col("cell").alias("to"), F.col("t").alias("u"))
    meets = shifted.join(right, "to").where("s.x != 0 or s.y != 0 or t <= u").select(F.col("cell").alias("c1"), "t", F.col("to").alias("c2"), "u")
    meets = materialize(meets.select("*", F.concat_ws("|", "c1.dim", "c1.a", "c1.b", "t", "c2.a", "c2.b", "u").alias("tiles")), "meets")
    sides = meets.select("tiles", F.lit(0).alias("side"), F.col("c1").alias("cell"), "t").union(meets.where("not (c1 = c2 and t = u)").select("tiles", F.lit(1).alias("side"), F.col("c2").alias("cell"), F.col("u").alias("t")))
    dealt = tiled.join(sides, ["cell", "t"]).select("tiles", "side", "id", "lead").repartition(n, "tiles").sortWithinPartitions("tiles", "side")
    near = materialize(dealt.mapInArrow(_may_meet(threshold), "tiles string, side int, id long"), "near")
    whole = placed.select("id", "n", "turned", "unit").join(near.hint("shuffle_hash"), "id").repartition(n, "tiles").sortWithinPartitions("tiles", "side")
    found = materialize(whole.select("tiles", "side", "id", "n", "turned", "unit").mapInArrow(_meet(threshold), "id long, links long, other long"), "links")
    node = F.coalesce("low", F.xxhash64("key").bitwiseAND(F.lit(UNNAMED // 2 - 1)) + F.lit(UNNAMED)).alias("node")
    own = placed.select("id", "key", "low", "n", node)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    at = own.select("id", "node")
    edges = found.where("id != other").join(at, "id").select(F.col("node").alias("u"), F.col("other").alias("id")).join(at, "id").select("u", F.col("node").alias("v"))
    component = connected_components(edges, "u", "v")
    named = own.join(links, "id", "left").join(component, "node", "left")
    final = named.select("key", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("c"))
    final = materialize(final.select("key", "n", "n_links", F.when(F.col("c") < UNNAMED, F.col("c")).alias("component_id")), "final")
    # Rows without a vector meet nothing; vectors of over ``hot`` copies are answered in n shares each, the others by their key.
    answer = F.struct("n_links", "component_id").alias("answer")
    shared = final.where(F.col("n") > hot).select("key", answer, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("share"))
    dealt = good.select("vec_id", "key", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("share"))
    first = materialize(dealt.join(shared, ["key", "share"], "left").select("vec_id", "key", "answer"), "copies")
    others = first.where("answer is null").drop("answer").join(final.where(F.col("n") <= hot).select("key", answer), "key", "left").select("vec_id", "answer")
    none = rows.where("key is null").select("vec_id", F.lit(None).cast(first.schema["answer"].dataType).alias("answer"))
    links, low = F.coalesce("answer.n_links", F.lit(0)).cast("long"), F.coalesce("answer.component_id", "vec_id")
    out = first.where("answer is not null").select("vec_id", "answer").union(others).union(none)
    return out.select("vec_id", links.alias("n_links"), low.alias("component_id"), F.coalesce(F.col("vec_id") == low, F.lit(False)).alias("kept"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.95."""
    return cosine_links(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, len(e) AS dim, sqrt(list_dot_product(e, e)) AS norm FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.dim = b.dim AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / a.norm / b.norm >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN c ON c.node = e.vec_id
"""
