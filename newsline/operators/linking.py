"""Linking stories to arcs over days, in parallel blocks with the result of one sequential pass.

A story of s entities links only where it shares at least j * s of them (j: the lowest Jaccard),
so at least one of its s - ceil(j * s) + 1 rarest; and no member of the arc has more than s / j
entities. Blocks are the components of such pairs, so a common entity joins nothing unless a
story could link by it alone. Each block is read in order, worst severity first, and only its
arcs are held. Stories without entities always seed and need no Python.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsline.plans.components import connected_components
from newsline.plans.storage import materialize, partitions

MIN_COSINE, MIN_JACCARD = 0.55, 0.4


class Linker:
    """The arcs so far; each story meets only the arcs that share an entity with it."""

    def __init__(self, min_cosine: float, min_jaccard: float):
        self.min_cosine, self.min_jaccard = min_cosine, min_jaccard
        self.arcs: list[list] = []
        self.by_entity: dict[str, list[int]] = {}

    def add(self, name: str, entities, vector, n: int) -> None:
        at = len(self.arcs)
        self.arcs.append([name, set(entities), np.array(vector, float), n])
        for e in self.arcs[at][1]:
            self.by_entity.setdefault(e, []).append(at)

    def link(self, name: str, entities, vector) -> str:
        own, v = set(entities), np.asarray(vector, float)
        best, pick = -2.0, None
        shared = Counter(at for e in own for at in self.by_entity.get(e, ()))
        length = np.linalg.norm(v)
        for at in sorted(shared):
            arc = self.arcs[at]
            if shared[at] / (len(own) + len(arc[1]) - shared[at]) < self.min_jaccard:
                continue
            size = np.linalg.norm(arc[2]) * length
            like = float(arc[2] @ v / size) if size else 0.0
            if like >= self.min_cosine and like > best:
                best, pick = like, at
        if pick is None:
            self.add(f"new:{name}", own, v, 1)
            return f"new:{name}"
        arc = self.arcs[pick]
        for e in own - arc[1]:
            self.by_entity.setdefault(e, []).append(pick)
        arc[1] |= own
        arc[2] = arc[2] + v
        arc[3] += 1
        return arc[0]


def link_in_order(clusters: list[tuple], arcs: list[tuple], min_cosine: float = MIN_COSINE, min_jaccard: float = MIN_JACCARD) -> list[tuple[str, str]]:
    """(cluster, arc) for (id, entities, vector) in order against (id, entities, sum vector, n); an arc seeded by cluster c is named ``new:c``.

    The arc with the highest cosine among those passing both tests wins, ties to the first; each link changes the arc.
    """
    linker = Linker(min_cosine, min_jaccard)
    for arc in arcs:
        linker.add(*arc)
    return [(name, linker.link(name, entities, vector)) for name, entities, vector in clusters]


def linkable_parts(clusters: DataFrame, arcs: DataFrame, min_jaccard: float) -> DataFrame:
    """(node, component): stories ``c:id`` and arcs ``a:id`` that may come to share an arc; arcs that no story can link to may be missing."""
    c = clusters.select(F.concat(F.lit("c:"), "cluster_id").alias("node"), F.array_distinct("entities").alias("es"))
    a = arcs.select(F.concat(F.lit("a:"), "id").alias("node"), F.array_distinct("entities").alias("es"))
    rows = materialize(c.union(a).select("node", F.size("es").alias("size"), F.explode("es").alias("e")), "named")
    ranked = rows.where("node like 'c:%'").join(rows.groupBy("e").count(), "e").withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy("count", "e")))
    needed = F.greatest(F.lit(1), F.ceil(F.col("size") * min_jaccard - 1e-9))
    meets = ranked.where(F.col("_r") <= F.col("size") - needed + 1).groupBy("e").agg(F.max("size").alias("most"))
    edges = rows.join(meets, "e").where(F.col("size") * min_jaccard <= F.col("most") + 1e-9)
    return connected_components(edges.select("node", F.concat(F.lit("e:"), "e").alias("e")), "node", "e")


def link_arcs(clusters: DataFrame, arcs: DataFrame, min_cosine: float = MIN_COSINE, min_jaccard: float = MIN_JACCARD) -> DataFrame:
    """(cluster_id, arc_id): arc_id is an existing arc's or ``new:`` and the seeding cluster.

    ``clusters``: cluster_id, severity, created_at, entities (stop entities dropped), vector; ``arcs``: id,
    entities, vector (sum over its linked clusters) and n. Order: severity, created_at, cluster_id.
    """
    parts = linkable_parts(clusters, arcs, min_jaccard)
    left = clusters.join(parts.select(F.expr("substring(node, 3)").alias("cluster_id"), "component").where("node like 'c:%'"), "cluster_id")
    right = arcs.join(parts.select(F.expr("substring(node, 3)").alias("id"), "component").where("node like 'a:%'"), "id")
    rows = left.select("component", F.lit(1).alias("side"), F.col("cluster_id").alias("id"), "severity", "created_at", "entities", F.col("vector").cast("array<double>").alias("vector"), F.lit(1).alias("n")).unionByName(
        right.select("component", F.lit(0).alias("side"), "id", F.lit(0).alias("severity"), F.lit(None).cast("timestamp").alias("created_at"), "entities", F.col("vector").cast("array<double>").alias("vector"), F.col("n").cast("int").alias("n"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, linker = None, None
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                if r["component"] != at:
                    at, linker = r["component"], Linker(min_cosine, min_jaccard)
                if r["side"]:
                    found.append((r["id"], linker.link(r["id"], r["entities"], r["vector"])))
                else:
                    linker.add(r["id"], r["entities"], r["vector"], r["n"])
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], ["cluster_id", "arc_id"])

    ordered = rows.repartition(partitions(rows.sparkSession), "component").sortWithinPartitions("component", "side", F.asc_nulls_last("severity"), F.asc_nulls_last("created_at"), "id")
    linked = ordered.mapInArrow(run, "cluster_id string, arc_id string")
    bare = clusters.where(F.coalesce(F.size("entities"), F.lit(0)) <= 0).select("cluster_id", F.concat(F.lit("new:"), "cluster_id").alias("arc_id"))
    return linked.union(bare)
