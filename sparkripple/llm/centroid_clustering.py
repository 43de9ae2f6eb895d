"""Centroid clustering of vectors by Lloyd's rounds over weighted distinct vectors.

Method: weighted deduplication. Vectors are quantised to whole numbers and equal
ones grouped with their multiplicity first, so a vector that a third of all rows
hold costs one row from there on. Every round assigns the distinct vectors to
their nearest centroid and adds up weight times vector in whole numbers, so the
sums don't depend on any order; a task hands on one row per centroid. At the end
the assignments are joined back to the ids.

The first centroids are the vectors whose ids have the least hashes. Distances are
squared Euclidean, exact; of equally near centroids the smaller number is taken.
A centroid without vectors stays. Only the centroids, `clusters` rows, go through
the driver. The distinct vectors are written once and read every round.

Vectors that are null, of another length, or hold null or non-finite components
are left out. Rows without an id take part, but come last as first centroids; of
repeated ids every row is a vector of its own. Fewer vectors than centroids give
fewer centroids, an empty table no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkripple.llm.common import cut
from sparkripple.llm.vectors import EXACT, is_sound, largest, matrix, quantised

CLUSTERS = 40
ROUNDS = 5
DIM = 64
SEED = "2"
#: Vectors that more than one row in so many holds are joined by broadcast; by that share there are at most so many.
HEAVY = 1000


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid of each row, in exact whole numbers."""
    if 4 * x.shape[1] * max(largest(x), largest(centroids)) ** 2 < EXACT:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        far = (a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)
    else:
        far = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    own = far.argmin(axis=1)
    return own, far[np.arange(len(x)), own].astype(np.int64)


def weighted_sums(centroids: np.ndarray):
    """Per task the weight and the weighted sum of the vectors nearest to each centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros(len(centroids), dtype=np.int64)
        sums = np.zeros(centroids.shape, dtype=np.int64)
        for batch in batches:
            x = matrix(batch.column("v"), centroids.shape[1])
            n = batch.column("n").to_numpy()
            own, _ = nearest(x, centroids)
            for j in np.unique(own):
                at = own == j
                weight[j] += n[at].sum()
                sums[j] += (x[at] * n[at, None]).sum(axis=0)
        used = np.flatnonzero(weight)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(weight[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def assignments(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, far = nearest(matrix(batch.column("v"), centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("n"), pa.array(own, pa.int32()), pa.array(far)], ["v", "n", "cluster", "distance"])

    return run


def lloyd(distinct: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """The centroids after so many rounds over distinct(v, n), which should be a table."""
    dim = centroids.shape[1]
    for _ in range(rounds):
        parts = distinct.mapInArrow(weighted_sums(centroids), "cluster int, n long, sums array<long>")
        total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(dim))).alias("sums"))
        centroids = centroids.copy()
        for r in total.collect():
            centroids[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    return centroids


def joined(rows: DataFrame, assigned: DataFrame, total: int, most: int) -> DataFrame:
    """rows(vec_id, v) with the cluster and distance of assigned(v, n, ...); vectors that many rows hold don't go through the shuffle."""
    found = assigned.select("v", "cluster", "distance")
    if most * HEAVY <= total:
        return rows.join(found, "v")
    heavy = F.broadcast(assigned.filter(F.col("n") * HEAVY > total).select("v", "cluster", "distance"))
    light = assigned.filter(F.col("n") * HEAVY <= total).select("v", "cluster", "distance")
    return rows.join(heavy, "v").unionByName(rows.join(heavy, "v", "left_anti").join(light, "v"))


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid."""
    own = vectors.filter(is_sound("embedding", dim))
    rows = own.select(F.col("vec_id").cast("long").alias("vec_id"), quantised("embedding").alias("v"))
    order = F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")).cast("binary"), 256).asc_nulls_last()
    first = rows.orderBy(order, "v").limit(clusters).collect()
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>"
    if not first:
        return vectors.sparkSession.createDataFrame([], out)
    distinct = cut(rows.groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    total, most = distinct.agg(F.sum("n"), F.max("n")).first()
    centroids = lloyd(distinct, np.array([r["v"] for r in first], dtype=np.int64), rounds)
    assigned = cut(distinct.mapInArrow(assignments(centroids), "v array<int>, n long, cluster int, distance long"))
    per = {r["cluster"]: int(r["inertia"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("n")).alias("inertia")).collect()}
    said = [",".join(map(str, c)) for c in centroids.tolist()]
    of = [F.element_at(F.lit(x), F.col("cluster") + 1) for x in ([per.get(j, 0) for j in range(len(said))], [hashlib.sha256(s.encode()).hexdigest() for s in said], said)]
    found = joined(rows, assigned, total, most)
    return found.select("vec_id", "cluster", "distance", of[0].cast("long").alias("cluster_inertia"), F.lit(sum(per.values())).cast("long").alias("inertia"), of[1].alias("centroid_sha256"), F.split(of[2], ",").cast("array<long>").alias("centroid"))
