"""Ball k-means: a cluster is a ball around its centroid, and a vector is compared only with centroids it could move to.

Another centroid can be nearer to a vector than its own only if it lies within twice the vector's distance of its own. So
the neighbours of a ball are the centroids within twice its radius; a vector nearer to its centroid than half the way to
the first neighbour is in the ball's stable core and stays; one between half the way to the i-th and half the way to the
next neighbour is in the i-th annulus and meets the first i neighbours exactly. Everything is whole numbers, so no vector
is lost to rounding, ties included.

Each round is one pass that assigns and writes the vectors with their cluster, and one that sums them: tasks answer one row
per cluster, and sums of k clusters are all that the driver sees.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persist_shared
from .int_vectors import lists, matrix, whole_vectors


def _squared(v: np.ndarray, center: np.ndarray) -> np.ndarray:
    d = v - center
    return np.einsum("ij,ij->i", d, d)


def neighbours(centers: np.ndarray, radii: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each ball its neighbour centroids, nearest first, and their squared distances."""
    out = []
    for i, c in enumerate(centers):
        far = _squared(centers, c)
        near = [j for j in np.argsort(far, kind="stable") if j != i and far[j] <= (2 * radii[i]) ** 2 * (1 + 1e-9) + 1]
        out.append((np.array(near, dtype=np.int64), far[near] if near else np.zeros(0, dtype=np.int64)))
    return out


def assign_all(v: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, squared distance and centroids compared, against every centroid; the smaller number wins a tie."""
    best, nearest = np.zeros(len(v), dtype=np.int64), _squared(v, centers[0])
    for j in range(1, len(centers)):
        d = _squared(v, centers[j])
        closer = d < nearest
        best[closer], nearest[closer] = j, d[closer]
    return best, nearest, np.full(len(v), len(centers))


def assign_near(v: np.ndarray, own: np.ndarray, centers: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same from each vector's last cluster, by stable core and annuli."""
    best, nearest = own.copy(), np.zeros(len(v), dtype=np.int64)
    compared = np.ones(len(v), dtype=np.int64)
    for i in np.unique(own):
        members = np.flatnonzero(own == i)
        mine = _squared(v[members], centers[i])
        others, far = near[i]
        annulus = np.searchsorted(far, 4 * mine, side="right")  # neighbours with far <= 4 * mine may tie or be nearer
        order = np.argsort(-annulus, kind="stable")
        members, mine, annulus = members[order], mine[order], annulus[order]
        at, least = np.full(len(members), i), mine.copy()
        for t, j in enumerate(others):
            n = np.searchsorted(-annulus, -t, side="left")  # the rows whose annulus is beyond the t-th neighbour
            if not n:
                break
            d = _squared(v[members[:n]], centers[j])
            moves = (d < least[:n]) | ((d == least[:n]) & (j < at[:n]))
            at[:n][moves], least[:n][moves] = j, d[moves]
        best[members], nearest[members], compared[members] = at, least, 1 + annulus
    return best, nearest, compared


def _assigner(centers: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]] | None) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = matrix(b.column("v"), b.num_rows)
            found = assign_all(v, centers) if near is None else assign_near(v, b.column("cluster").to_numpy().astype(np.int64), centers, near)
            cluster, distance, compared = found
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(compared.astype(np.int32))], ["id", "v", "cluster", "distance", "compared"])

    return work


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each cluster of the partition: n, largest squared distance, sum of each component."""
    held: dict[int, list] = {}
    for b in batches:
        if not b.num_rows:
            continue
        v, cluster, distance = matrix(b.column("v"), b.num_rows), b.column("cluster").to_numpy(), b.column("distance").to_numpy()
        for i in np.unique(cluster):
            of = cluster == i
            total = held.setdefault(int(i), [0, 0, np.zeros(v.shape[1], dtype=np.int64)])
            total[0] += int(of.sum())
            total[1] = max(total[1], int(distance[of].max()))
            total[2] += v[of].sum(axis=0)
    if held:
        ids = sorted(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int32()), pa.array([held[i][0] for i in ids], pa.int64()), pa.array([held[i][1] for i in ids], pa.int64()), lists(np.stack([held[i][2] for i in ids]))], ["cluster", "n", "far", "sums"]
        )


def _moved(state: DataFrame, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The new centroids, and a radius for each that no member's distance exceeds."""
    parts = state.select("v", "cluster", "distance").mapInArrow(_sums, "cluster int, n long, far long, sums array<long>")
    totals = parts.select("cluster", "n", "far", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.sum("x").alias("x"))
    moved, radii = centers.copy(), np.zeros(len(centers))
    for r in totals.collect():  # a number for each centroid and component
        moved[r["cluster"], r["i"]] = r["x"] // r["n"]
        radii[r["cluster"]] = math.sqrt(r["far"])
    # From its new centroid a member is no further than from the old one plus the way the centroid went.
    return moved, radii + np.sqrt(((moved - centers).astype(np.float64) ** 2).sum(axis=1))


def first_centers(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The vectors with the smallest sha256 of ``seed:id``; of rows of one id the smaller vector first. A null id is no start."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.where(F.col("id").isNotNull()).select(rank.alias("rank"), "v").orderBy("rank", "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in rows], dtype=np.int64)


def ball_kmeans(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, seed: str = "1") -> tuple[DataFrame, np.ndarray]:
    """(id, v, cluster, distance, compared), and the final centroids: exact Lloyd rounds, a last assignment after them.

    ``v`` is the vector in whole units of 1/scale, ``distance`` squared in those units, ``compared`` the number of centroids
    that the last assignment looked at. Vectors that are null, hold null or non-finite components or don't have ``width``
    of them are left out; rows that repeat are vectors of their own; a null id is assigned, but starts no cluster. Of
    fewer than k rows with an id each starts a cluster, and equal ones tie to the smallest number. Without any there are no
    rows.
    """
    vectors = whole_vectors(df, id_col, vector_col, scale, width)
    centers = first_centers(vectors, k, seed)
    kind = f"id {dict(vectors.dtypes)['id']}, v array<int>, cluster int, distance long, compared int"
    if not len(centers):
        return vectors.where("false").withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long"), "compared": F.lit(0)}), centers
    state = persist_shared(vectors.mapInArrow(_assigner(centers, None), kind), "ball-kmeans")
    for _ in range(rounds):
        centers, radii = _moved(state, centers)
        state = persist_shared(state.mapInArrow(_assigner(centers, neighbours(centers, radii)), kind), "ball-kmeans")
    return state, centers


def cluster_report(df: DataFrame, **how) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256; an inertia beyond 64 bits is null. See ``ball_kmeans``."""
    state, centers = ball_kmeans(df, **how)
    names = state.sparkSession.createDataFrame([(i, ",".join(map(str, c.tolist()))) for i, c in enumerate(centers)], "cluster int, components string")
    by = state.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia")).join(F.broadcast(names), "cluster")  # k rows
    total = state.agg(F.try_sum("distance").alias("inertia"))
    out = state.join(F.broadcast(by), "cluster").crossJoin(F.broadcast(total))  # one row
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", F.sha2("components", 256).alias("centroid_sha256"))
