"""Centroid clustering of vectors with lower bounds from Ptolemy's inequality.

For points q, c and pivots a, b of a Euclidean space, d(q,c) * d(a,b) is at least
|d(q,a) * d(c,b) - d(q,b) * d(c,a)|.  Pivots are the centroids of an early round: each centroid is
bounded by fixed pairs of the pivot nearest to it and of pivots far from that one.  The distances of
all vectors to the pivots are computed once and written with the vectors; a round computes those of
the centroids.  Centroids whose bound exceeds an exact distance are out; all others are compared
exactly, in whole numbers.  Bounds are lowered by more than the rounding error of their
floating-point terms, so they never drop a nearest centroid.

Vectors stay in the shared folder.  A task sends one row of sums per cluster, and only the centroids
(``k`` rows) reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbitra.llm.tables import written

#: Components up to this size keep every squared distance within 64 bits at up to 64 components.
LARGEST = 1 << 27
#: Pivots at most, and the pairs that bound each centroid.
PIVOTS, PAIRS = 64, 8
#: Relative error allowed for each term of a bound: distances to pivots are kept as 32-bit floats.
SLACK = 4e-7
#: Bounds held at once by a task.
BLOCK = 1 << 20


def whole_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, v: rows of exactly ``dims`` finite components x as whole numbers floor(scale * x)."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    kept = vectors.where((F.size(vector_col) == dims) & finite)
    return kept.select(F.col(id_col).alias("id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def seeds(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ``seed:id`` has the smallest SHA-256, in that order.

    A null id counts as an empty string; rows of one id follow their components.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in kept.orderBy(key, "v").limit(k).collect()], dtype=np.int64)


def far_apart(points: np.ndarray, n: int) -> np.ndarray:
    """Up to n of the points, each the farthest from those taken before it; no two are equal."""
    taken = [0]
    while len(taken) < n:
        nearest = ((points[:, None] - points[taken]) ** 2).sum(2).min(1)
        if not nearest.max():
            break
        taken.append(int(nearest.argmax()))
    return points[taken]


def distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Distances of each point to each other one: roots of exact whole numbers."""
    return np.sqrt(np.stack([((points - o) ** 2).sum(1) for o in others], axis=1).astype(np.float64))


def ptolemaic_bounds(to_pivots: np.ndarray, centroids_to_pivots: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Lower bounds of squared distances, points by centroids; 0 where there is no pair of pivots."""
    low = np.zeros((len(to_pivots), len(centroids_to_pivots)))
    every = np.arange(len(centroids_to_pivots))
    near = centroids_to_pivots.argmin(1)
    far = np.argsort(-apart[near], axis=1, kind="stable")[:, : min(PAIRS, len(apart) - 1)]
    to_near = to_pivots[:, near]
    for other in far.T:
        one = to_pivots[:, other] * centroids_to_pivots[every, near]
        two = to_near * centroids_to_pivots[every, other]
        bound = np.abs(one - two)
        bound -= SLACK * (one + two)
        bound *= (1 - SLACK) / apart[near, other]
        np.maximum(low, bound, out=low)
    low *= low
    return low


def nearest(points: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and exact squared distance of each point's nearest centroid (ties: the smaller number),
    and how many distances were computed."""
    n, checked = len(points), 0
    label, best = np.zeros(n, np.int64), np.empty(n, np.int64)
    of_centroids, apart = distances(centroids, pivots), distances(pivots, pivots)
    step = max(1, BLOCK // len(centroids))
    for at in range(0, n, step):
        some = slice(at, at + step)
        q, lab, dist = points[some], label[some], best[some]
        low = ptolemaic_bounds(to_pivots[some], of_centroids, apart)
        guess = low.argmin(1)
        dist[:] = ((q - centroids[guess]) ** 2).sum(1)
        lab[:] = guess
        checked += len(q)
        for c, centroid in enumerate(centroids):
            left = np.flatnonzero((low[:, c] <= dist) & (guess != c))
            if len(left):
                exact = ((q[left] - centroid) ** 2).sum(1)
                closer = (exact < dist[left]) | ((exact == dist[left]) & (c < lab[left]))
                dist[left[closer]], lab[left[closer]] = exact[closer], c
                checked += len(left)
    return label, best, checked


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def with_pivots(kept: DataFrame, pivots: np.ndarray) -> DataFrame:
    """id, v, to_pivots: the distances that the next rounds use."""

    def cached(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(1), np.int64)
            if np.abs(v).max() > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST}: its squared distances leave 64 bits")
            d = distances(v, pivots)
            at = pa.array(np.arange(len(v) + 1) * d.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(at, pa.array(d.ravel().astype(np.float32)))], ["id", "v", "to_pivots"])

    return kept.select("id", "v").mapInArrow(cached, f"id {kept.schema['id'].dataType.simpleString()}, v array<long>, to_pivots array<float>")


def _totals(centroids: np.ndarray, pivots: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(0), np.int64)
                label, _, _ = nearest(v, _matrix(batch.column(1), np.float64), centroids, pivots)
                counts += np.bincount(label, minlength=len(centroids))
                for c in np.unique(label):
                    sums[c] += v[label == c].sum(0)
        full = np.flatnonzero(counts)
        if len(full):
            yield pa.RecordBatch.from_arrays(
                [pa.array(full), pa.array(counts[full]), pa.array(sums[full].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"]
            )

    return totals


def moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor of sum by count, empty ones as they were."""
    parts = table.select("v", "to_pivots").mapInArrow(_totals(centroids, pivots), "cluster long, n long, sums array<long>")
    added = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[j].cast("decimal(38,0)")) for j in range(centroids.shape[1])]).alias("sums")
    )
    out = centroids.copy()
    for r in added.collect():
        out[r.cluster] = [int(s) // r.n for s in r.sums]
    return out


def clusters(
    vectors: DataFrame, k: int, rounds: int, dims: int, scale: int = 256, seed: int = 2, n_pivots: int = PIVOTS,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """(one row per kept vector: id, cluster, distance; the final centroids).

    Rows whose vector is null, of another length or with a null or non-finite component are left
    out.  Repeated rows and ids count each by itself; a null id stays null.  Fewer than k kept
    vectors give so many centroids, none an empty result.  A component beyond ``LARGEST`` after scaling
    is an error.  Other columns are ignored, whatever their names.
    """
    kept = whole_vectors(vectors, dims, scale, id_col, vector_col)
    centroids = seeds(kept, k, seed)
    kind = kept.schema["id"].dataType.simpleString()
    if not len(centroids):
        return kept.where("false").select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    table = kept
    for r in range(rounds + 1):
        # Centroids move most at first; later ones stay near their pivots for longer.
        if r < 2 or r % 3 == 0:
            pivots = far_apart(centroids, n_pivots)
            table = written(with_pivots(table, pivots))
        if r < rounds:
            centroids = moved(table, centroids, pivots)

    def assigned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                label, best, _ = nearest(_matrix(batch.column(1), np.int64), _matrix(batch.column(2), np.float64), centroids, pivots)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label), pa.array(best)], ["id", "cluster", "distance"])

    found = table.mapInArrow(assigned, f"id {kind}, cluster long, distance long")
    return written(found).withColumnRenamed("id", id_col), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256; the table joined has a row per cluster."""
    spark = assigned.sparkSession
    sums = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    rows = [
        (c, sums.get(c, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest())
        for c, centroid in enumerate(centroids.tolist())
    ]
    per_cluster = spark.createDataFrame(rows, "cluster long, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(per_cluster), "cluster")
