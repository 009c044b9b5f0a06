"""Clustering around centroids in exact integers, with the threshold algorithm as nearest-centroid search.

For each dimension the centroids are sorted by their value there. A vector enters each list at its
own value and walks outward, always to the nearer side, one centroid in each list at a step. A
centroid met for the first time is measured exactly. What is not met yet differs in each dimension
by no less than the frontier, the difference last walked over; when the sum of the frontiers'
squares strictly exceeds the best exact distance, no centroid left can be nearer or tie, and the
vector is done. A whole batch of vectors walks at once; those that are done leave it.

A round sends one row of sums for each task, cluster and dimension to the shuffle, so clusters may
be of any size. The driver gets the centroids: ``k`` times ``dims`` integers.

Defined results: vectors that are null or not of ``dims`` components, or hold null or non-finite
ones, are left out. A component is floor(scale * x), held inside +-2^27, so that a squared distance
fits 64 bits; sums of distances stop at 2^63 - 1. The first centroids are the ``k`` vectors whose
hash is smallest, all of them if there are fewer; a null vec_id is hashed as an empty one, and rows
that share a vec_id follow in the order of their components. Ties between centroids go to the
smaller number, an empty cluster keeps its centroid. Rows that repeat are clustered each. An empty
table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.util import materialize

CENTROIDS, ROUNDS, SCALE, DIMS, SEED = 16, 3, 64, 64, 1
LIMIT = 1 << 27
_MOST = (1 << 63) - 1


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, q): the vectors that are clustered, in integers."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))  # NaN is above every number
    rows = rows.filter(F.col("v").isNotNull()).filter((F.size("v") == dims) & F.coalesce(sound, F.lit(False)))
    held = lambda c: F.greatest(F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)), c * scale))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(held(c)).cast("int")).alias("q"))


def first_centroids(whole: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of seed and vec_id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    top = whole.select(F.sha2(name, 256).alias("hash"), "q").orderBy("hash", "q").limit(k).collect()
    return np.array([r.q for r in top], np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row of ``x``, by the threshold algorithm."""
    k, dims = centroids.shape
    order = np.argsort(centroids, axis=0, kind="stable")  # of each dimension, centroids by value
    lists = np.take_along_axis(centroids, order, 0)
    best, where = np.full(len(x), _MOST), np.zeros(len(x), np.int64)
    rows, dim = np.arange(len(x)), np.arange(dims)
    right = np.stack([np.searchsorted(lists[:, d], x[:, d]) for d in range(dims)], axis=1)  # next on either side
    left, seen = right - 1, np.zeros((len(x), k), bool)
    for _ in range(k):
        if not len(rows):
            break
        at = x[rows]
        below = np.where(left >= 0, at - lists[np.maximum(left, 0), dim], _MOST)
        above = np.where(right < k, lists[np.minimum(right, k - 1), dim] - at, _MOST)
        down = below <= above
        frontier = np.where(down, below, above)
        met = np.zeros((len(rows), k), bool)
        np.put_along_axis(met, order[np.where(down, left, right), dim], True, axis=1)
        i, c = np.nonzero(met & ~seen)
        seen |= met
        distance = np.square(at[i] - centroids[c]).sum(1)
        for j in np.unique(c):  # centroids by number, so a tie stays with the smaller one
            here = rows[i[c == j]]
            d = distance[c == j]
            won = (d < best[here]) | ((d == best[here]) & (j < where[here]))
            best[here[won]], where[here[won]] = d[won], j
        left, right = left - down, right + ~down
        open_ = np.square(frontier).sum(1) <= best[rows]
        rows, left, right, seen = rows[open_], left[open_], right[open_], seen[open_]
    return where, best


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def moved_centroids(whole: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid moved to the floor of the mean of its vectors; empty ones stay."""
    k, dims = centroids.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            cluster, _ = nearest(x, centroids)
            counts += np.bincount(cluster, minlength=k)
            np.add.at(sums, cluster, x)
        met = np.repeat(np.flatnonzero(counts), dims)
        columns = [met, np.tile(np.arange(dims), len(met) // dims), sums[counts > 0].ravel(), counts[met]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cluster", "dim", "total", "n"])

    parts = whole.select("q").mapInArrow(run, "cluster bigint, dim bigint, total bigint, n bigint")
    added = parts.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in added.collect():
        out[r.cluster, r.dim] = int(r.total) // r.n
    return out


def assigned(whole: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of each vector."""
    dims = centroids.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = nearest(_matrix(batch.column(1), dims), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return whole.select("vec_id", "q").mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """One row per clustered vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    whole = materialize(whole_vectors(vectors, id_col, vec_col, dims, scale))
    centroids = first_centroids(whole, k, seed)
    if not len(centroids):
        return whole.select(F.col("vec_id").alias(id_col), *[F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string"))])
    for _ in range(rounds):
        centroids = moved_centroids(whole, centroids)
    rows = materialize(assigned(whole, centroids))
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # k rows at most
    names = {i: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for i, c in enumerate(centroids)}
    inertia = min(_MOST, sum(int(r.d) for r in sums))
    facts = vectors.sparkSession.createDataFrame([(r.cluster, min(_MOST, int(r.d)), inertia, names[r.cluster]) for r in sums], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select(F.col("vec_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
