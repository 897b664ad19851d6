"""Exact clustering of integer vectors round nearest centroids, with adaptive distance bounds.

Each vector keeps an upper bound of the distance to its own centroid, lower bounds of the distances to the next nearest few, and
one lower bound for all the others. When centroids move, the bounds move by as much. A vector whose own centroid is certainly
nearest isn't compared with any; one whose near centroids alone are in question is compared with those; only where the order
can't be certified so is it held against all. The number of near centroids shrinks to what the last round made use of.
Distances that decide are exact integers. Vectors and bounds are a table in the shared folder, written once a round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import binaries, discard, mapped, stored
from tessera.llm.integers import integer_vectors, matrix, squared, summed

DIM, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: Rows that are compared at once.
BLOCK = 4096
#: Share by which bounds are set wider, far more than what doubles may lose.
_SLACK = 1e-12
_STATE = "vec_id long, x binary, was int, cluster int, upper double, near binary, lower binary, used int"


def _roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(float))


def ranked(x: np.ndarray, centroids: np.ndarray, bounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By comparing with all centroids: the nearest (ties: the smaller number), its distance, the next ``bounds``, lower bounds of those and of the rest."""
    squares = squared(x, centroids)
    order = np.argsort(squares, 1, kind="stable")
    root = np.pad(_roots(np.take_along_axis(squares, order, 1)), ((0, 0), (0, 1)), constant_values=np.inf)
    lower = root[:, 1 : bounds + 2]
    return order[:, 0], root[:, 0] * (1 + _SLACK), order[:, 1 : bounds + 1], lower * (1 - _SLACK)


def narrowed(near: np.ndarray, lower: np.ndarray, bounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Near centroids by ascending bound, ``bounds`` of them; what goes joins the rest."""
    order = np.argsort(lower[:, :-1], 1, kind="stable")
    near = np.take_along_axis(near, order, 1)
    each, rest = np.take_along_axis(lower[:, :-1], order, 1), lower[:, -1]
    if each.shape[1] > bounds:
        rest = np.minimum(rest, each[:, bounds])
    return near[:, :bounds], np.column_stack([each[:, :bounds], rest])


def followed(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, ...]:
    """Nearest centroids after these have moved: cluster, upper, near, lower, and how many near centroids were looked at (all: -1)."""
    upper = (upper + moved[cluster]) * (1 + _SLACK)
    shift = np.column_stack([moved[near], np.full(len(x), moved.max(initial=0.0))])
    with np.errstate(invalid="ignore"):
        lower = np.where(np.isinf(lower), np.inf, lower - shift - _SLACK * (np.abs(lower) + shift))
    near, lower = narrowed(near, lower, near.shape[1])
    cluster, used = cluster.copy(), np.zeros(len(x), np.int32)
    open_ = np.flatnonzero(upper >= lower.min(1))
    own = ((x[open_] - centroids[cluster[open_]]) ** 2).sum(1)
    upper[open_] = _roots(own) * (1 + _SLACK)
    still = upper[open_] >= lower[open_].min(1)
    open_, own = open_[still], own[still]
    beyond = upper[open_] >= lower[open_, -1]
    rows, own = open_[~beyond], own[~beyond]
    if len(rows):
        best, best_of, place = own.copy(), cluster[rows].copy(), np.full(len(rows), -1)
        for j in range(near.shape[1]):
            asked = np.flatnonzero(lower[rows, j] <= upper[rows])
            if not len(asked):
                break  # bounds ascend
            other = near[rows[asked], j]
            square = ((x[rows[asked]] - centroids[other]) ** 2).sum(1)
            lower[rows[asked], j] = _roots(square) * (1 - _SLACK)
            used[rows[asked]] = j + 1
            closer = (square < best[asked]) | ((square == best[asked]) & (other < best_of[asked]))
            won = asked[closer]
            best[won], best_of[won], place[won] = square[closer], other[closer], j
        swapped = np.flatnonzero(place >= 0)
        near[rows[swapped], place[swapped]] = cluster[rows[swapped]]
        lower[rows[swapped], place[swapped]] = _roots(own[swapped]) * (1 - _SLACK)
        cluster[rows], upper[rows] = best_of, _roots(best) * (1 + _SLACK)
    rows = open_[beyond]
    if len(rows):
        cluster[rows], upper[rows], near[rows], lower[rows] = ranked(x[rows], centroids, near.shape[1])
        used[rows] = -1
    return cluster, upper, near, lower, used


def _state(ids: pa.Array, x: pa.Array, was: np.ndarray, found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    cluster, upper, near, lower, used = found
    near, lower = np.ascontiguousarray(near.astype("<i4")), np.ascontiguousarray(lower.astype("<f8"))
    sizes = np.ones(len(x), np.int64)
    each = [pa.array(was.astype(np.int32)), pa.array(cluster.astype(np.int32)), pa.array(upper), binaries(near.view(np.uint8).ravel(), 4 * near.shape[1] * sizes), binaries(lower.view(np.uint8).ravel(), 8 * lower.shape[1] * sizes), pa.array(used.astype(np.int32))]
    return pa.RecordBatch.from_arrays([ids, x, *each], ["vec_id", "x", "was", "cluster", "upper", "near", "lower", "used"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, len(batch), BLOCK):
            yield batch.slice(first, BLOCK)


def _first(centroids: np.ndarray, bounds: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            x = matrix(part.column("x"))
            yield _state(part.column("vec_id"), part.column("x"), np.full(len(x), -1), (*ranked(x, centroids, bounds), np.zeros(len(x))))

    return work


def _next(centroids: np.ndarray, moved: np.ndarray, bounds: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            x, was = matrix(part.column("x")), part.column("cluster").to_numpy().astype(np.int64)
            lower = np.frombuffer(b"".join(part.column("lower").to_pylist()), "<f8").reshape(len(x), -1)
            near = np.frombuffer(b"".join(part.column("near").to_pylist()), "<i4").reshape(len(x), lower.shape[1] - 1).astype(np.int64)
            near, lower = narrowed(near, lower, bounds)
            yield _state(part.column("vec_id"), part.column("x"), was, followed(x, was, part.column("upper").to_numpy().copy(), near, lower, centroids, moved))

    return work


def _distances(centroids: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            cluster = part.column("cluster")
            squares = ((matrix(part.column("x")) - centroids[cluster.to_numpy()]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), cluster, pa.array(squares)], ["vec_id", "cluster", "distance"])

    return work


def _moves(clusters: int, dim: int):
    """Adds to a partition's sums what joined a cluster and takes off what left one."""

    def add(sums: np.ndarray, batch: pa.RecordBatch) -> None:
        table = sums.reshape(clusters, dim + 1)
        for part in _blocks([batch]):
            x = np.column_stack([np.ones(len(part), np.int64), matrix(part.column("x"))])
            np.add.at(table, part.column("cluster").to_numpy(), x)
            was = part.column("was").to_numpy()
            np.subtract.at(table, was[was >= 0], x[was >= 0])

    return add


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector with ``dim`` finite components, stored, and the final centroids.

    Components are floor(scale * component), see integer_vectors(). Centroids start as the vectors with the smallest SHA-256 of
    ``1:<vec_id>``; of rows that repeat an id, the one with the smaller bytes comes first, and null ids come last. Each round
    assigns all vectors and puts every centroid that has some to the floor of their mean; they are assigned once more at the end.
    With fewer vectors than clusters each vector is a centroid.
    """
    rows = integer_vectors(vectors, scale).where(F.col("dim") == dim).select("vec_id", "x")
    rows = stored(rows)
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = rows.select("x", key.alias("key")).orderBy(F.col("key").asc_nulls_last(), "x").limit(clusters).collect()
    centroids = matrix(pa.array([bytes(r.x) for r in first], pa.binary()))
    if not len(centroids):
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    most = -(-len(centroids) // 4)
    bounds, least = min(most, len(centroids) - 1), min(-(-len(centroids) // 8), len(centroids) - 1)
    sums = np.zeros(len(centroids) * (dim + 1), np.int64)
    state = stored(mapped(rows, _first(centroids, bounds), _STATE))
    discard(rows)
    for number in range(rounds):
        sums = sums + summed(state.where("was <> cluster").select("x", "was", "cluster"), len(sums), _moves(len(centroids), dim))
        table = sums.reshape(-1, dim + 1)
        means = np.where(table[:, :1] > 0, table[:, 1:] // np.maximum(table[:, :1], 1), centroids)
        moved = _roots(((means - centroids) ** 2).sum(1)) * (1 + _SLACK)
        centroids = means
        if number:
            used = state.agg(F.max("used").alias("most"), F.min("used").alias("least")).first()
            if used.least is not None and used.least >= 0:  # no vector was held against all
                bounds = max(least, min(bounds, used.most))
        following = stored(mapped(state, _next(centroids, moved, bounds), _STATE))
        discard(state)
        state = following
    out = stored(mapped(state.select("vec_id", "x", "cluster"), _distances(centroids), "vec_id long, cluster int, distance long"))
    discard(state)
    return out, centroids


def centroid_clusters(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector with ``dim`` finite components.

    cluster_inertia and inertia are distances summed over the cluster and over all (null where they leave the range of a long),
    centroid_sha256 the lowercase hex digest of the centroid's components, comma-joined. Vectors that are null, of another length
    or with a null or non-finite component are left out; repeated ids are rows of their own; ties go to the smaller number; an
    empty table gives an empty result; extra columns are ignored. See cluster_vectors().
    """
    spark = vectors.sparkSession
    rows, centroids = cluster_vectors(vectors, clusters, rounds, dim, scale)
    digests = [(k, hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()) for k, row in enumerate(centroids)]
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"))
    sums = {r.cluster: int(r.total) for r in sums.collect()}  # a row for each centroid
    fits = lambda total: total if total < 1 << 63 else None
    known = [(k, fits(sums.get(k, 0)), fits(sum(sums.values())), digest) for k, digest in digests]
    known = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
