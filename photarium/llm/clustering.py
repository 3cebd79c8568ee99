"""Centroid clustering of vectors in whole numbers, with geometric drift tightening.

Vectors of exactly ``dimensions`` finite components become integers floor(scale * x). Centroids start
as the vectors with the smallest sha256 of "seed:id". A round assigns every vector to its nearest
centroid (squared Euclidean distance, the smaller number of equals) and moves every centroid that has
vectors to their componentwise floor(sum / count).

Each vector keeps a lower bound on its distance to all centroids but its own. When the centroids have
moved, that bound must be loosened by how much nearer any other centroid can have come, and full drift
is too much for that. All vectors of a cluster lie in a sphere around its old centroid, with the
largest distance as its radius. In the plane through that centre and the line on which another
centroid moved, take the smallest angle between the way it moves and the direction to any place of the
sphere: it is the angle to the centre less the sphere's half-angle, and it only grows along the way.
So the distance shrinks by at most drift times the cosine of that angle, taken piece by piece of the
way (``PIECES``); where a centroid moves away from the whole sphere the bound even rises. A vector
whose exact distance to its own centroid is below its bound, or below half of the way from that
centroid to the next, keeps it. The others are ambiguous and are measured against every centroid.

Distances are exact: products of whole numbers in floating point while every sum stays below 2^53, in
64-bit integers beyond. Bounds are floating point with a margin (``SLACK``) far above their rounding.

A round reads and writes the vectors once and shuffles only a sum, a count and a radius per task and
cluster; the centroids alone pass through the driver, ``k`` x ``dimensions`` numbers. So a hot cluster
or a vector that a third of the rows repeat costs nothing extra, and each round's table stands in the
shared folder for tasks to read again; the one before goes when its successor is written.

Nulls, ties, repeats: null, short, long, and non-finite vectors are left out. A null id draws like
empty text; repeated rows are vectors like others; of equal hashes the smaller vector comes first in
the start. Fewer vectors than ``k`` give as many centroids; none give an empty table. Whole numbers
beyond +-2^27 would let a distance overflow a long: they raise an error. Given columns may have any
name; ``cluster``, ``distance`` and the others that are added replace old ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photarium.llm.common import settle
from photarium.session import drop_path, scratch_path

DIMENSIONS, SCALE = 64, 256
CLUSTERS, ROUNDS, SEED = 40, 5, 2
# Largest whole number of a component.
LIMIT = 1 << 27
# Pieces of a centroid's way whose angles are taken apart.
PIECES = 4
# Part of a bound that rounding may have taken.
SLACK = 1e-9


def whole_vectors(vectors: DataFrame, column: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """The vectors that count: given columns as ``row``, integer components as ``x``."""
    x = F.col(f"`{column}`").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    given = [F.col(f"`{c}`") for c in vectors.columns]
    kept = vectors.filter((F.size(x) == dimensions) & finite)
    return kept.select(F.struct(*given).alias("row"), F.transform(x, lambda v: F.floor(v * scale)).alias("x"))


def starts(rows: DataFrame, key: Column, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The components of the ``k`` vectors with the smallest hash of seed and id."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    first = rows.select(draw.alias("draw"), "x").orderBy("draw", "x").limit(k).collect()
    return np.array([r["x"] for r in first], dtype=np.int64)


def squared(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all centres."""
    reach = max(np.abs(x).max(initial=0), np.abs(centers).max(initial=0))
    if 4 * int(reach) ** 2 * x.shape[1] < 1 << 53:
        a, c = x.astype(np.float64), centers.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centers], axis=1)


def squared_to_own(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distance of each vector to the centre beside it."""
    difference = x - centers
    return np.einsum("ij,ij->i", difference, difference)


def scan(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centre, its squared distance, and a bound below the distance to all others."""
    every = squared(x, centers)
    own = every.argmin(1)
    at = np.arange(len(x))
    best = every[at, own]
    every[at, own] = np.iinfo(np.int64).max
    return own, best, np.sqrt(every.min(1).astype(np.float64)) * (1 - SLACK)


def nearing(old: np.ndarray, new: np.ndarray, radius: np.ndarray, pieces: int = PIECES) -> np.ndarray:
    """For each cluster, the most by which any other centre can have come nearer to a vector of its sphere.

    Negative where all others moved away. ``radius`` is 0 or more; spheres are around ``old``.
    """
    old, new = old.astype(np.float64), new.astype(np.float64)
    way = new - old
    drift = np.sqrt((way * way).sum(1))
    nearer = np.zeros((len(old), len(old)))
    for piece in range(pieces):
        place = old + way * (piece / pieces)
        to_sphere = old[:, None, :] - place[None, :, :]
        far = np.sqrt((to_sphere * to_sphere).sum(2))
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.clip(np.einsum("ijk,jk->ij", to_sphere, way) / (far * drift), -1, 1)
            angle = np.arccos(cosine) - np.arcsin(np.minimum(radius[:, None] / far, 1))
        inside = ~(far > radius[:, None]) | ~np.isfinite(angle)
        nearer += drift * np.where(inside, 1.0, np.cos(np.maximum(angle, 0.0))) / pieces
    np.fill_diagonal(nearer, -np.inf)
    # Rounding of the arc functions is worst near full drift, which it cannot pass.
    size = np.sqrt(np.maximum((old * old).sum(1), (new * new).sum(1)).max(initial=0.0))
    return nearer.max(1, initial=-np.inf) + 1e-6 * drift.max(initial=0.0) + SLACK * size


def half_way(centers: np.ndarray) -> np.ndarray:
    """Half of the distance from each centre to the next one."""
    every = squared(centers, centers)
    np.fill_diagonal(every, np.iinfo(np.int64).max)
    return np.sqrt(every.min(1, initial=np.iinfo(np.int64).max).astype(np.float64)) / 2 * (1 - SLACK)


def _components(batch: pa.RecordBatch) -> np.ndarray:
    """Components of a batch, from lists or from the bytes that rounds pass on."""
    column = batch.column("x")
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy().reshape(len(column), -1)
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").reshape(len(column), -1).astype(np.int64)


def _as_bytes(x: np.ndarray) -> pa.Array:
    """A binary value per vector: Spark writes and reads it far faster than an array."""
    width = 4 * x.shape[1]
    ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * width)
    return pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, ends.buffers()[1], pa.py_buffer(x.astype("<i4").tobytes())])


def _batch(batch: pa.RecordBatch, x: np.ndarray, cluster: np.ndarray, distance: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [batch.column("row"), _as_bytes(x), pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(bound)],
        names=["row", "x", "cluster", "distance", "bound"],
    )


def _assign(centers: np.ndarray, least: np.ndarray | None = None, loosened: np.ndarray | None = None):
    """Assigns batches; with a bound per cluster and its loosening only the ambiguous vectors are scanned."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = _components(batch)
            if np.abs(x).max(initial=0) > LIMIT:
                raise ValueError(f"a component beyond {LIMIT} after scaling")
            if least is None:
                yield _batch(batch, x, *scan(x, centers))
                continue
            cluster = batch.column("cluster").to_numpy().astype(np.int64)
            bound = batch.column("bound").to_numpy() - loosened[cluster]
            distance = squared_to_own(x, centers[cluster])
            ambiguous = np.sqrt(distance.astype(np.float64)) * (1 + SLACK) >= np.maximum(bound, least[cluster])
            if ambiguous.any():
                cluster[ambiguous], distance[ambiguous], bound[ambiguous] = scan(x[ambiguous], centers)
            yield _batch(batch, x, cluster, distance, bound)

    return assign


def _sums(k: int, dimensions: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per cluster of a task: sums of the components, count, largest distance, sum of distances."""
        total, count = np.zeros((k, dimensions), dtype=np.int64), np.zeros(k, dtype=np.int64)
        far, inertia = np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, cluster, distance = _components(batch), batch.column("cluster").to_numpy(), batch.column("distance").to_numpy()
            order = np.argsort(cluster, kind="stable")
            found, first = np.unique(cluster[order], return_index=True)
            total[found] += np.add.reduceat(x[order], first, axis=0)
            count[found] += np.diff(np.append(first, len(order)))
            far[found] = np.maximum(far[found], np.maximum.reduceat(distance[order], first))
            inertia[found] += np.add.reduceat(distance[order], first)
        found = np.flatnonzero(count)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * dimensions, pa.int32()), pa.array(total[found].ravel()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.astype(np.int32)), lists, pa.array(count[found]), pa.array(far[found]), pa.array(inertia[found])],
            names=["cluster", "total", "count", "far", "inertia"],
        )

    return sums


def totals(assigned: DataFrame, k: int, dimensions: int) -> list:
    """Per cluster with vectors: sums of its components, count, largest and summed distance; at most ``k`` rows."""
    parts = assigned.select("x", "cluster", "distance").mapInArrow(
        _sums(k, dimensions), "cluster int, total array<bigint>, count bigint, far bigint, inertia bigint"
    )
    components = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(dimensions)]
    return parts.groupBy("cluster").agg(
        F.array(*components).alias("total"), F.sum("count").alias("count"), F.max("far").alias("far"), F.sum("inertia").alias("inertia")
    ).collect()


def _written(rows: DataFrame, step, before: str | None) -> tuple[DataFrame, str]:
    """One round's assignment, as a table that takes the place of the one before."""
    spark: SparkSession = rows.sparkSession
    path = scratch_path(spark, "clusters")
    schema = rows.select("row").schema.add("x", "binary").add("cluster", "integer").add("distance", "long").add("bound", "double")
    table = settle(rows.mapInArrow(step, schema), "clusters", path)
    if before:
        drop_path(spark, before)
    return table, path


def cluster(
    vectors: DataFrame, key: str, column: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS,
    seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray, list]:
    """Assigned vectors (``row`` with the given columns, ``cluster``, ``distance``), the final centroids, and each cluster's totals."""
    rows = whole_vectors(vectors, column, dimensions, scale)
    centers = starts(rows, F.col(f"row.`{key}`"), k, seed)
    if not len(centers):
        none = rows.select("row", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
        return none.limit(0), np.zeros((0, dimensions), dtype=np.int64), []
    assigned, path = _written(rows, _assign(centers), None)
    found = totals(assigned, len(centers), dimensions)
    for _ in range(rounds):
        old, centers, radius = centers, centers.copy(), np.zeros(len(centers))
        for r in found:
            centers[r["cluster"]] = [t // r["count"] for t in r["total"]]
            radius[r["cluster"]] = np.sqrt(float(r["far"])) * (1 + SLACK)
        step = _assign(centers, half_way(centers), nearing(old, centers, radius))
        assigned, path = _written(assigned, step, path)
        found = totals(assigned, len(centers), dimensions)
    return assigned.drop("x", "bound"), centers, found


def digest(vectors: DataFrame) -> DataFrame:
    """Cluster, distance and inertia of all vectors, with a checksum of each final centroid."""
    assigned, centers, found = cluster(vectors.select("vec_id", "embedding"), "vec_id")
    sums = {r["cluster"]: int(r["inertia"]) for r in found}
    checks = [sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centers]
    at = F.col("cluster") + 1
    listed = lambda values, kind: F.array(*map(F.lit, values)).cast(f"array<{kind}>")
    return assigned.select(
        F.col("row.vec_id").alias("vec_id"), "cluster", "distance",
        F.try_element_at(listed([sums.get(i, 0) for i in range(len(centers))], "bigint"), at).alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("bigint").alias("inertia"),
        F.try_element_at(listed(checks, "string"), at).alias("centroid_sha256"),
    )
