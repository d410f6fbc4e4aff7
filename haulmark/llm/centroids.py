"""Centroid clustering in whole numbers, with distances to fixed pivots that spare most other distances.

LAESA: the distances of every vector to a few pivots are computed once and stored beside it. In each round the
driver works out the distances of the (few) centroids to the same pivots. By the triangle inequality a vector is at least
``|d(vector, pivot) - d(centroid, pivot)|`` away from a centroid, for each pivot; centroids are taken by the largest such
bound, smallest first, and only those whose bound does not exceed the best distance found get an exact one. Bounds carry a
margin far above the rounding of doubles, so none that could win or tie is left out.

Assignments and sums are made in tasks, one row of sums for each centroid and task is shuffled, and the driver holds nothing but
centroids, pivots and one row for each centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.llm.common import materialize

#: Components of this size or more would let squared distances leave 64 bits; vectors that hold one are left out.
TOO_LARGE = 2**27
#: What bounds are loosened by, relatively and absolutely; doubles are off by less than a millionth of it.
MARGIN, LEAST_MARGIN = 1e-9, 1e-3


def whole_vectors(vectors: DataFrame, dims: int, scale: int, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """``key`` and ``whole``, the components times ``scale`` rounded down, of vectors that have all ``dims`` components.

    Left out are vectors that are null, have another length, hold a null, NaN or infinite component, or one that is
    ``TOO_LARGE`` after scaling. Keys may be null and may repeat; each row is a vector of its own.
    """
    number = F.transform(value, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    fit = F.forall(value, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(TOO_LARGE / scale)) & ~F.isnan(x))
    return vectors.filter((F.size(value) == dims) & fit).select(key, F.transform(number, lambda x: x.cast("int")).alias("whole"))


def hash_order(key: str = "vec_id", salt: int = 3) -> Column:
    """Lower-case hexadecimal SHA-256 of ``salt:key``; null keys have none."""
    return F.sha2(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string")), 256)


def spread_out(vectors: np.ndarray, count: int) -> np.ndarray:
    """At most ``count`` of the vectors, each the one farthest from those before; equal ones only once."""
    chosen = vectors[:1]
    far = ((vectors - chosen[0]) ** 2).sum(1, dtype=np.float64) if len(vectors) else np.zeros(0)
    while len(far) and len(chosen) < count and far.max() > 0:
        chosen = np.vstack([chosen, vectors[far.argmax()]])
        far = np.minimum(far, ((vectors - chosen[-1]) ** 2).sum(1, dtype=np.float64))
    return chosen


def pivot_distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of each vector (rows) to each pivot (columns)."""
    return np.sqrt(np.stack([((vectors - p) ** 2).sum(1) for p in pivots], 1).astype(np.float64))


def nearest(vectors: np.ndarray, stored: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each vector (the smaller number of equals), its exact squared distance, and exact distances made."""
    count = len(vectors)
    marks = pivot_distances(centroids, pivots)
    bound = np.zeros((count, len(centroids)))
    for j in range(len(pivots)):
        np.maximum(bound, np.abs(stored[:, j:j + 1] - marks[:, j]), out=bound)
    order = bound.argsort(1, kind="stable")
    best = np.full(count, np.iinfo(np.int64).max)
    owner = np.full(count, len(centroids), np.int64)
    rows, made = np.arange(count), 0
    for place in range(len(centroids)):
        # Bounds only grow along the order: a row whose bound passes its best distance is done.
        rows = rows[bound[rows, order[rows, place]] <= np.sqrt(best[rows].astype(np.float64)) * (1 + MARGIN) + LEAST_MARGIN]
        if not rows.size:
            break
        tried = order[rows, place]
        exact = ((vectors[rows] - centroids[tried]) ** 2).sum(1)
        made += rows.size
        better = (exact < best[rows]) | ((exact == best[rows]) & (tried < owner[rows]))
        best[rows[better]], owner[rows[better]] = exact[better], tried[better]
    return owner, best, made


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _runs(parts: Iterator[pa.RecordBatch], size: int = 4096) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for at in range(0, part.num_rows, size):
            yield part.slice(at, size)


def cluster(
    vectors: DataFrame, dims: int, count: int = 8, rounds: int = 10, scale: int = 1024, pivots: int = 8, pivot_sample: int = 256,
    key: str = "vec_id", value: str = "embedding",
) -> DataFrame:
    """Cluster the ``value`` vectors of ``dims`` components around ``count`` centroids, all in whole numbers.

    Returns the key with cluster, distance (squared), cluster_inertia, inertia and centroid_sha256. The first centroids are the vectors with
    the smallest :func:`hash_order`, those of one key by their components; rows without a key take part but never begin a
    cluster. Each round assigns every vector to its nearest centroid (ties: the smaller number) and moves each centroid that has
    vectors to their mean, rounded down by component; a last assignment follows. Equal vectors may begin several clusters;
    the smallest number then takes all. Vectors that :func:`whole_vectors` leaves out give no row; fewer vectors than
    ``count`` give fewer centroids; where no vector has a key there is none, and the result is empty. Other columns are ignored.

    ``pivots`` points of the ``pivot_sample`` vectors next in hash order are the pivots. They decide how many distances are spared, never a
    result.
    """
    plain = whole_vectors(vectors, dims, scale, key, value).withColumnRenamed(key, "__key")
    key_type = dict(plain.dtypes)["__key"]
    hashed = hash_order("__key")
    begun = plain.filter("__key IS NOT NULL").select(hashed.alias("h"), "whole").orderBy("h", "whole").limit(max(count, pivot_sample)).collect()
    columns = (F.col("__key").alias(key), F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    if not begun:  # rows without any key form no cluster
        return plain.limit(0).select(*columns)
    sample = np.array([r.whole for r in begun], np.int64)
    centroids, points = sample[:count], spread_out(sample, pivots)

    def measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(parts):
            far = pivot_distances(_matrix(part.column("whole"), np.int64), points)
            stored = pa.ListArray.from_arrays(np.arange(0, far.size + 1, len(points), dtype=np.int32), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("__key"), part.column("whole"), stored], names=["__key", "whole", "stored"])

    table = materialize(plain.mapInArrow(measure, f"__key {key_type}, whole array<int>, stored array<double>"), "pivot-table")

    def sums_by(now: np.ndarray):
        def assign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, size = np.zeros(now.shape, np.int64), np.zeros(len(now), np.int64)
            for part in _runs(parts):
                whole = _matrix(part.column("whole"), np.int64)
                owner = nearest(whole, _matrix(part.column("stored"), np.float64), now, points)[0]
                size += np.bincount(owner, minlength=len(now))
                for c in np.unique(owner):
                    total[c] += whole[owner == c].sum(0)
            held = np.flatnonzero(size)
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(size[held]), pa.array(total[held].tolist(), pa.list_(pa.int64()))],
                                             names=["cluster", "size", "total"])
        return assign

    for _ in range(rounds):
        parts = table.mapInArrow(sums_by(centroids), "cluster int, size long, total array<long>")
        moved = parts.groupBy("cluster").agg(F.sum("size").alias("size"), F.array(
            *[F.sum(F.get("total", F.lit(i)).cast("decimal(38,0)")) for i in range(dims)]).alias("total")).collect()
        centroids = centroids.copy()
        for r in moved:
            centroids[r["cluster"]] = [int(t) // r["size"] for t in r["total"]]

    def last(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(parts):
            owner, best, made = nearest(_matrix(part.column("whole"), np.int64), _matrix(part.column("stored"), np.float64), centroids, points)
            yield pa.RecordBatch.from_arrays([part.column("__key"), pc.cast(pa.array(owner), pa.int32()), pa.array(best)], names=["__key", "cluster", "distance"])

    done = materialize(table.mapInArrow(last, f"__key {key_type}, cluster int, distance long"), "clusters")
    inertia = {r["cluster"]: int(r["s"]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    own = F.get(F.array(*[F.lit(inertia.get(c, 0)).cast("decimal(38,0)").cast("long") for c in range(len(centroids))]), F.col("cluster"))
    return done.select(
        F.col("__key").alias(key), "cluster", "distance", own.alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("decimal(38,0)").cast("long").alias("inertia"),
        F.get(F.array(*[F.lit(d) for d in digests]), F.col("cluster")).alias("centroid_sha256"))
