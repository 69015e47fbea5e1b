"""Centroid clustering with an annulus search, in whole numbers.

Vectors become integers, so that distances, sums and ties are exact and the
result depends neither on the number of tasks nor on their order. In each
round a task sorts the centroids by norm. A vector's distance to the centroid
of the nearest norm bounds its distance to the nearest one; by the triangle
inequality a centroid whose norm is further from the vector's than this bound
cannot be nearer. A binary search finds those within, ends included, and only
they are compared, exactly.

What is gathered are the centroids and their sums, ``k`` rows whatever the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import bound_batches, released

#: Integers from here on could give distances that a long does not hold.
LIMIT = 1 << 27

RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def _whole(dims: int, scale: int):
    @released
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            right = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
            ids, column = batch.column(0).filter(right), column.filter(right)
            values = column.flatten()
            x = pc.fill_null(values, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dims)
            kept = np.isfinite(x).all(axis=1)
            whole = np.floor(x[kept] * float(scale))
            if whole.size and np.abs(whole).max() >= LIMIT:
                raise ValueError(f"a component times {scale} is beyond {LIMIT}: distances would not fit a long")
            raw = whole.astype("<i4").tobytes()
            offsets = pa.py_buffer((np.arange(len(whole) + 1, dtype=np.int32) * (4 * dims)).tobytes())
            v = pa.Array.from_buffers(pa.binary(), len(whole), [None, offsets, pa.py_buffer(raw)])
            yield pa.record_batch([ids.filter(pa.array(kept)), v], names=["vec_id", "v"])

    return convert


def whole_vectors(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id and ``v``, floor(scale * x) of every component as 32-bit integers, of the vectors that count."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(_whole(dims, scale), "vec_id long, v binary")


def seeds(whole: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the least SHA-256 of ``seed:vec_id``; rows of one hash by their components, null ids last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = whole.select("v", order.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([np.frombuffer(bytes(r["v"]), "<i4") for r in rows], np.int64)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each vector's nearest centroid, of equally near ones the least, and the squared distance."""
    norms = np.sqrt((centroids * centroids).sum(axis=1))
    order = np.argsort(norms, kind="stable")
    norms, own = norms[order], np.sqrt((v * v).sum(axis=1))
    above = np.searchsorted(norms, own).clip(1, max(len(norms) - 1, 1))
    below = above - 1
    above = above.clip(max=len(norms) - 1)
    guess = order[np.where(own - norms[below] <= norms[above] - own, below, above)]
    gap = v - centroids[guess]
    bound = np.sqrt((gap * gap).sum(axis=1))
    # Square roots are rounded: the annulus is a little wider than they say.
    bound += 1e-9 * (bound + own) + 1e-6
    first, end = np.searchsorted(norms, own - bound, side="left"), np.searchsorted(norms, own + bound, side="right")
    best, found = np.full(len(v), np.iinfo(np.int64).max), np.full(len(v), len(norms))
    for rank, number in enumerate(order.tolist()):
        at = np.flatnonzero((first <= rank) & (rank < end))
        gap = (v if len(at) == len(v) else v[at]) - centroids[number]
        distance = np.einsum("ij,ij->i", gap, gap)
        closer = (distance < best[at]) | ((distance == best[at]) & (number < found[at]))
        best[at[closer]], found[at[closer]] = distance[closer], number
    return found, best


def _read(column: pa.Array, dims: int) -> np.ndarray:
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros((0, dims), np.int64)
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, "<i4", count=len(column) * dims, offset=int(at[0])).reshape(-1, dims).astype(np.int64)


def _sums(centroids: np.ndarray):
    """(cluster, rows, sums) of a task's vectors, one row for each cluster."""
    @released
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            v = _read(batch.column(0), dims)
            found, _ = nearest(v, centroids)
            by = np.argsort(found, kind="stable")
            held, starts = np.unique(found[by], return_index=True)
            if len(held):
                sums[held] += np.add.reduceat(v[by], starts, axis=0)
                counts += np.bincount(found, minlength=k)
        held = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(held, pa.int32()), pa.array(counts[held]), pa.array(list(sums[held]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return add


def _placed(centroids: np.ndarray):
    @released
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, best = nearest(_read(batch.column(1), centroids.shape[1]), centroids)
            yield pa.record_batch([batch.column(0), pa.array(found, pa.int32()), pa.array(best, pa.int64())], names=["vec_id", "cluster", "distance"])

    return place


def moved(whole: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor(sum / count) of their vectors; those without vectors stay."""
    parts = whole.select("v").mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>")
    places = parts.select("cluster", "n", F.posexplode("sums").alias("place", "s")).groupBy("cluster", "place")
    new = centroids.copy()
    for r in places.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(19,0)")).alias("s")).collect():
        new[r["cluster"], r["place"]] = int(r["s"]) // r["n"]
    return new


def clusters(vectors: DataFrame, k: int = 40, dims: int = 64, rounds: int = 5, scale: int = 256, seed: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that counts.

    Of ``vectors`` (vec_id, embedding) those count that have exactly ``dims``
    components, none of them null or not finite; null, shorter and longer ones
    are left out. Repeated rows, and rows that share a vec_id, each count. A null
    vec_id stays null and gives a first centroid only if ids run out. With fewer
    than ``k`` vectors each is a first centroid; without any the result is
    empty. Other columns are ignored. Components of 2**27 / ``scale`` and more
    are an error, as their distances need not fit a long.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "centroids")
    bound_batches(spark)
    whole = scratch.save(whole_vectors(vectors, dims, scale), "whole")
    centroids = seeds(whole, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    for _ in range(rounds):
        centroids = moved(whole, centroids)
    found = scratch.save(whole.mapInArrow(_placed(centroids), "vec_id long, cluster int, distance long"), "found")
    inertia = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("d")).collect()}
    total = sum(inertia.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # At most ``k`` rows.
    facts = spark.createDataFrame([(c, inertia[c], total, digest[c]) for c in sorted(inertia)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
