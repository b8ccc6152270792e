"""Plain Lloyd clustering of integer vectors.

Centroids are a small array that every task gets by broadcast.  Each task takes the squared differences of its rows to every
centroid in 64-bit integers and the first of the nearest ones, and adds its rows up by cluster; what leaves a task are these
sums, one row for each of its clusters.  They are merged by a grouping, and only one row a cluster comes to the driver.  All is
exact, so the result does not depend on how rows are dealt.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows whose distances are taken at once.
ROWS = 8_192


def largest(size: int) -> int:
    """Up to this size of components, the squared distance of any two vectors fits 64 bits."""
    return min(math.isqrt((2**63 - 1) // size) // 2, 2**31 - 1)


def integer_vectors(embeddings: DataFrame, *, size: int = 64, factor: int = 256) -> DataFrame:
    """vec_id, x: floor(factor * component) of the vectors with exactly size components, none null or non-finite, and none beyond largest(size)."""
    v = F.col("embedding").cast("array<double>")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * factor < largest(size)))
    rows = embeddings.where((F.size("embedding") == size) & F.coalesce(usable, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * factor).cast("int")).alias("x"))


def first_centroids(vectors: DataFrame, *, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of seed and vec_id, in that order, as a matrix."""
    digest = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id is not null").select(digest.alias("h"), "x").orderBy("h", "x").limit(k).collect()  # k rows
    return np.array([r["x"] for r in rows], dtype=np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x: the number of the nearest centroid, the smaller of equally near ones, and the squared distance."""
    d = np.empty((len(centroids), len(x)), dtype=np.int64)
    for c, centroid in enumerate(centroids):
        difference = x - centroid
        d[c] = np.einsum("ij,ij->i", difference, difference)
    best = d.argmin(axis=0)
    return best, d[best, np.arange(len(x))]


def _sums(shared):
    def run(frames: Iterator) -> Iterator:
        import pandas as pd  # tasks have it loaded already, and the driver needs none of its memory

        centroids = shared.value
        total, n = np.zeros_like(centroids), np.zeros(len(centroids), dtype=np.int64)
        for frame in frames:
            for at in range(0, len(frame), ROWS):
                x = np.stack(frame["x"].iloc[at : at + ROWS].to_numpy()).astype(np.int64)
                best, _ = nearest(x, centroids)
                order = np.argsort(best, kind="stable")
                clusters, starts = np.unique(best[order], return_index=True)
                total[clusters] += np.add.reduceat(x[order], starts, axis=0)
                n[clusters] += np.diff(np.append(starts, len(order)))
        some = np.flatnonzero(n)
        if len(some):
            yield pd.DataFrame({"cluster": some.astype(np.int32), "n": n[some], "total": list(total[some])})

    return run


def step(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of each component's mean, or as before for an empty cluster."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)  # k rows
    parts = vectors.select("x").mapInPandas(_sums(shared), "cluster int, n long, total array<long>")
    each = parts.select("cluster", "n", F.posexplode("total").alias("at", "value"))
    merged = each.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    out = centroids.copy()
    for r in merged.collect():  # k times size rows
        out[r["cluster"], r["at"]] = int(r["value"]) // r["n"]
    shared.unpersist()
    return out


def _assign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(part.num_rows, -1)
                best, distance = nearest(x, centroids)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def cluster(embeddings: DataFrame, *, k: int = 40, rounds: int = 5, seed: str = "2:", size: int = 64, factor: int = 256) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 for each vector of integer_vectors().

    The first centroids are the k vectors with the smallest SHA-256 of seed and vec_id.  Each round assigns every vector to the nearest
    centroid, the one with the smaller number if several are, and puts every centroid that has vectors at the floor of their mean; the result is the assignment to the last ones.
    Vectors that are null, of another size or hold null, NaN or infinite components take no part, and neither do those with an integer of
    largest(size) or more (189,812,531 for 64 components), whose squared distances may not fit a long.  Repeated rows count each, and each comes back.  A row without vec_id is no
    first centroid, but has a cluster.  Fewer than k vectors give fewer clusters, and an empty table an empty one.
    Further columns are ignored.  Sums of distances that do not fit a long are null.
    """
    vectors = integer_vectors(embeddings, size=size, factor=factor)
    spark = embeddings.sparkSession
    centroids = first_centroids(vectors, k=k, seed=seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = step(vectors, centroids)
    shared = spark.sparkContext.broadcast(centroids)
    found = vectors.mapInArrow(_assign(shared), "vec_id long, cluster int, distance long")
    inertia = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    fits = lambda v: v if v < 2**63 else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(c, fits(d), fits(sum(inertia.values())), digests[c]) for c, d in inertia.items()]
    table = F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))  # k rows
    return found.join(table, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
