"""Centroid clustering with Orchard search.

Vectors are kept as integers, so that sums, means and distances are exact and don't depend on the
order of rows. Every centroid has a list of the others, nearest first. A vector's search starts at
some centroid and walks along that one's list; whenever it meets a closer centroid, it goes on with
that one's list from its start. Centroids that were met are marked and not measured again. Once the
list is strictly beyond twice the distance from the current centroid, none can be as near (by the
triangle inequality), so the search ends. Rows of a batch are searched side by side.

A round reads the vectors once. Executors return one row of sums for each cluster and partition,
so a cluster with a third of the vectors is no more work than another; the driver holds the k
centroids and their sums, and nothing else.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE = 1024
#: Components at or beyond this size are refused, as sums of squares might not fit a long.
LARGEST = 1 << 26
#: Rows searched side by side.
SLICE = 4096
#: Leading components by which the first centroid of a search is guessed.
GUESSED_BY = 8


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, scale: int = SCALE) -> DataFrame:
    """vec_id and parts (array<long>): floor(scale * component), of the rows with exactly size components, none null, infinite or NaN."""
    x = F.transform(vector_col, lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sized = rows.select(F.col(id_col).alias("vec_id"), F.when((F.size(vector_col) == size) & F.coalesce(finite, F.lit(False)), x).alias("x")).where("x is not null")
    small = F.forall("x", lambda v: F.abs(scale * v) < LARGEST)
    checked = F.when(small, F.col("x")).otherwise(F.raise_error(F.lit(f"components must be under {LARGEST} / {scale} in size")))
    return sized.select("vec_id", F.transform(checked, lambda v: F.floor(scale * v)).alias("parts"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the k smallest sha256 of "seed:vec_id", in that order; of equal ones the least parts come first."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    chosen = vectors.select(name.alias("name"), "parts").orderBy("name", "parts").limit(k).collect()
    return np.array([r.parts for r in chosen], dtype=np.int64)


class Orchard:
    """Nearest centroids by sorted neighbour lists."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        between = np.stack([((centroids - c) ** 2).sum(axis=1) for c in centroids])
        self.lists = np.argsort(between, axis=1, kind="stable")  # a centroid itself may come after an equal one: it is marked then
        self.spread = np.take_along_axis(between, self.lists, axis=1)

    def guess(self, vectors: np.ndarray) -> np.ndarray:
        near = self.centroids[:, :GUESSED_BY]
        return np.argmin((near**2).sum(axis=1) - 2 * (vectors[:, :GUESSED_BY] @ near.T), axis=1)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest centroid of each row (the smaller number of equal ones), its squared distance, and how many distances were measured."""
        n, k = len(vectors), len(self.centroids)
        rows = np.arange(n)
        at = self.guess(vectors)
        distance = ((vectors - self.centroids[at]) ** 2).sum(axis=1)
        met = np.zeros((n, k), dtype=bool)
        met[rows, at] = True
        place, measured = np.zeros(n, dtype=np.int64), n
        while len(rows):
            own, here = at[rows], place[rows]
            inside = here < k
            inside[inside] = self.spread[own[inside], here[inside]] <= 4 * distance[rows[inside]]
            rows, own, here = rows[inside], own[inside], here[inside]
            other = self.lists[own, here]
            place[rows] = here + 1
            new = ~met[rows, other]
            asked, other = rows[new], other[new]
            met[asked, other] = True
            apart = ((vectors[asked] - self.centroids[other]) ** 2).sum(axis=1)
            measured += len(asked)
            closer = (apart < distance[asked]) | ((apart == distance[asked]) & (other < at[asked]))
            jumped = asked[closer]
            at[jumped], distance[jumped], place[jumped] = other[closer], apart[closer], 0
        return at, distance, measured


def _slices(batch: pa.RecordBatch, column: int, size: int):
    """Slices of a batch with their vectors as a matrix."""
    for start in range(0, batch.num_rows, SLICE):
        part = batch.slice(start, SLICE)
        yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> list:
    """Of each cluster with vectors: its number, how many they are, and their sums by component."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def of(batches):
        search = Orchard(shared.value)
        k, size = search.centroids.shape
        sums, counts = np.zeros((k, size), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            for _, matrix in _slices(batch, 0, size):
                at = search.nearest(matrix)[0]
                order = np.argsort(at, kind="stable")
                found, starts = np.unique(at[order], return_index=True)
                sums[found] += np.add.reduceat(matrix[order], starts, axis=0)
                counts += np.bincount(at, minlength=k)
        own = np.flatnonzero(counts)
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts[own]), pa.array(list(sums[own]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = vectors.select("parts").mapInArrow(of, "cluster long, n long, sums array<long>")
    total = F.array(*(F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(centroids.shape[1])))
    found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), total.alias("sums")).collect()
    shared.unpersist()
    return found


def refine(vectors: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """Centroids after rounds of assignment and floored means; one without vectors stays where it is."""
    for _ in range(rounds):
        moved = centroids.copy()
        for row in _sums(vectors, centroids):
            moved[row.cluster] = [int(s) // row.n for s in row.sums]
        if (moved == centroids).all():
            break  # all further rounds would give the same
        centroids = moved
    return centroids


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of each vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def of(batches):
        search = Orchard(shared.value)
        for batch in batches:
            for part, matrix in _slices(batch, 1, search.centroids.shape[1]):
                at, distance, _ = search.nearest(matrix)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(at.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "parts").mapInArrow(of, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in centroid).encode()).hexdigest()


def cluster(rows: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, scale: int = SCALE) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are rows whose vector has exactly size components, none null, infinite or NaN; others, null
    vectors too, give no row. Rows that repeat an id are vectors of their own; a null id's text is
    empty. With fewer vectors than k there are as many centroids as vectors; an empty table gives an
    empty result. Of centroids that are equally near the one with the smaller number is taken, so
    of equal centroids the later ones stay empty and where they are. Components whose size is 2**26 / scale or more raise an error. Other columns aren't read.
    """
    vectors = written(whole_vectors(rows, id_col, vector_col, size, scale), "vectors")
    centroids = first_centroids(vectors, k, seed)
    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], schema)
    centroids = refine(vectors, centroids, rounds)
    found = written(assigned(vectors, centroids), "assigned")
    inertias = {r.cluster: r.inertia for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}

    def told(values: list, kind: str) -> Column:
        """The cluster's value: k literals."""
        return F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster") + 1)

    own = told([inertias.get(c, 0) for c in range(len(centroids))], "long")
    names = told([digest(c) for c in centroids], "string")
    return found.select("vec_id", "cluster", "distance", own.alias("cluster_inertia"), F.lit(sum(inertias.values())).cast("long").alias("inertia"), names.alias("centroid_sha256"))
