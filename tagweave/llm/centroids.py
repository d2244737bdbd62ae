"""Operator 12: integer centroid clustering with an equal-average equal-variance search.

Vectors become integer vectors, so every sum and distance is exact.  The nearest centroid of a
vector x is found without measuring all of them.  With S the sum of components and W =
dim * (sum of squares) - S^2 (dim^2 times the variance),

    dim * distance(x, c) >= (S_x - S_c)^2                                   (mean inequality)
    dim * distance(x, c) >= (S_x - S_c)^2 + (sqrt(W_x) - sqrt(W_c))^2       (deviation inequality)

Centroids are sorted by S, that is by component mean.  The search starts at the vector's own
mean and goes outward, always to the side that is nearer; once the nearer side fails the mean
inequality all that is left lies farther away.  A centroid that fails the deviation inequality
is skipped; what remains is measured in integers.  Many vectors walk side by side as numpy
lanes.

On Spark a round is one pass: tasks assign and pre-aggregate (cluster, component) sums, one
small shuffle adds them up and the driver receives k x (dim + 1) numbers, the model itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import map_arrow
from tagweave.session import cut_lineage, shared_folder

#: Stands for a side that has no centroid left; no two component sums lie so far apart.
NONE_LEFT = 1 << 40


def component_limit(dim: int) -> int:
    """Largest integer component for which squared sums over ``dim`` components stay in 64 bits."""
    return 1 << ((60 - 2 * (dim - 1).bit_length()) // 2)


def integer_vectors(vectors: DataFrame, dim: int, scale: int, column: str = "embedding") -> DataFrame:
    """``vec_id, v``: floor(scale * x) of every vector with ``dim`` finite components."""
    limit = float(component_limit(dim))
    whole = F.transform(F.col(column), lambda x: F.floor(x.cast("double") * scale))
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < limit)
    fit = F.when(F.size(column) == dim, F.forall(F.col(column), sound)).otherwise(False)
    return vectors.filter(fit).select("vec_id", F.transform(whole, lambda x: x.cast("int")).alias("v"))


class Codebook:
    """Centroids, sorted by component mean, that answer for the nearest of them."""

    def __init__(self, centroids: np.ndarray):
        total = centroids.sum(axis=1)
        order = np.argsort(total, kind="stable")
        self.centroids, self.number, self.total = centroids[order], order, total[order]
        self.dim = centroids.shape[1]
        self.squares = self.spread(self.centroids, self.total)

    def spread(self, v: np.ndarray, total: np.ndarray) -> np.ndarray:
        """dim^2 times the variance of the components (an exact integer)."""
        return self.dim * np.einsum("ij,ij->i", v, v) - total * total

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each row (ties: the smaller) and the squared distance."""
        n, k = len(v), len(self.number)
        total = v.sum(axis=1)
        squares = self.spread(v, total)
        root, roots = np.sqrt(squares.astype(float)), np.sqrt(self.squares.astype(float))
        right = np.searchsorted(self.total, total)
        left = right - 1
        # At least any distance that component_limit allows, and still safe to multiply.
        best, number = np.full(n, (1 << 62) // self.dim, np.int64), np.full(n, k, np.int64)
        live = np.arange(n)
        while len(live):
            l, r = left[live], right[live]
            below = np.where(l >= 0, total[live] - self.total[np.maximum(l, 0)], NONE_LEFT)
            above = np.where(r < k, self.total[np.minimum(r, k - 1)] - total[live], NONE_LEFT)
            down = below <= above
            gap = np.where(down, below, above)
            # The nearer side fails the mean inequality, or both ends are reached: the walk is over.
            going = gap < NONE_LEFT
            going[going] = gap[going] ** 2 <= self.dim * best[live[going]]
            live, down, gap = live[going], down[going], gap[going]
            at = np.where(down, left[live], right[live])
            left[live] -= down
            right[live] += ~down
            # Rounding of the roots is far below the slack, so no centroid is skipped wrongly.
            slack = 1e-9 * (squares[live] + self.squares[at]) + 1
            near = gap.astype(float) ** 2 + (root[live] - roots[at]) ** 2 - slack <= self.dim * best[live].astype(float)
            who, at = live[near], at[near]
            apart = v[who] - self.centroids[at]
            distance = np.einsum("ij,ij->i", apart, apart)
            better = (distance < best[who]) | ((distance == best[who]) & (self.number[at] < number[who]))
            best[who[better]], number[who[better]] = distance[better], self.number[at[better]]
        return number, best


def _lanes(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def cluster_sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``cluster, part, total``: component sums of every non-empty cluster; part -1 is its size."""
    k, dim = centroids.shape
    schema = pa.schema([("cluster", pa.int32()), ("part", pa.int32()), ("total", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(centroids)
        sums, sizes = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            v = _lanes(batch, dim)
            number, _ = book.nearest(v)
            np.add.at(sums, number, v)
            sizes += np.bincount(number, minlength=k)
        filled = np.flatnonzero(sizes)
        both = np.column_stack([sizes[filled], sums[filled]])
        cluster, part = np.repeat(filled, dim + 1), np.tile(np.arange(-1, dim), len(filled))
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(part, pa.int32()),
                                          pa.array(both.ravel(), pa.int64())], schema=schema)

    return map_arrow(vectors.select("v"), run, "cluster int, part int, total long") \
        .groupBy("cluster", "part").agg(F.sum("total").alias("total"))


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""
    dim = centroids.shape[1]
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(centroids)
        for batch in batches:
            number, distance = book.nearest(_lanes(batch, dim))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int32()), pa.array(distance, pa.int64())],
                                             names=["vec_id", "cluster", "distance"])

    return map_arrow(vectors.select("vec_id", "v"), run, f"vec_id {kind}, cluster int, distance long")


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors of the least sha256 of ``<salt><vec_id>``, in that order (k x dim numbers)."""
    name = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    rows = vectors.filter("vec_id is not null").select(name.alias("name"), "v").orderBy("name", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64,
                    salt: str = "1:") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector.

    Kept are vectors with exactly ``dim`` components, none null, NaN or infinite; each
    component x counts as floor(``scale`` * x).  A vector with a component whose square sums could leave 64
    bits (``component_limit``: 2^24 at 64 dimensions) is left out likewise.  The ``k`` first
    centroids are named by hash; fewer vectors than ``k`` give as many centroids.  Rows with a null id are
    clustered but never a first centroid; without any id there is no centroid and the result is
    empty.  Repeated rows count as often as they stand there.  Empty input: empty.
    """
    path = shared_folder(vectors.sparkSession, "integer-vectors")
    integer_vectors(vectors, dim, scale).write.parquet(path)
    kept = vectors.sparkSession.read.parquet(path)
    kind = kept.schema["vec_id"].dataType.simpleString()
    centroids = first_centroids(kept, k, salt)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame(
            [], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        new = {}
        for r in cluster_sums(kept, centroids).collect():  # k x (dim + 1) rows at most
            new.setdefault(r["cluster"], {})[r["part"]] = r["total"]
        for number, sums in new.items():
            centroids[number] = [sums[i] // sums[-1] for i in range(dim)]  # Python's // is floor
    found = cut_lineage(assign(kept, centroids))
    inertia = {r["cluster"]: r["n"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(number, n, sum(inertia.values()), digest[number]) for number, n in sorted(inertia.items())]
    of_cluster = vectors.sparkSession.createDataFrame(
        rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of_cluster), "cluster") \
        .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows are sent
