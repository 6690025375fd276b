"""Centroid clustering of integer vectors with exact results: float32 screening, exact integers where it can't decide.

Vectors x and centroids c are integers. The nearest centroid has the least |c|^2 - 2 x.c. One float32 matrix product
gives all x.c of a block of vectors, each within gamma(d + 2) |x| |c| of the truth (d components, both factors rounded
to float32; Cauchy and Schwarz bound the sum of the products' sizes), in whatever order the product adds. That makes an
interval for each centroid's value. Centroids whose interval reaches below the least upper end are the shortlist; where
it has more than one, these alone are recomputed with 64-bit integers, and of equal values the lowest number wins.

Each round reads the table once: tasks add up their vectors by centroid, at most k rows leave a task, and k rows reach
the driver, which takes the floor of each mean with whole numbers. A lost task is worked out again from the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpforge.llm._common import settle

CLUSTERS, ROUNDS, DIMENSIONS, SCALE = 16, 3, 64, 64
#: Integers of this size or above are refused, like values that aren't finite: below it, squared distances fit 64 bits.
TOO_LARGE = 1 << 27
_ROWS_AT_ONCE = 1 << 14
#: The unit roundoff of float32, and a factor that covers the rounding of the bounds themselves in float64.
_UNIT, _SAFE = 2.0**-24, 1 + 1e-9


def gamma(n: int) -> float:
    """The relative bound of n roundings in float32."""
    return n * _UNIT / (1 - n * _UNIT)


def intervals(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends of |c|^2 - 2 x.c for all rows of x and c (int64), as float64."""
    about = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    size_x, size_c = (np.sqrt((m.astype(np.float64) ** 2).sum(1)) * _SAFE for m in (x, c))
    squares = (c * c).sum(1)
    value = squares.astype(np.float64) - 2 * about
    # Of the float64 steps too: the squares' conversion, the difference, and the ends themselves.
    error = 2 * gamma(x.shape[1] + 2) * size_x[:, None] * size_c + 2.0**-50 * (squares + 2 * np.abs(about))
    return value - error * _SAFE, value + error * _SAFE


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The number of the nearest row of c for each row of x (int64); of equally near ones the lowest."""
    low, high = intervals(x, c)
    listed = low <= high.min(1, keepdims=True)
    found = listed.argmax(1)
    open_ = np.flatnonzero(listed.sum(1) > 1)
    if len(open_):
        row, centroid = np.nonzero(listed[open_])  # by row, then centroid number
        distance = ((x[open_[row]] - c[centroid]) ** 2).sum(1)
        first = np.r_[0, np.flatnonzero(np.diff(row)) + 1]
        least = np.repeat(np.minimum.reduceat(distance, first), np.diff(np.r_[first, len(row)]))
        hit = np.flatnonzero(distance == least)
        found[open_[row[hit[::-1]]]] = centroid[hit[::-1]]  # the last written is the lowest
    return found


def is_kept(vector: Column, dimensions: int = DIMENSIONS, scale: int = SCALE) -> Column:
    """Whether a vector has exactly so many components, all finite numbers whose integers are below TOO_LARGE in size."""
    fits = lambda v: v.isNotNull() & (F.abs(v.cast("double")) * scale < TOO_LARGE)  # noqa: E731  false for what isn't a number, too
    return F.coalesce((F.size(vector) == dimensions) & F.forall(vector, lambda v: F.coalesce(fits(v) & ~F.isnan(v), F.lit(False))), F.lit(False))


def _integers(column: pa.Array, scale: int, dimensions: int) -> np.ndarray:
    return np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).astype(np.int64).reshape(-1, dimensions)


def _blocks(batches: Iterator[pa.RecordBatch], scale: int, dimensions: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for begun in range(0, batch.num_rows, _ROWS_AT_ONCE):
            part = batch.slice(begun, _ROWS_AT_ONCE)
            yield part, _integers(part.column("vector"), scale, dimensions)


def first_centroids(rows: DataFrame, clusters: int, scale: int, seed: int = 1) -> np.ndarray:
    """The vectors with the smallest SHA-256 of `seed:id`, in its order; of one id's vectors the one that sorts first."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    firsts = rows.select(F.coalesce(order, F.lit("g")).alias("order"), "vector").orderBy("order", "vector").limit(clusters).collect()
    return np.floor(np.array([r["vector"] for r in firsts], np.float64) * scale).astype(np.int64)


def _moved(rows: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """The centroids after one round: the floor of the mean of their vectors; those without vectors stay."""
    k, dimensions = centroids.shape

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)  # below 2^63 for 2^36 rows a task
        for _, x in _blocks(batches, scale, dimensions):
            own = nearest(x, centroids)
            counts += np.bincount(own, minlength=k)
            np.add.at(sums, own, x)
        some = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(counts[some]), *(pa.array(sums[some, j]) for j in range(dimensions))], ["cluster", "n", *(f"s{j}" for j in range(dimensions))])

    columns = [f"s{j}" for j in range(dimensions)]
    parts = rows.select("vector").mapInArrow(added, "cluster int, n long, " + ", ".join(f"{c} long" for c in columns))
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    moved = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *map(wide, columns)).collect():
        moved[row["cluster"]] = [int(row[c]) // row["n"] for c in columns]
    return moved


def cluster(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row per vector that is kept.

    Kept are vectors of exactly `dimensions` components, none null, not finite or, times scale, of TOO_LARGE or more;
    others, null vectors among them, are not returned. A component v becomes floor(scale * v), v as double. Centroids
    start as the vectors with the smallest SHA-256 of `1:id`; vectors without an id come last there and are clustered
    like others. With fewer vectors than clusters there are fewer centroids. Repeated rows and ids count each for itself.
    Each round assigns all vectors to the nearest centroid (squared distance; of equal ones the lowest number) and moves
    centroids to the floor of their mean; then all are assigned once more. distance is squared, the inertias add it up
    over the cluster and over all. Further columns are neither read nor returned; an empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).where(is_kept(F.col(vector_col), dimensions, scale))
    centroids = first_centroids(rows, clusters, scale)
    id_type = rows.schema["vec_id"].dataType.simpleString()
    if not len(centroids):
        centroids = np.zeros((1, dimensions), np.int64)
        rounds = 0
    for _ in range(rounds):
        centroids = _moved(rows, centroids, scale)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, scale, dimensions):
            own = nearest(x, centroids)
            distance = ((x - centroids[own]) ** 2).sum(1)
            yield pa.record_batch([part.column("vec_id"), pa.array(own, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    final = settle(rows.mapInArrow(assigned, f"vec_id {id_type}, cluster int, distance long"))
    inertias = {r["cluster"]: r["total"] for r in final.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    told = [(k, inertias.get(k, 0), ",".join(map(str, c))) for k, c in enumerate(centroids.tolist())]
    whole = F.lit(sum(inertias.values())).cast("long").alias("inertia")
    named = vectors.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, told string").select("cluster", "cluster_inertia", F.sha2("told", 256).alias("centroid_sha256"))
    return final.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", whole, "centroid_sha256")
