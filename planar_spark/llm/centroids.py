"""Centroid clustering with exact results: float products shortlist centroids, whole numbers decide.

A vector's products with all centroids are one float32 matrix product. Each comes with an interval that no rounding leaves: of n numbers, a
product summed in whatever order is off by at most n u / (1 - n u) times the lengths of both vectors, where u is half a unit in the last place, and
two more roundings bring the numbers to float32. A centroid whose least distance lies above another's greatest is out; where more than one is left, those are compared in
whole numbers, and of equal ones the least number wins.

Vectors stay where they are: a task sends a sum for each centroid and component, and these sums, of a size that depends on centroids and components
alone, are added and come to the driver, where the next centroids are their exact floor. Nothing else is collected.

Defined cases: vectors that are null, of another length, or with a null or non-finite component are left out; rows that repeat a vec_id are vectors of their
own; vec_ids that are null are clustered but are no start as long as others suffice; with fewer vectors than centroids each starts one; an empty table
gives an empty one; further columns are left out. A component beyond 2^27 after scaling is an error, as squared distances would pass 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, alone, discard, written

LENGTH, CENTROIDS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
LARGEST = 1 << 27
ULP = 2.0**-24  # half a unit in the last place of a float32, relative
CELLS = 1 << 20  # products that a task holds at once
SHARED = 1 << 24  # numbers that all centroids may have, as every task is sent them


def whole(rows: DataFrame, length: int = LENGTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, vec) of the rows whose ``embedding`` has ``length`` finite components, each scaled and rounded down."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            vectors = b.column(1)
            b = b.filter(pc.fill_null(pc.equal(pc.list_value_length(vectors), length), False))
            values = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
            kept = np.isfinite(values).all(axis=1)
            scaled = np.floor(values[kept] * scale)
            if (np.abs(scaled) > LARGEST).any():
                raise ValueError(f"a component passes {LARGEST} after scaling: squared distances would pass 64 bits")
            offsets = np.arange(0, scaled.size + 1, length, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(kept)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(scaled.ravel().astype(np.int32)))], names=["vec_id", "vec"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "embedding").mapInArrow(alone(run), f"vec_id {kind}, vec array<int>")


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The number of the nearest of ``centroids`` for each of ``vectors``, both of whole numbers."""
    n = vectors.shape[1] + 2
    gamma = n * ULP / (1 - n * ULP)
    product = (vectors.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    squares = (centroids * centroids).sum(axis=1)
    lengths = np.sqrt((vectors * vectors).sum(axis=1).astype(np.float64))[:, None] * np.sqrt(squares.astype(np.float64))
    # Less the vector's own square, which is the same for all. The last terms are for what is computed in float64.
    score = squares.astype(np.float64) - 2 * product
    off = 2 * gamma * (1 + 2.0**-40) * lengths + 2.0**-49 * (squares + 2 * lengths)
    open_ = score - off <= (score + off).min(axis=1)[:, None]
    out = open_.argmax(axis=1)
    several = np.flatnonzero(open_.sum(axis=1) > 1)
    if len(several):
        row, number = np.nonzero(open_[several])
        exact = np.full((len(several), len(centroids)), np.iinfo(np.int64).max)
        exact[row, number] = ((vectors[several[row]] - centroids[number]) ** 2).sum(axis=1)
        out[several] = exact.argmin(axis=1)  # the first of equal ones
    return out


def blocks(column: pa.Array, length: int, k: int):
    """A column of vectors as matrices of whole numbers, so many rows at once that the products fit."""
    step = max(1, min(CELLS // max(1, k), CELLS // length))
    for at in range(0, len(column), step):
        yield at, column.slice(at, step).flatten().to_numpy().astype(np.int64).reshape(-1, length)


def sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sum of the vectors nearest to each centroid that has any."""
    known = vectors.sparkSession.sparkContext.broadcast(centroids)
    k, length = centroids.shape

    def run(batches: Batches) -> Batches:
        own = np.zeros((k, length + 1), np.int64)
        for b in batches:
            for _, block in blocks(b.column(0), length, k):
                near = nearest(block, known.value)
                counted = np.column_stack([block, np.ones(len(block), np.int64)])
                for c in np.unique(near):
                    own[c] += counted[near == c].sum(axis=0)
        cluster, place = np.nonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(place, pa.int32()), pa.array(own[cluster, place])], names=["cluster", "place", "total"])

    got = vectors.select("vec").mapInArrow(alone(run), "cluster int, place int, total long")
    got = got.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # k * (length + 1) at most
    out: dict[int, tuple[int, list[int]]] = {r["cluster"]: (int(r["total"]), [0] * length) for r in got if r["place"] == length}
    for r in got:
        if r["place"] < length:
            out[r["cluster"]][1][r["place"]] = int(r["total"])
    return out


def fitted(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, length: int = LENGTH) -> np.ndarray:
    """Centroids after ``rounds`` rounds, from the ``k`` vectors whose hashed ids are least."""
    if k * length > SHARED:
        raise ValueError("so many centroids can't be sent to every task")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(F.asc_nulls_last(order), "vec").limit(k).select("vec").collect()
    now = np.array([r["vec"] for r in first], np.int64).reshape(-1, length)
    for _ in range(rounds if len(now) else 0):
        last, now = now, now.copy()
        for c, (count, total) in sums(vectors, last).items():
            now[c] = [t // count for t in total]
        if (now == last).all():
            break  # further rounds would change nothing
    return now


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of each vector."""
    known = vectors.sparkSession.sparkContext.broadcast(centroids)
    k, length = max(1, len(centroids)), centroids.shape[1]

    def run(batches: Batches) -> Batches:
        for b in batches:
            for at, block in blocks(b.column(1), length, k):
                near = nearest(block, known.value)
                distance = ((block - known.value[near]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(block)), pa.array(near, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(alone(run), f"vec_id {kind}, cluster int, distance long")


def clustered(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, length: int = LENGTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector."""
    vectors = written(whole(rows, length, scale), "vectors")
    centroids = fitted(vectors, k, rounds, seed, length)
    near = written(assigned(vectors, centroids), "assigned")
    discard(vectors)
    own = {r["cluster"]: int(r["d"]) for r in near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k at most
    of = [(c, own.get(c, 0), sum(own.values()), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist())]
    named = rows.sparkSession.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return near.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
