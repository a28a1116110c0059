"""Centroid clustering by scalar lookup tables (operator 11).

Vectors become small integers once and are written.  A round sends the centroids, a few kilobytes, to
every task.  For each Arrow batch a task tabulates, per dimension, the squared difference of every
integer that occurs there to every centroid; distances are gathers from these tables and sums.  A task
returns one row per cluster with exact integer sums, which Spark adds up, so nothing on the driver grows
with the vectors.  All arithmetic is on integers: reruns and any partitioning agree.

Defined results: vectors that are null, have another width, or hold a null, NaN or infinity are left
out, as are components of 2**21 or more, whose squared distances do not fit 64 bits; ids may be null or
repeat, each row is a vector of its own (a null id is hashed as the empty text); equal start hashes go
by their integers; with fewer vectors than centroids there are as many centroids as vectors; no vectors
give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.session import checkpointed

WIDTH = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
LIMIT = 1 << 21  # of a component, so that a squared distance fits 64 bits
DENSE = 4  # times the rows of a batch: widest span of integers that is looked up by offset


def integer_vectors(table: DataFrame, vectors: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: the kept vectors as integers floor(scale * x)."""

    def fine(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LIMIT)

    vector = F.col(vectors).cast("array<double>")
    kept = table.select("vec_id", vector.alias("x")).where((F.size("x") == width) & F.forall("x", fine))
    return kept.select("vec_id", F.transform("x", lambda x: F.floor(x * F.lit(float(scale))).cast("int")).alias("v"))


def first_centroids(table: DataFrame, clusters: int, width: int = WIDTH) -> np.ndarray:
    """The vectors with the smallest hashes of round and id, in that order."""
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = table.select(key.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), width)


def occurring(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct integers of a column and the place of each row's integer among them."""
    low, high = int(column.min()), int(column.max())
    if high - low > DENSE * len(column):
        return np.unique(column, return_inverse=True)
    there = np.zeros(high - low + 1, bool)
    there[column - low] = True
    return np.flatnonzero(there) + low, (np.cumsum(there) - 1)[column - low]


def nearest(values: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller one of ties) and its squared distance."""
    total = np.zeros((len(values), len(centroids)), np.int64)
    for d in range(values.shape[1]):
        integers, place = occurring(values[:, d])
        squares = (integers[:, None] - centroids[None, :, d]) ** 2
        total += squares[place]
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(values)), cluster]


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            yield batch, flat.astype(np.int64).reshape(-1, width)


def cluster_sums(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``cluster, dim, total, members``: exact sums of the vectors assigned to each centroid."""
    many, width = centroids.shape

    def run(batches):
        sums, members = np.zeros((many, width), np.int64), np.zeros(many, np.int64)
        for _, values in _matrices(batches, width):
            cluster, _ = nearest(values, centroids)
            order = np.argsort(cluster, kind="stable")
            there, starts = np.unique(cluster[order], return_index=True)
            sums[there] += np.add.reduceat(values[order], starts, axis=0)
            members += np.bincount(cluster, minlength=many)
        there = np.flatnonzero(members)
        yield pa.RecordBatch.from_arrays(
            [pa.array(there), pa.array(sums[there].tolist(), pa.list_(pa.int64())), pa.array(members[there])],
            ["cluster", "sums", "members"],
        )

    parts = table.select("v").mapInArrow(run, "cluster bigint, sums array<bigint>, members bigint")
    return (
        parts.select("cluster", "members", F.posexplode("sums").alias("dim", "part"))
        .groupBy("cluster", "dim")
        .agg(F.sum("part").alias("total"), F.sum("members").alias("members"))
    )


def moved(centroids: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Centroids after a round: floor of the mean by exact division; empty clusters stay."""
    out = centroids.copy()
    for r in sums.collect():  # clusters x width rows
        out[r.cluster, r.dim] = r.total // r.members
    return out


def assigned(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""
    width = centroids.shape[1]

    def run(batches):
        for batch, values in _matrices(batches, width):
            cluster, distance = nearest(values, centroids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                ["vec_id", "cluster", "distance"],
            )

    kind = table.schema["vec_id"].dataType.simpleString()
    return table.select("vec_id", "v").mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint")


def cluster(table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, **shape) -> DataFrame:
    """Cluster, squared distance, inertias and the final centroid's hash of every kept vector."""
    spark = table.sparkSession
    vectors = checkpointed(integer_vectors(table, **shape), "integers")
    centroids = first_centroids(vectors, clusters, shape.get("width", WIDTH))
    if len(centroids):
        for _ in range(rounds):
            centroids = moved(centroids, cluster_sums(vectors, centroids))
    else:
        centroids = np.zeros((1, shape.get("width", WIDTH)), np.int64)
    placed = checkpointed(assigned(vectors, centroids), "assigned")
    found = {r.cluster: r.total for r in placed.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    rows = [
        (i, found.get(i, 0), sum(found.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest())
        for i, c in enumerate(centroids)
    ]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
