"""Centroid clustering (Lloyd) of quantised vectors, each distinct vector once.

Components x become integers floor(SCALE * x). Equal quantised vectors are one row with their multiplicity, so a vector that a third of
all rows have costs as much as any other. Rounds run over the distinct vectors: each task assigns its own to the nearest
centroid and hands on, per centroid, the weighted sums of components and the weight; Spark sums these, and 64 numbers a centroid
reach the driver, which floors the exact quotients. Centroids travel with the tasks (K rows, a parameter). At the end the
assignments are joined back to the ids by a 256-bit digest of the quantised vector; Spark splits a vector of many rows.

Distances are exact: in doubles where all numbers on the way are whole and below 2^53, else in 64-bit integers. Components are
bounded to 2^27 in amount for that (the same as x beyond 2,097,152), so that any squared distance fits 64 bits.

Cases: vectors that are null, of another length, or with a null or non-finite component take no part; fewer vectors than K give as many
centroids; equal vectors that start as centroids leave the later ones empty, and these stay; ties in distance go to the smaller number;
ties in the starting order (repeated ids) go by the vector; null ids start a centroid only where other ids are too few; repeated rows are kept row
by row; an empty table gives an empty table; other columns are left aside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.llm.common import staged

LENGTH, SCALE, K, ROUNDS = 64, 64, 16, 3
LIMIT = 1 << 27
MOST = (1 << 63) - 1
#: Assignments up to which the join back is a broadcast.
BROADCAST_ROWS = 200_000


def quantised(vector: Column, length: int = LENGTH) -> Column:
    """array<int> of floor(SCALE * x); null for vectors that take no part."""
    numbers = F.transform(vector, lambda x: x.cast("double"))
    good = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(numbers, lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x * SCALE))).cast("int"))
    return F.when(F.coalesce((F.size(vector) == length) & good, F.lit(False)), whole)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row, the smaller of equals, and the squared distance."""
    reach = int(max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * reach * reach * vectors.shape[1] < 1 << 53 else np.int64
    best, least = np.zeros(len(vectors), np.int64), np.full(len(vectors), MOST, np.int64)
    for k, c in enumerate(centroids):
        apart = vectors.astype(kind) - c.astype(kind)
        distance = np.einsum("ij,ij->i", apart, apart).astype(np.int64)
        closer = distance < least
        best[closer], least[closer] = k, distance[closer]
    return best, least


def _matrix(batch: pa.RecordBatch, length: int) -> np.ndarray:
    return batch.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, length)


def _sums(distinct: DataFrame, centroids: np.ndarray) -> dict[int, list[int]]:
    """For each centroid that has vectors: the weighted sums of its vectors' components, then their weight."""
    length = centroids.shape[1]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[int]] = {}
        for batch in batches:
            vectors, n = _matrix(batch, length), batch.column("n").to_numpy()
            best, _ = nearest(vectors, centroids)
            if int(n.sum()) * int(np.abs(vectors).max(initial=0)) >= MOST:  # sums that could pass 64 bits
                vectors, n = vectors.astype(object), n.astype(object)
            for k in np.unique(best).tolist():
                mine = best == k
                sums = [*(n[mine] @ vectors[mine]), n[mine].sum()]
                held[k] = [a + int(b) for a, b in zip(held.get(k, [0] * (length + 1)), sums, strict=True)]
        for k, row in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(row)), pa.array(range(len(row))), pa.array([str(x) for x in row])], ["cluster", "at", "total"])

    parts = distinct.mapInArrow(go, "cluster long, at long, total string")
    rows = parts.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    out: dict[int, list[int]] = {}
    for r in rows:
        out.setdefault(r["cluster"], [0] * (length + 1))[r["at"]] = int(r["total"])
    return out


def _digest(numbers: Column) -> Column:
    return F.unhex(F.sha2(F.array_join(numbers, ","), 256))


def _starts(rows: DataFrame, k: int) -> np.ndarray:
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(order.alias("o"), "q").orderBy(F.asc_nulls_last("o"), "q").limit(k).collect()
    return np.array([r["q"] for r in first], np.int64)


def cluster(embeddings: DataFrame, vector: str = "embedding", k: int = K, rounds: int = ROUNDS, length: int = LENGTH) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every row whose vector takes part."""
    rows = embeddings.select(embeddings["vec_id"].alias("vec_id"), quantised(embeddings[vector], length).alias("q")).where("q is not null")
    distinct = staged(rows.groupBy("q").agg(F.count("*").alias("n")), "distinct")
    centroids = _starts(rows, k)
    if not len(centroids):
        return rows.select("vec_id", *(F.lit(0).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string")))).where("false")
    for _ in range(rounds):
        for i, row in _sums(distinct, centroids).items():
            centroids[i] = [x // row[-1] for x in row[:-1]]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, distance = nearest(_matrix(batch, length), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("n"), pa.array(best.astype(np.int32)), pa.array(distance)], ["q", "n", "cluster", "distance"])

    assigned = staged(distinct.mapInArrow(assign, "q array<int>, n long, cluster int, distance long").select(_digest(F.col("q")).alias("key"), "n", "cluster", "distance"), "assigned")
    totals = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)") * F.col("n").cast("decimal(18,0)")).alias("inertia")).collect()
    inertia = {r["cluster"]: int(r["inertia"]) for r in totals}
    said = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = F.element_at(F.array(*(F.struct(F.lit(min(inertia.get(i, 0), MOST)).cast("long").alias("inertia"), F.lit(s).alias("sha")) for i, s in enumerate(said))), F.col("cluster") + 1)
    few = distinct.count() <= BROADCAST_ROWS
    found = rows.select("vec_id", _digest(F.col("q")).alias("key")).join(F.broadcast(assigned) if few else assigned, "key")
    return found.select("vec_id", "cluster", "distance", of["inertia"].alias("cluster_inertia"), F.lit(min(sum(inertia.values()), MOST)).cast("long").alias("inertia"), of["sha"].alias("centroid_sha256"))
