"""Approximate nearest neighbours by inner product, with shifted space-filling curves.

Vectors are scaled to unit length and rotated at random; each curve takes four of the rotated coordinates, shifts them
by an offset of its own and orders the vectors by their Hilbert key. The orders are range-partitioned and cut into blocks.
A query meets the vectors of its own block and of both neighbouring blocks on each curve, and the inner
products on the original vectors, in double precision, rank what it met.

Every vector is indexed. The size of the blocks follows the table: SAMPLE of the queries (by hash) are also compared with
every vector, and blocks are doubled from BLOCK until these queries' true neighbours are within reach at a share of RECALL, at
the latest when a query reaches every vector. So recall holds at any size, and for vectors of any norms; what grows is the work of
a query, CURVES * 3 * block products: on structureless vectors nearly with the table (README has figures). Blocks of more
than SLICE vectors are compared in slices, so that no task holds more.

Equal vectors are one point of the index, with the k + 1 smallest ids: more of them can never be among the k nearest, so
copies of one vector don't crowd a block.

Cases: null or empty vectors, zero vectors, those with null or non-finite components, those whose length isn't the
commonest (the smaller of equally common ones) and null ids take no part, as query or as candidate; ties go to the smaller id; a repeated id with equal vectors counts
once; fewer candidates than k give fewer rows; other columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candor.llm.common import staged

CURVES, AXES, BITS = 16, 4, 10
BLOCK = 2048
#: Queries whose true neighbours measure the reach of the blocks, and the share of these that must be in reach. At 5,120 neighbours
#: the share's standard deviation is about 0.01 at most, so recall is over 0.9.
SAMPLE, RECALL = 256, 0.95
SLICE = 32_768


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys of integer cells (rows), each coordinate of `bits` bits: the coordinates are unfolded from the
    highest bit down (rotation and reflection of each sub-cube), Gray-decoded and interleaved."""
    x = [c.astype(np.int64) for c in cells.T]
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            on = (x[i] >> b & 1).astype(bool)
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip = np.where(x[n - 1] >> b & 1, flip ^ ((1 << b) - 1), flip)
    key = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] ^ flip) >> b & 1
    return key


@lru_cache(4)
def _frames(dims: int, curves: int) -> tuple[np.ndarray, np.ndarray]:
    """Axes of each curve, (curves, AXES, dims), and its shifts, (curves, AXES)."""
    rng = np.random.default_rng(4)
    rows: list[np.ndarray] = []
    while sum(map(len, rows)) < curves * AXES:
        rows.append(np.linalg.qr(rng.normal(size=(dims, dims)))[0])
    return np.concatenate(rows)[: curves * AXES].reshape(curves, AXES, dims), rng.random((curves, AXES))


def keys(vectors: np.ndarray, curves: int) -> np.ndarray:
    """(rows, curves) Hilbert keys."""
    axes, shift = _frames(vectors.shape[1], curves)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = np.zeros((len(vectors), curves), np.int64)
    for c in range(curves):
        y = unit @ axes[c].T * np.sqrt(vectors.shape[1])  # about standard normal
        out[:, c] = hilbert(np.clip((y / 8 + 0.5) / 2 + shift[c] / 2, 0, 1 - 1e-9) * (1 << BITS), BITS)
    return out


def _clean(vectors: DataFrame) -> DataFrame:
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (dims["d"] if dims else 0))


def _nearest(points: DataFrame, sample: list[tuple[int, bytes]], k: int) -> dict[int, list[int]]:
    """The k other points with the largest inner products of each sampled point, by comparing it with all."""
    ids = np.array([p for p, _ in sample])
    q = np.frombuffer(b"".join(v for _, v in sample), np.float64).reshape(len(sample), -1)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_s, held_p = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64)
        for b in batches:
            if b.num_rows:
                c = np.frombuffer(b"".join(b.column("vec").to_pylist()), np.float64).reshape(b.num_rows, -1)
                p = np.broadcast_to(b.column("point").to_numpy(), (len(q), b.num_rows))
                s = np.where(p == ids[:, None], -np.inf, q @ c.T)
                held_s, held_p = np.concatenate([held_s, s], axis=1), np.concatenate([held_p, p], axis=1)
                if held_s.shape[1] > k:
                    top = np.argpartition(-held_s, k - 1, axis=1)[:, :k]
                    held_s, held_p = np.take_along_axis(held_s, top, 1), np.take_along_axis(held_p, top, 1)
        keep = np.isfinite(held_s)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, keep.sum(axis=1))), pa.array(held_p[keep]), pa.array(held_s[keep])], ["q", "point", "score"])

    found = points.select("point", "vec").mapInArrow(best, "q long, point long, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "point")
    out: dict[int, list[int]] = {}
    for r in found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("q", "point").collect():
        out.setdefault(r["q"], []).append(r["point"])
    return out


def fitting_block(points: DataFrame, places: DataFrame, n: int, k: int, block: int) -> int:
    """The smallest of block, 2 * block, ... by which the share RECALL of the sampled queries' true neighbours is in reach.
    places: point, curve, place (in the order of the curve)."""
    if n <= 2 * block:  # each query meets all
        return block
    sample = [(r["point"], bytes(r["vec"])) for r in points.where("asks").orderBy(F.xxhash64("point"), "point").limit(SAMPLE).select("point", "vec").collect()]
    near = _nearest(points, sample, k) if sample else {}
    wanted = sorted({*near, *(p for l in near.values() for p in l)})
    named = places.sparkSession.createDataFrame([(p,) for p in wanted], "point long")
    at: dict[int, dict[int, int]] = {}
    for r in places.join(F.broadcast(named), "point").collect():
        at.setdefault(r["point"], {})[r["curve"]] = r["place"]
    while block < n:
        hits = [any(abs(at[q][c] // block - at[p][c] // block) <= 1 for c in at[q]) for q, l in near.items() for p in l]
        if sum(hits) >= RECALL * len(hits):
            break
        block *= 2
    return block


def search(vectors: DataFrame, asks: F.Column, k: int = 20, curves: int = CURVES, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row of vectors (vec_id, embedding) for which
    asks holds, its own id left out."""
    rows = _clean(vectors)
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    points = ranked.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).withColumn("point", F.element_at("ids", 1))
    owners = rows.groupBy("v").agg(F.min("vec_id").alias("point"), F.max(asks).alias("asks"))
    points = points.drop("v").join(owners, "point")
    queries = rows.where(asks).select(F.col("vec_id").alias("query_id"), "v").distinct().join(owners.select("v", "point"), "v").select("query_id", "point")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)
                flat = pa.array(keys(v, curves).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * curves), flat)
                yield pa.RecordBatch.from_arrays([b.column("point"), b.column("ids"), b.column("asks"), pa.array([x.tobytes() for x in v], pa.binary()), lists], ["point", "ids", "asks", "vec", "keys"])

    points = staged(points.select("point", "ids", "asks", "v").mapInArrow(project, "point long, ids array<long>, asks boolean, vec binary, keys array<long>"), "points")
    n = points.count()
    order = points.select("point", "asks", F.posexplode("keys").alias("curve", "key"))
    parts = max(1, min(2000, n * curves // 500_000 + 8))
    order = order.repartitionByRange(parts, "curve", "key", F.xxhash64("point"), "point").sortWithinPartitions("curve", "key", F.xxhash64("point"), "point")
    order = staged(order.select("point", "asks", "curve", F.monotonically_increasing_id().alias("at")), "order")
    pid, local = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = sorted((r["pid"], r["count"]) for r in order.groupBy(pid.alias("pid")).count().collect())  # a row for each partition
    base, seen = [], 0
    for p, c in counts:
        base.append((p, seen))
        seen += c
    base_df = order.sparkSession.createDataFrame(base, "pid long, base long")
    at = order.select("point", "asks", "curve", pid.alias("pid"), local.alias("local")).join(F.broadcast(base_df), "pid")
    at = at.select("point", "asks", "curve", (F.col("base") + F.col("local") - F.col("curve") * n).alias("place"))
    block = fitting_block(points, at.select("point", "curve", "place"), n, k, block)
    at = at.select("point", "asks", "curve", F.floor(F.col("place") / block).cast("int").alias("block"))
    last, slices = max(0, (n - 1) // block), -(-min(block, max(n, 1)) // SLICE)
    near = F.filter(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1), lambda b: (b >= 0) & (b <= last))
    asked = at.where("asks").select("point", "curve", F.explode(near).alias("block"), F.lit(True).alias("q"))
    asked = asked.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    dealt = at.select("point", "curve", "block", F.lit(False).alias("q"), F.pmod(F.xxhash64("point"), F.lit(slices)).cast("int").alias("slice")).unionByName(asked)
    dealt = dealt.join(points.select("point", "vec"), "point")

    def rerank(rows_: pd.DataFrame) -> pd.DataFrame:
        rows_ = rows_.sort_values("point")
        is_q = rows_["q"].to_numpy()
        ids = rows_["point"].to_numpy()
        v = np.frombuffer(b"".join(rows_["vec"]), np.float64).reshape(len(rows_), -1)
        q, c, qid, cid = v[is_q], v[~is_q], ids[is_q], ids[~is_q]
        found: list[tuple[np.ndarray, ...]] = []
        step = max(1, 512 * BLOCK // max(len(c), BLOCK))
        for lo in range(0, len(q) if len(c) else 0, step):
            s = q[lo : lo + step] @ c.T
            cut = np.partition(s, len(cid) - k - 1, axis=1)[:, len(cid) - k - 1] if len(cid) > k + 1 else np.full(len(s), -np.inf)
            for i, row in enumerate(s):
                j = np.flatnonzero(row >= cut[i] - 1e-9 * (1 + abs(cut[i])) if np.isfinite(cut[i]) else np.ones(len(row), bool))
                exact = (q[lo + i] * c[j]).sum(axis=1)
                best = np.lexsort((cid[j], -exact))[: k + 1]
                found.append((np.full(len(best), qid[lo + i]), cid[j[best]], exact[best]))
        if not found:
            return pd.DataFrame({"q": [], "point": [], "score": []}).astype({"q": "int64", "point": "int64"})
        return pd.DataFrame(dict(zip(("q", "point", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    met = dealt.groupBy("curve", "block", "slice").applyInPandas(rerank, "q long, point long, score double")
    met = met.groupBy("q", "point").agg(F.max("score").alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "point")
    met = met.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    ids = met.join(points.select("point", "ids"), "point").select("q", "score", F.explode("ids").alias("vec_id"))
    ids = ids.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1).drop("r")
    lists = ids.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("l"))
    others = F.filter("l", lambda x: x["vec_id"] != F.col("query_id"))
    out = queries.join(lists, queries["point"] == lists["q"]).select("query_id", F.posexplode(F.slice(others, 1, k)).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).alias("rank"), "x.vec_id", (-F.col("x.s")).alias("score"))
