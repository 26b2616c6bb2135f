"""Gradient boosting on histograms.

Features are binned by quantiles, and rows of equal bins and label become one with a weight. For each level of a tree, tasks sum
gradients, hessians and weights by node, feature and bin; the driver gets these sums (nodes * features * bins, whatever the
number of rows) and finds the splits. Rows are held by the executors in blocks, arrays of a partition's rows, so that a level is one
small job. The first job of a tree adds the values of the tree before; every KEEP trees the blocks are written to the shared folder, so
a lost executor costs a re-read and KEEP trees at most. Up to ROWS_AT_ONCE weighted rows, a job for each level would take longer than its
work, and one task makes all rounds, with the same functions.

Trees grow level by level: of a level's nodes those with the largest gains are split first, up to `leaves` leaves. Rows with a null
or NaN feature go with the largest values. Labels are 0 and 1; both must be there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.sources.files import kept, scratch

# The parameters of the booster.
ROUNDS, RATE, L2, LEAVES, LEAST, BINS, LEAST_HESSIAN = 300, 0.05, 1.0, 31, 20, 255, 1e-3
# End of fixed values.

#: Weighted rows up to which one task makes all rounds.
ROWS_AT_ONCE = 200_000
#: Weighted rows of a block at most, about; there are as many blocks as cores at least.
BLOCK_ROWS = 500_000
#: Trees after which the blocks are written.
KEEP = 16
#: Blocks whose sums are added by the driver; those of more are added on the executors first.
DRIVER_ADDS = 32


@dataclass
class Booster:
    """Trees as arrays over all nodes: a node's feature (-1: leaf), the largest bin that goes left, its children, and its value."""

    features: list[str]
    edges: list[np.ndarray]
    start: float
    roots: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def raw(self, columns: list[np.ndarray]) -> np.ndarray:
        bins = np.stack([np.searchsorted(e, x, "left") for e, x in zip(self.edges, columns, strict=True)])
        out, rows = np.full(bins.shape[1], self.start), np.arange(bins.shape[1])
        for root in self.roots:
            at = np.full(len(rows), root)
            while (inner := self.feature[at] >= 0).any():
                low = bins[np.maximum(self.feature[at], 0), rows] <= self.bin[at]
                at = np.where(inner, np.where(low, self.left[at], self.right[at]), at)
            out += self.value[at]
        return out

    def score(self, df: DataFrame, column: str = "fused") -> DataFrame:
        """df with the probability of label 1."""
        names = [f.name for f in df.schema.fields]

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                raw = self.raw([b.column(f"_x{i}").to_numpy(zero_copy_only=False) for i in range(len(self.features))])
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(1 / (1 + np.exp(-raw)))], [*names, column])

        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{column}` double"])
        return df.select("*", *(F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(self.features))).mapInArrow(go, schema)


def edges_of(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper bounds of all bins but the last, by quantiles."""
    cuts = [i / bins for i in range(1, bins)]
    got = df.agg(*(F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), cuts, 100_000).alias(f"e{i}") for i, c in enumerate(features))).first()
    return [np.unique(np.array(e or [], float)) for e in got]


def splits_of(histogram: np.ndarray, l2: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best gain, feature and bin of each node of a histogram (node, feature, bin, [gradient, hessian, rows])."""
    left = np.cumsum(histogram, axis=2)
    whole = left[:, :, -1:, :]
    right = whole - left
    gain = lambda x: x[..., 0] ** 2 / (x[..., 1] + l2)
    gains = gain(left) + gain(right) - gain(whole)
    for side in (left, right):
        gains = np.where((side[..., 2] >= least) & (side[..., 1] >= LEAST_HESSIAN), gains, -np.inf)
    flat = np.round(gains, 9).reshape(len(gains), -1)  # sums in another order don't decide between equal gains
    best = flat.argmax(axis=1)
    return flat[np.arange(len(flat)), best], best // histogram.shape[2], best % histogram.shape[2]


def leaf_of(nodes: list[list], bins: np.ndarray) -> np.ndarray:
    """The node of a tree that each row ends in; bins: (feature, row)."""
    feature, bin_, left, right = (np.array([n[i] for n in nodes]) for i in range(4))
    at, rows = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
    while (inner := feature[at] >= 0).any():
        at = np.where(inner, np.where(bins[np.maximum(feature[at], 0), rows] <= bin_[at], left[at], right[at]), at)
    return at


def histogram_of(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, raw: np.ndarray, nodes: list[list], active: list[int], width: int) -> np.ndarray:
    """(node, feature, bin, [gradient, hessian, weight]) of the active nodes, flat."""
    p, at, count = 1 / (1 + np.exp(-raw)), leaf_of(nodes, bins), len(bins)
    slot = np.full(len(nodes), -1)
    slot[active] = np.arange(len(active))
    mine = np.flatnonzero(slot[at] >= 0)
    cell = (slot[at[mine]] * (count * width) + (np.arange(count) * width)[:, None] + bins[:, mine]).ravel()
    sums = [np.bincount(cell, np.tile(w[mine], count), len(active) * count * width) for w in (weight * (p - y), weight * p * (1 - p), weight)]
    return np.stack(sums, axis=1).ravel()


def tree(histogram: Callable[[list[list], list[int]], np.ndarray], count: int, width: int, rate: float, l2: float, leaves: int, least: int) -> list[list]:
    """Nodes (feature, bin, left, right, value) of one tree; histogram: sums over all rows for the nodes so far. Nodes of the last level,
    and those too small to be split, get their values from their parent's sums."""
    nodes: list[list] = [[-1, 0, 0, 0, 0.0]]
    active, ends = [0], 1
    value = lambda x: float(-rate * x[0] / (x[1] + l2))
    while active and ends < max(leaves, 2):
        found = histogram(nodes, active).reshape(len(active), count, width, 3)
        sums = found[:, 0].sum(axis=1)
        for i, node in enumerate(active):
            nodes[node][4] = value(sums[i])
        gains, feature, bin_ = splits_of(found, l2, least)
        following: list[int] = []
        for i in sorted(range(len(active)), key=lambda i: (-gains[i], i)):
            if gains[i] <= 0 or ends >= leaves:
                break
            low = len(nodes)
            nodes[active[i]][:4] = [int(feature[i]), int(bin_[i]), low, low + 1]
            left = found[i, feature[i], : bin_[i] + 1].sum(axis=0)
            sides = (left, sums[i] - left)
            nodes += [[-1, 0, 0, 0, value(x)] for x in sides]
            following += [low + k for k, x in enumerate(sides) if x[2] >= 2 * least]
            ends += 1
        active = following
    return nodes


def _binned(df: DataFrame, edges: list[np.ndarray], features: list[str], label: str, start: float) -> DataFrame:
    """b0, b1 ..., y, weight and raw: rows of equal bins and label, with their number."""
    names = [f"b{i}" for i in range(len(edges))]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = [pa.array(np.searchsorted(e, b.column(f"b{i}").to_numpy(zero_copy_only=False), "left").astype(np.int32)) for i, e in enumerate(edges)]
            yield pa.RecordBatch.from_arrays([*bins, b.column("y")], [*names, "y"])

    rows = df.select(*(F.col(c).cast("double").alias(n) for n, c in zip(names, features, strict=True)), F.col(label).cast("double").alias("y"))
    rows = rows.mapInArrow(go, ", ".join([*(f"{n} int" for n in names), "y double"]))
    return kept(rows.groupBy(*names, "y").agg(F.count("*").cast("double").alias("weight")).withColumn("raw", F.lit(start)), "binned")


def _arrays(batch: pa.RecordBatch | pa.Table, count: int) -> tuple[np.ndarray, ...]:
    return np.stack([batch.column(f"b{i}").to_numpy() for i in range(count)]).astype(np.int64), *(batch.column(c).to_numpy() for c in ("y", "weight", "raw"))


def _by_levels(rows: DataFrame, total: int, shape: tuple, rounds: int) -> Iterator[list[list]]:
    """The trees of all rounds, a job a level."""
    count, width, context = shape[0], shape[1], rows.sparkSession.sparkContext
    parts = max(context.defaultParallelism, -(-total // BLOCK_ROWS))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            own, *rest = _arrays(pa.Table.from_batches(held).combine_chunks(), count)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (own.astype(np.int32), *rest)], ["own", "y", "weight", "raw"])

    def block(row) -> tuple[np.ndarray, ...]:
        return np.frombuffer(row["own"], np.int32).reshape(count, -1), *(np.frombuffer(row[c], np.float64) for c in ("y", "weight", "raw"))

    def grown(nodes: list[list]):
        values = np.array([x[4] for x in nodes])
        return lambda b: (*b[:3], b[3] + values[leaf_of(nodes, b[0])])

    def summed(so_far: list[list], active: list[int]) -> np.ndarray:
        return blocks.map(lambda b: histogram_of(*b, so_far, active, width)).treeReduce(np.add, depth=1 if parts <= DRIVER_ADDS else 2)

    blocks = rows.repartition(parts).mapInArrow(packed, "own binary, y binary, weight binary, raw binary").rdd.map(block).persist()
    before = None
    for i in range(rounds):
        nodes = tree(summed, *shape)
        yield nodes
        if before:
            before.unpersist()
        before, blocks = blocks, blocks.map(grown(nodes)).persist()
        if i % KEEP == KEEP - 1:
            path = scratch(rows.sparkSession, "boosted")
            blocks.saveAsPickleFile(path)
            blocks.unpersist()
            blocks = context.pickleFile(path, parts).persist()
    for held in (before, blocks):
        if held:
            held.unpersist()


def fit(df: DataFrame, features: list[str], label: str, rounds: int = ROUNDS, rate: float = RATE, l2: float = L2, leaves: int = LEAVES, least: int = LEAST, bins: int = BINS, at_once: int = ROWS_AT_ONCE) -> Booster:
    """What reaches the driver is sums by bin and the model: at most 2 * leaves - 1 nodes a round."""
    edges, count = edges_of(df, features, bins), len(features)
    pos, n = df.agg(F.sum(F.col(label).cast("double")), F.count("*")).first()
    if not n or not pos or pos == n:
        raise ValueError("a booster needs rows of both labels")
    start, width = float(np.log(pos / (n - pos))), max(len(e) for e in edges) + 1
    rows = _binned(df, edges, features, label, start)
    shape = (count, width, rate, l2, leaves, least)

    total = rows.count()

    def all_rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        own, y, weight, raw = _arrays(pa.Table.from_batches(held).combine_chunks(), count)
        for i in range(rounds):
            nodes = tree(lambda so_far, active: histogram_of(own, y, weight, raw, so_far, active, width), *shape)  # noqa: B023
            raw = raw + np.array([x[4] for x in nodes])[leaf_of(nodes, own)]
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(nodes)), pa.array(range(len(nodes))), *(pa.array(list(c)) for c in zip(*nodes, strict=True))], ["tree", "node", "feature", "bin", "left", "right", "value"])

    if total <= at_once:
        got = rows.orderBy(*rows.columns).coalesce(1).mapInArrow(all_rounds, "tree long, node long, feature long, bin long, left long, right long, value double").toPandas()
        trees = got.sort_values(["tree", "node"]).to_numpy()
    else:
        trees = np.array([(i, k, *x) for i, nodes in enumerate(_by_levels(rows, total, shape, rounds)) for k, x in enumerate(nodes)], float)
    of, whole = trees[:, 0].astype(int), trees[:, :6].astype(int)
    first = np.searchsorted(of, np.arange(rounds))
    return Booster(features, edges, start, first, whole[:, 2], whole[:, 3], whole[:, 4] + first[of], whole[:, 5] + first[of], trees[:, 6].astype(float))
