"""Centroid clustering against exact integers, with unusable vectors, repeats, ties and empties."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from candor.llm import clustering
from candor.llm.clustering import LIMIT, MOST, nearest

SCHEMA = "vec_id long, embedding array<double>, cluster string, n long, q string, key int"


def plain(rows, length, k, rounds):
    """Lloyd over all rows with Python's integers: (vec_id, cluster, distance) and centroids."""
    kept = [(i, [max(-LIMIT, min(LIMIT, math.floor(64 * x))) for x in v]) for i, v in rows if v is not None and len(v) == length and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "z", v) for i, v in kept)
    centroids = [list(v) for _, v in order[:k]]
    apart = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    assign = lambda: [min((apart(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        where = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, where, strict=True) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, c, d) for (i, _), (d, c) in zip(kept, assign(), strict=True)], centroids


def vectors(seed, length=8):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(i % 5, 0.3) for _ in range(length)]) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(90)]  # a hot vector
    rows += [(300, None), (301, []), (302, [1.0] * (length - 1)), (303, [None] + [0.0] * (length - 1)), (304, [float("nan")] * length), (305, [float("-inf")] + [1.0] * (length - 1))]
    rows += [(5, rows[7][1]), (5, rows[7][1]), (None, rows[9][1]), (306, [-1e-9] * length), (307, [0.0] * length), (308, [1e30] + [-1e30] * (length - 1))]
    return rows


@pytest.mark.parametrize("seed,k", [(1, 16), (2, 3), (3, 1)])
def test_equals_exact_integers(spark, seed, k):
    rows = vectors(seed)
    df = spark.createDataFrame([(i, v, "x", 1, "y", 2) for i, v in rows], SCHEMA).repartition(5)
    got = clustering.cluster(df, k=k, length=8).collect()
    want, centroids = plain(rows, 8, k, 3)
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["cluster"], r["distance"]) for r in got) == sorted((i is None, i or 0, c, d) for i, c, d in want)
    said = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    each = [sum(d for _, c, d in want if c == j) for j in range(len(centroids))]
    for r in got:
        assert r["centroid_sha256"] == said[r["cluster"]]
        assert r["cluster_inertia"] == min(MOST, each[r["cluster"]]) and r["inertia"] == min(MOST, sum(each))


def test_without_the_broadcast_the_result_is_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, v, "x", 1, "y", 2) for i, v in vectors(4)], SCHEMA)
    one = sorted(map(str, clustering.cluster(df, length=8).collect()))
    monkeypatch.setattr(clustering, "BROADCAST_ROWS", 0)
    assert sorted(map(str, clustering.cluster(df, length=8).collect())) == one


def test_empty_and_all_unusable(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert clustering.cluster(empty).count() == 0
    assert clustering.cluster(spark.createDataFrame([(1, [float("nan")] * 64, "", 0, "", 0)], SCHEMA)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_equal_starts_leave_the_later_ones_empty(spark):
    df = spark.createDataFrame([(i, [1.0] * 8, "", 0, "", 0) for i in range(40)], SCHEMA)
    got = clustering.cluster(df, k=4, length=8).collect()
    assert len(got) == 40 and {r["cluster"] for r in got} == {0} and {r["inertia"] for r in got} == {0}


def test_null_ids_alone(spark):
    rows = [(None, [float(i)] * 8) for i in range(5)]
    got = clustering.cluster(spark.createDataFrame([(i, v, "", 0, "", 0) for i, v in rows], SCHEMA), k=2, length=8).collect()
    assert sorted((r["cluster"], r["distance"]) for r in got) == sorted((c, d) for _, c, d in plain(rows, 8, 2, 3)[0])


def test_floats_are_taken_as_doubles(spark):
    x = float(np.float32(0.1) * 1)
    df = spark.createDataFrame([(1, [x] * 8)], "vec_id long, embedding array<float>")
    q = df.select(clustering.quantised(F.col("embedding"), 8).alias("q")).first()["q"]
    assert q == [math.floor(64 * x)] * 8


def test_distances_are_exact_for_large_numbers():
    rng = np.random.default_rng(1)
    v, c = rng.integers(-LIMIT, LIMIT, (50, 64)), rng.integers(-LIMIT, LIMIT, (5, 64))
    best, least = nearest(v, c)
    for x, b, d in zip(v.tolist(), best.tolist(), least.tolist(), strict=True):
        assert (d, b) == min((sum((p - q) ** 2 for p, q in zip(x, y, strict=True)), j) for j, y in enumerate(c.tolist()))


def test_weighted_sums_pass_64_bits(spark):
    distinct = spark.createDataFrame([([LIMIT] * 4, 1 << 40), ([-3] * 4, 7)], "q array<int>, n long")
    sums = clustering._sums(distinct, np.array([[LIMIT] * 4, [-3] * 4]))
    assert sums == {0: [LIMIT << 40] * 4 + [1 << 40], 1: [-21] * 4 + [7]}
