"""Fits against plain numpy: the booster's trees, many fusions in one pass, wide probes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from candor.operators import boosting, fitting


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 3)).round(3)
    y = (x[:, 0] * x[:, 1] + 0.5 * x[:, 2] + rng.normal(scale=0.5, size=1500) > 0).astype(int)
    rows = [(i, int(v), *map(float, a)) for i, (v, a) in enumerate(zip(y, x, strict=True))]
    return x, y, spark.createDataFrame(rows, "id long, y int, a double, b double, c double").cache()


def plain_booster(x, y, edges, rounds, rate=0.05, l2=1.0, leaves=31, least=20):
    """Raw scores by a row-by-row reference: every split is tried on the rows themselves."""
    bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    start = np.log(y.mean() / (1 - y.mean()))
    raw = np.full(len(y), start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        level, done, ends = [np.arange(len(y))], [], 1
        while level:
            tried = []
            for rows in level:
                best = (0.0, None)
                for f in range(bins.shape[1]):
                    for b in range(len(edges[f])):
                        low = bins[rows, f] <= b
                        if min(low.sum(), (~low).sum()) < least:
                            continue
                        part = lambda m: g[rows[m]].sum() ** 2 / (h[rows[m]].sum() + l2)  # noqa: E731, B023
                        gain = round(part(low) + part(~low) - part(low | ~low), 9)
                        if gain > best[0]:
                            best = (gain, (rows[low], rows[~low]))
                tried.append((best, rows))
            level = []
            for (_, split), rows in sorted(tried, key=lambda t: -t[0][0]):
                if split is None or ends >= leaves:
                    done.append(rows)
                else:
                    level += split
                    ends += 1
        for rows in done:
            raw[rows] -= rate * g[rows].sum() / (h[rows].sum() + l2)
    return raw


@pytest.mark.parametrize("at_once", [10_000, 0])
def test_booster_equals_the_plain_one(data, at_once):
    """In one task, and with a job a level."""
    x, y, df = data
    model = boosting.fit(df, ["a", "b", "c"], "y", rounds=5, bins=16, leaves=9, at_once=at_once)
    want = plain_booster(x, y, model.edges, 5, leaves=9)
    assert np.allclose(model.raw(list(x.T)), want, atol=1e-9)
    got = {r["id"]: r["fused"] for r in model.score(df).select("id", "fused").collect()}
    assert np.allclose([got[i] for i in range(len(y))], 1 / (1 + np.exp(-want)), atol=1e-9)


def test_booster_by_levels_takes_a_small_job_a_level(spark, data):
    """More rounds than the blocks are kept for; the trees are those of one task."""
    _, _, df = data
    context = spark.sparkContext
    context.setJobGroup("levels", "levels")
    got = boosting.fit(df, ["a", "b", "c"], "y", rounds=20, at_once=0)
    jobs = len(context.statusTracker().getJobIdsForGroup("levels"))
    context.setLocalProperty("spark.jobGroup.id", None)
    want = boosting.fit(df, ["a", "b", "c"], "y", rounds=20)
    assert got.roots.tolist() == want.roots.tolist() and got.feature.tolist() == want.feature.tolist() and np.allclose(got.value, want.value, atol=1e-9)
    assert jobs <= 20 * 7


def test_booster_learns_in_300_rounds(data):
    _, y, df = data
    scored = fitting.boosted(df.where("id % 3 > 0"), ["a", "b", "c"], "y").count()
    model = boosting.fit(df.where("id % 3 > 0"), ["a", "b", "c"], "y")
    out = model.score(df.where("id % 3 = 0")).select("y", "fused").collect()
    assert scored == 1000 and len(model.roots) == 300
    assert np.mean([(r["fused"] > 0.5) == r["y"] for r in out]) > 0.75


def test_booster_with_missing_values_and_one_label(spark, data):
    _, _, df = data
    holes = df.withColumn("a", F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 7 == 0, float("nan")).otherwise(F.col("a")))
    assert boosting.fit(holes, ["a", "b"], "y", rounds=3).score(holes).where("fused between 0 and 1").count() == 1500
    with pytest.raises(ValueError):
        boosting.fit(df.where("y = 1"), ["a"], "y", rounds=2)


def test_many_fits_equal_single_ones(data):
    _, _, df = data
    fits = [fitting.Fit("all", ["a", "b", "c"], F.lit(True), 1.0), fitting.Fit("few", ["c"], F.col("id") % 4 > 0, 0.3), fitting.Fit("strong", ["a", "c"], F.col("id") < 900, 0.01)]
    got = fitting.fusions(df, fits, "y")
    for f in fits:
        one = fitting.fusion(df.where(f.train), f.features, "y", f.c)
        assert np.allclose(got[f.name].mean, one.mean) and np.allclose(got[f.name].scale, one.scale)
        assert np.allclose([*got[f.name].coef, got[f.name].intercept], [*one.coef, one.intercept], atol=1e-5)
    with pytest.raises(ValueError, match="none"):
        fitting.fusions(df, [fitting.Fit("none", ["a"], F.lit(False))], "y")


def test_out_of_fold_scores_are_those_of_the_other_folds(data):
    _, _, df = data
    out = fitting.out_of_fold(df, ["a", "c"], "y", "id", 3)
    model = fitting.fusion(out.where("fold <> 1"), ["a", "c"], "y", 0.3)
    assert out.where("fold = 1").select(F.max(F.abs(F.col("fused") - model.score()))).first()[0] < 1e-5


def test_honest_rows(data):
    _, y, df = data
    train, test = fitting.honest(df, {"h": ["a", "b"], "k": ["c"]}, ["c"], "y", "id")
    assert train.count() + test.count() == 1500 and abs(test.count() - 375) <= 2
    assert {"h", "k", "fused"} <= set(test.columns) and test.where("fused is null or h is null").count() == 0
    ids = {r["id"] for r in train.select("id").collect()}
    alone = fitting.fusion(df.where(F.col("id").isin(list(ids))), ["c"], "y", 0.1)
    assert test.select(F.max(F.abs(F.col("k") - alone.score()))).first()[0] < 1e-5


def test_probes_equal_newton_and_mirror(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 11))
    y = (x[:, 0] - x[:, 3] + rng.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([(v.tolist(), int(t)) for v, t in zip(x, y, strict=True)], "v array<double>, y int").repartition(3)
    z, beta = np.c_[x, np.ones(300)], np.zeros(12)
    ridge = np.r_[np.full(11, 10.0), 0]
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * beta)
    coef, intercept = fitting.probes(df, "v", "y", block=4)
    assert np.allclose([*coef, intercept], beta, atol=1e-4)
    other, back = fitting.probes(df.withColumn("y", 1 - F.col("y")), "v", "y", block=4)
    assert np.allclose([*other, back], [-v for v in [*coef, intercept]], atol=1e-4)
