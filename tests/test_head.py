import numpy as np
import pytest
from pyspark.sql import functions as F

from candor.operators import head

LAYERS = 10  # four blocks of 4, 27 features


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    x, y, rows = rng.normal(size=(6, head.width(LAYERS))), np.array([0, 1, 1, 0, 1, 0.0]), np.arange(6)
    flat = head.initial(LAYERS) + rng.normal(size=head.initial(LAYERS).size) / 5
    for keys in (None, rows):
        loss = lambda f: head.cross_entropy(head._network(f, LAYERS, x, keys, 3)[0], y).sum()
        got, cross, right = head.gradient(flat, LAYERS, x, y, keys, 3)
        assert cross == pytest.approx(loss(flat))
        for i in range(flat.size):
            d = np.zeros_like(flat)
            d[i] = 1e-5
            assert got[i] == pytest.approx((loss(flat + d) - loss(flat - d)) / 2e-5, abs=1e-6)
    z = head.logits(flat, LAYERS, x)
    assert head.gradient(flat, LAYERS, x, y)[2] == sum((z > 0) == (y == 1))
    assert head.penalised(0.5, 0.75) == pytest.approx(0.6)


def test_widths_and_masks():
    assert [head.width(n) for n in (32, 16)] == [71, 39]
    assert head.initial(32).size == sum(int(np.prod(s)) for _, s in head.shapes(32))
    mask = head._mask(np.arange(4000), 1, 0, 20)
    assert set(np.unique(mask)) == {0, 1.25} and abs((mask == 0).mean() - 0.2) < 0.01
    assert (head._mask(np.arange(4000)[::-1], 1, 5, 3) == mask[::-1, 5:8]).all()


def test_fit_learns_and_repeats(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, head.width(LAYERS)))
    y = (x[:, 0] - x[:, 1] + x[:, 20] > 0).astype(int)
    rows = [(i, v.tolist(), int(t), "test" if i % 4 == 0 else "train") for i, (v, t) in enumerate(zip(x, y, strict=True))]
    rows += [(1000, None, 1, "train"), (1001, [1.0], 0, "train"), (1002, [float("nan")] * 27, 1, "train"), (1003, x[0].tolist(), None, "train")]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int, split string")
    fitted, log = head.fit(df, "v", "y", "id", LAYERS, epochs=17, rate=0.05, every=8)
    assert [r["epoch"] for r in log] == [0, 8, 16]
    assert max(r["auroc"] for r in log) > 0.85 and log[-1]["loss"] < log[0]["loss"]
    again, _ = head.fit(df.repartition(7), "v", "y", "id", LAYERS, epochs=17, rate=0.05, every=8)
    assert np.allclose(fitted.flat, again.flat, atol=1e-6)
    scored = {r["id"]: r["s"] for r in df.select("id", fitted.score(F.col("v")).alias("s")).collect()}
    assert scored[1000] is scored[1001] is scored[1002] is None
    want = 1 / (1 + np.exp(-head.logits(np.array(fitted.flat), LAYERS, (x - fitted.mean) / np.array(fitted.scale))))
    assert np.allclose([scored[i] for i in range(300)], want)
    with pytest.raises(ValueError):
        head.fit(df.where("y = 1"), "v", "y", "id", LAYERS, epochs=1)


def test_pseudo_labels_meet_the_shares(spark):
    rng = np.random.default_rng(2)
    s = rng.uniform(-1, 1, (200, 2)) + [0.2, 0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(s)] + [(900, None), (901, [0.1, None])], "id long, s array<double>")
    got = {r["id"]: r for r in head.pseudo_labels(df, "s", [0.3, 0.7], 0.1, rounds=200).collect()}
    p = np.array([got[i]["pseudo"] for i in range(200)])
    assert np.allclose(p.sum(axis=1), 1) and np.allclose(p.mean(axis=0), [0.3, 0.7], atol=1e-3)
    plan, factors = np.exp(s / 0.1), np.ones(2)
    for _ in range(200):
        factors *= [60, 140] / (plan * factors / (plan * factors).sum(axis=1, keepdims=True)).sum(axis=0)
    assert np.allclose(p, plan * factors / (plan * factors).sum(axis=1, keepdims=True))
    assert got[7]["entropy"] == pytest.approx(-sum(q * np.log(q) for q in p[7] if q > 0))
    assert got[900]["pseudo"] is None and got[901]["pseudo"] is None
