"""The four-block head on layer features: its forward pass, its loss, and its training.

A vector of 4 * (L / 2 - 1) + 11 features of an L-layer model is four blocks and eleven statistics. Each block is normalised
and mapped to half its width; these and the statistics are normalised, mapped, normalised, and mapped to one logit.

The parameters are one flat array of some 1,200 numbers, and every epoch is one pass over the rows: each Arrow batch sends its sum
of gradients, which are added on the executors, so the driver gets one row a parameter. Dropout masks are hashes of row id, epoch and
unit, so a lost task's second run and another partitioning draw the same ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from candor.operators import metrics

STATISTICS = 11
DROPOUT = 0.2
PENALTY = 0.4
EPSILON = 1e-5


def width(layers: int) -> int:
    return 4 * (layers // 2 - 1) + STATISTICS


def shapes(layers: int) -> list[tuple[str, tuple[int, ...]]]:
    """Names and shapes of the parameters, in the order of the flat array."""
    block = layers // 2 - 1
    half = block // 2
    joined = 4 * half + STATISTICS
    out = [p for b in range(4) for p in ((f"{b}.gain", (block,)), (f"{b}.shift", (block,)), (f"{b}.weight", (block, half)), (f"{b}.bias", (half,)))]
    for name, n, m in (("a", joined, 2 * half), ("b", 2 * half, 1)):
        out += [(f"{name}.gain", (n,)), (f"{name}.shift", (n,)), (f"{name}.weight", (n, m)), (f"{name}.bias", (m,))]
    return out


def unflat(flat: np.ndarray, layers: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes(layers):
        n = math.prod(shape)
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def initial(layers: int, seed: int = 42) -> np.ndarray:
    """Gains 1, shifts 0, weights and biases uniform within 1 / sqrt(inputs)."""
    rng = np.random.default_rng(seed)
    parts, fan = [], 1
    for name, shape in shapes(layers):
        kind = name.split(".")[1]
        if kind in ("gain", "shift"):
            parts.append(np.full(shape, float(kind == "gain")))
            fan = shape[0]
        else:
            parts.append(rng.uniform(-1, 1, shape) / math.sqrt(fan))
    return np.concatenate([p.ravel() for p in parts])


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _mask(rows: np.ndarray | None, epoch: int, at: int, n: int) -> np.ndarray | float:
    """What a layer's n inputs are multiplied by: 0 for a fifth of them, 1.25 for the rest; 1 without rows (no dropout)."""
    if rows is None:
        return 1.0
    start = np.uint64(epoch * 0x9E3779B97F4A7C15 % (1 << 64))
    unit = _mix(_mix(rows.astype(np.uint64) + start)[:, None] + np.arange(at, at + n, dtype=np.uint64))
    return (unit / 2.0**64 >= DROPOUT) / (1 - DROPOUT)


class _Layer:
    """Normalise, drop out, map; forward and backward."""

    def __init__(self, p: dict[str, np.ndarray], name: str, mask):
        self.p, self.name, self.mask = p, name, mask

    def forward(self, x: np.ndarray) -> np.ndarray:
        gain, shift, weight, bias = (self.p[f"{self.name}.{k}"] for k in ("gain", "shift", "weight", "bias"))
        self.spread = np.sqrt(x.var(axis=1, keepdims=True) + EPSILON)
        self.unit = (x - x.mean(axis=1, keepdims=True)) / self.spread
        self.inner = (self.unit * gain + shift) * self.mask
        return self.inner @ weight + bias

    def backward(self, d: np.ndarray, grad: dict[str, np.ndarray]) -> np.ndarray:
        grad[f"{self.name}.weight"][...] = self.inner.T @ d
        grad[f"{self.name}.bias"][...] = d.sum(axis=0)
        d = (d @ self.p[f"{self.name}.weight"].T) * self.mask
        grad[f"{self.name}.gain"][...] = (d * self.unit).sum(axis=0)
        grad[f"{self.name}.shift"][...] = d.sum(axis=0)
        d = d * self.p[f"{self.name}.gain"]
        return (d - d.mean(axis=1, keepdims=True) - self.unit * (d * self.unit).mean(axis=1, keepdims=True)) / self.spread


def _network(flat: np.ndarray, layers: int, x: np.ndarray, rows: np.ndarray | None = None, epoch: int = 0):
    """Logits, and the layers for the way back."""
    p, block = unflat(flat, layers), layers // 2 - 1
    half = block // 2
    joined = 4 * half + STATISTICS
    blocks = [_Layer(p, str(b), _mask(rows, epoch, b * block, block)) for b in range(4)]
    a = _Layer(p, "a", _mask(rows, epoch, 4 * block, joined))
    b = _Layer(p, "b", _mask(rows, epoch, 4 * block + joined, 2 * half))
    parts = [layer.forward(x[:, i * block : (i + 1) * block]) for i, layer in enumerate(blocks)]
    return b.forward(a.forward(np.hstack([*parts, x[:, 4 * block :]])))[:, 0], (blocks, a, b)


def logits(flat: np.ndarray, layers: int, x: np.ndarray) -> np.ndarray:
    return _network(flat, layers, x)[0]


def cross_entropy(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z) - z * y


def gradient(flat: np.ndarray, layers: int, x: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None, epoch: int = 0) -> tuple[np.ndarray, float, int]:
    """Sums over the rows: gradient of the cross-entropy, the cross-entropy, and right answers."""
    z, (blocks, a, b) = _network(flat, layers, x, rows, epoch)
    out = np.zeros_like(flat)
    grad = unflat(out, layers)
    back = a.backward(b.backward((0.5 * (1 + np.tanh(z / 2)) - y)[:, None], grad), grad)
    half = (layers // 2 - 1) // 2
    for i, layer in enumerate(blocks):
        layer.backward(back[:, i * half : (i + 1) * half], grad)
    return out, float(cross_entropy(z, y).sum()), int(((z > 0) == (y == 1)).sum())


def penalised(cross: float, right: float) -> float:
    """The loss: mean cross-entropy, and 0.4 of the share of wrong answers, which has no gradient."""
    return cross + PENALTY * (1 - right)


@dataclass
class Head:
    """A trained head: mean and scale of the features, and the flat parameters."""

    layers: int
    mean: list[float]
    scale: list[float]
    flat: list[float]

    def score(self, vector: Column) -> Column:
        """Probability of label 1; null where the vector is null, of another width, or holds a null or non-finite value."""
        layers, mean, scale, flat = self.layers, np.array(self.mean), np.array(self.scale), np.array(self.flat)

        @pandas_udf("double")
        def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for v in batches:
                good = v.notna().to_numpy()
                out = np.full(len(v), np.nan)
                if good.any():
                    out[good] = 0.5 * (1 + np.tanh(logits(flat, layers, (np.vstack(v[good]) - mean) / scale) / 2))
                yield pd.Series(out).astype(object).where(good, None)

        return apply(usable(vector, layers))


def usable(vector: Column, layers: int) -> Column:
    """The vector as doubles, or null if it can't be scored."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when((F.size(v) == width(layers)) & ~bad, v)


def _sums(train: DataFrame, flat: np.ndarray, layers: int, mean: np.ndarray, scale: np.ndarray, epoch: int) -> tuple[np.ndarray, float, float, int]:
    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, cross, right, n = np.zeros_like(flat), 0.0, 0, 0
        for b in batches:
            if len(b):
                g, c, r = gradient(flat, layers, (np.vstack(b["x"]) - mean) / scale, b["y"].to_numpy(), b["key"].to_numpy(), epoch)
                total, cross, right, n = total + g, cross + c, right + r, n + len(b)
        if n:
            yield pd.DataFrame({"g": [np.concatenate([total, [cross, right, n]])]})

    summed = train.mapInPandas(part, "g array<double>").select(F.posexplode("g").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
    values = np.array([r["v"] for r in summed.orderBy("k").collect()])  # a row a parameter
    n = values[-1]
    return values[:-3] / n, values[-3] / n, values[-2] / n, int(n)


def fit(df: DataFrame, vector: str, label: str, row_id: str, layers: int, split: str = "split", epochs: int = 300, rate: float = 1e-3, decay: float = 1e-4, seed: int = 42, every: int = 10) -> tuple[Head, list[dict]]:
    """The head of best AUROC on the test rows, looked at each `every` epochs, and the log of these looks (epoch, loss, auroc).

    Adaptive moments with decoupled weight decay, on all training rows an epoch. Class weights multiply the mean loss, and their mean
    over all rows is 2 whatever the balance, so they double the gradient. Rows without label or usable vector take no part; without
    both classes in the training rows there is nothing to fit (ValueError); without both in the test rows the last look is taken.
    """
    rows = df.select(usable(F.col(vector), layers).alias("x"), F.col(label).cast("double").alias("y"), F.xxhash64(F.col(row_id)).alias("key"), F.col(split).alias("split")).where("x is not null and y is not null").cache()
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    moments = train.select("y", F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.min("y").alias("lo"), F.max("y").alias("hi")).orderBy("k").collect()  # a row a feature
    if not moments or moments[0]["lo"] == moments[0]["hi"]:
        rows.unpersist()
        raise ValueError("the training rows need both classes")
    mean, scale = np.array([r["m"] for r in moments]), np.array([r["s"] or 1.0 for r in moments])
    flat, best, log = initial(layers, seed), (-1.0, None), []
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    for epoch in range(epochs):
        g, cross, right, _ = _sums(train, flat, layers, mean, scale, epoch)
        g = 2 * g
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        step = first / (1 - 0.9 ** (epoch + 1)) / (np.sqrt(second / (1 - 0.999 ** (epoch + 1))) + 1e-8)
        flat = flat * (1 - rate * decay) - rate * step
        if epoch % every == 0 or epoch == epochs - 1:
            head = Head(layers, mean.tolist(), scale.tolist(), flat.tolist())
            seen = test.select(F.lit(0).alias("k"), F.col("y").cast("int").alias("y"), head.score(F.col("x")).alias("s"))
            found = metrics.auroc(seen, ["k"]).first()
            auroc = found["auroc"] if found else None
            log.append({"epoch": epoch, "loss": 2 * penalised(cross, right), "auroc": auroc})
            if auroc is None or auroc > best[0]:
                best = (best[0] if auroc is None else auroc, head)
    rows.unpersist()
    return best[1], log


def pseudo_labels(df: DataFrame, similarities: str, shares: list[float], temperature: float = 0.05, rounds: int = 3) -> DataFrame:
    """df with pseudo (array of class probabilities whose totals over the table approach the shares) and entropy (nats).

    Rows are exponentials of similarity by temperature; each round scales classes to their shares, then rows to 1. A round is one
    aggregate with a row a class, and only the class factors go from round to round. Rows whose similarities are null, or hold a null
    or NaN, get null and don't count. A class of no weight keeps factor 1.
    """
    k = len(shares)
    v = F.col(similarities)
    good = (F.size(v) == k) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
    plan = F.when(good, F.transform(v, lambda x: F.exp((x - F.array_max(v)) / temperature)))
    out = df.withColumn("_plan", plan)
    factors = [1.0] * k

    def balanced(factors: list[float]) -> Column:
        raw = F.transform("_plan", lambda x, i: x * F.get(F.array(*map(F.lit, factors)), i))
        return F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda a, b: a + b))

    for _ in range(rounds):
        row = out.select(balanced(factors).alias("p")).agg(F.count("p").alias("n"), *(F.sum(F.get("p", F.lit(i))).alias(f"s{i}") for i in range(k))).first()
        factors = [f * share * row["n"] / row[f"s{i}"] if row[f"s{i}"] else f for i, (f, share) in enumerate(zip(factors, shares, strict=True))]
        top = max(factors) or 1.0
        factors = [f / top for f in factors]
    out = out.withColumn("pseudo", balanced(factors))
    entropy = F.aggregate("pseudo", F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.ln(p)).otherwise(0.0))
    return out.withColumn("entropy", entropy).drop("_plan")
