"""Fitting fusions and probes, out-of-fold evaluation, and thresholds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.functions.scores import dead_scale, fused
from candor.operators import boosting, metrics
from candor.operators.splits import folds, stratified
from candor.sources.files import kept


@dataclass
class Fusion:
    """Logistic fusion: what the shipped models are made of."""

    features: list[str]
    mean: list[float]
    scale: list[float]
    coef: list[float]
    intercept: float

    def score(self) -> Column:
        return fused([F.col(c) for c in self.features], self.mean, self.scale, self.coef, self.intercept)

    def frame(self, spark) -> DataFrame:
        """As a one-row parameter table, which is how models are kept."""
        return spark.createDataFrame([(self.features, self.mean, self.scale, self.coef, self.intercept)], "features array<string>, mean array<double>, scale array<double>, coef array<double>, intercept double")

    @staticmethod
    def read(df: DataFrame) -> Fusion:
        r = df.first()
        return Fusion(list(r["features"]), list(r["mean"]), list(r["scale"]), list(r["coef"]), r["intercept"])


def fusion(df: DataFrame, features: list[str], label: str, c: float = 1.0) -> Fusion:
    """Balanced logistic regression on standardised features; columns that hardly vary keep scale 1."""
    stats = df.agg(*(F.avg(x).alias(f"m_{i}") for i, x in enumerate(features)), *(dead_scale(F.var_pop(x)).alias(f"s_{i}") for i, x in enumerate(features)), F.count("*").alias("n"), F.sum(label).alias("pos")).first()
    mean, scale = [stats[f"m_{i}"] for i in range(len(features))], [stats[f"s_{i}"] for i in range(len(features))]
    n, pos = stats["n"], stats["pos"]
    weight = F.when(F.col(label) == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos)))
    scaled = df.select(*((F.col(x) - m) / s for x, m, s in zip(features, mean, scale, strict=True)), F.col(label).cast("double").alias("label"), weight.alias("weight")).toDF(*(f"x{i}" for i in range(len(features))), "label", "weight")
    data = VectorAssembler(inputCols=[f"x{i}" for i in range(len(features))], outputCol="features").transform(scaled)
    model = LogisticRegression(weightCol="weight", standardization=False, regParam=1 / (c * n), maxIter=200, tol=1e-9).fit(data)
    return Fusion(features, mean, scale, [float(v) for v in model.coefficients], float(model.intercept))


@dataclass
class Fit:
    """One of several fusions to be fitted at once: its features, the rows it learns from, and its strength."""

    name: str
    features: list[str]
    train: Column
    c: float = 1.0


def fusions(df: DataFrame, fits: list[Fit], label: str, steps: int = 50, tol: float = 1e-10) -> dict[str, Fusion]:
    """What `fusion` gives for each fit, all by Newton's method side by side: a pass over the rows a step, in which every task adds up
    the normal equations of all fits. Passes end when no coefficient moves. The equations reach the driver, summed: (features + 1) ** 2
    numbers a fit, whatever the number of rows."""
    names = sorted({c for f in fits for c in f.features})
    rows = kept(df.select(F.col(label).cast("double").alias("_y"), *(F.col(c).cast("double").alias(c) for c in names), F.array(*(F.coalesce(f.train, F.lit(False)) for f in fits)).alias("_in")), "fits")
    at, many = [[names.index(c) for c in f.features] for f in fits], len(fits)

    def summed(of) -> dict[int, np.ndarray]:
        """Sums over all rows of of(fit number, x, y), arrays of one dimension."""

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for b in batches:
                y, x = b.column("_y").to_numpy(), np.stack([b.column(c).to_numpy() for c in names], axis=1)
                inside = b.column("_in").flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
                for i in range(many):
                    mine = inside[:, i]
                    held[i] = held.get(i, 0) + of(i, x[mine][:, at[i]], y[mine])
            for i, v in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(v), pa.int32()), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], ["fit", "k", "v"])

        got = rows.mapInArrow(go, "fit int, k int, v double").groupBy("fit", "k").agg(F.sum("v").alias("v")).toPandas().sort_values(["fit", "k"])
        return {int(i): g["v"].to_numpy() for i, g in got.groupby("fit")}

    first = summed(lambda i, x, y: np.r_[len(y), y.sum(), x.sum(axis=0)])
    mean = [first[i][2:] / max(first[i][0], 1) if i in first else np.zeros(len(at[i])) for i in range(len(fits))]
    second = summed(lambda i, x, y: ((x - mean[i]) ** 2).sum(axis=0))
    for i, f in enumerate(fits):
        if i not in first or not 0 < first[i][1] < first[i][0]:
            raise ValueError(f"{f.name}: rows of both labels are needed")
    variance = [second[i] / first[i][0] for i in range(len(fits))]
    scale = [np.where(v < 1e-12, 1.0, np.sqrt(v)) for v in variance]
    weight = [(n / (2 * (n - pos)), n / (2 * pos)) for n, pos in (first[i][:2] for i in range(len(fits)))]
    beta = [np.zeros(len(f.features) + 1) for f in fits]  # the last is the intercept
    for _ in range(steps):

        def equations(i: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            z = np.c_[(x - mean[i]) / scale[i], np.ones(len(y))]
            p = 1 / (1 + np.exp(-(z @ beta[i])))
            w = np.where(y == 1, weight[i][1], weight[i][0])
            return np.r_[z.T @ (w * (p - y)), ((z * (w * p * (1 - p))[:, None]).T @ z).ravel()]

        sums, moved = summed(equations), 0.0
        for i, f in enumerate(fits):
            size = len(beta[i])
            ridge = np.r_[np.full(size - 1, 1 / f.c), 0.0]
            gradient, hessian = sums[i][:size] + ridge * beta[i], sums[i][size:].reshape(size, size) + np.diag(ridge)
            step = np.linalg.solve(hessian + 1e-12 * np.eye(size), gradient)
            step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))  # no coefficient moves by more than 5 at once
            beta[i] = beta[i] - step
            moved = max(moved, float(np.abs(step).max()))
        if moved < tol:
            break
    return {f.name: Fusion(f.features, mean[i].tolist(), scale[i].tolist(), beta[i][:-1].tolist(), float(beta[i][-1])) for i, f in enumerate(fits)}


def boosted(df: DataFrame, features: list[str], label: str, rounds: int = boosting.ROUNDS) -> DataFrame:
    """df with fused by gradient-boosted trees on histograms."""
    return boosting.fit(df, features, label, rounds).score(df)


def probes(df: DataFrame, vector: str, label: str, c: float = 0.1, steps: int = 200, tol: float = 1e-7, block: int = 4096) -> tuple[list[float], float]:
    """Logistic probe on an array column of any width, by L-BFGS; the probe of the other class is its mirror. Gradients are added up in
    blocks of coordinates on the executors, so what a pass sends to the driver is one vector, whatever the number of tasks."""
    rows = kept(df.select(F.col(vector).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y")), "probe")
    width = rows.agg(F.max(F.size("x"))).first()[0]
    spark = df.sparkSession

    def part(w) -> DataFrame:
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, weights = np.zeros(width + 2), w.value
            for b in batches:
                x, y = b.column("x").flatten().to_numpy().reshape(-1, width), b.column("y").to_numpy()
                z = x @ weights[:-1] + weights[-1]
                off = 1 / (1 + np.exp(-z)) - y
                total[:width] += x.T @ off
                total[width:] += off.sum(), np.logaddexp(0, z).sum() - (y * z).sum()
            cuts = range(0, width + 2, block)
            yield pa.RecordBatch.from_arrays([pa.array([i // block for i in cuts]), pa.array([total[i : i + block] for i in cuts])], ["block", "v"])

        return rows.mapInArrow(go, "block long, v array<double>")

    def added(group: pa.Table) -> pa.Table:
        flat = np.stack([x.values.to_numpy() for x in group.column("v")]).sum(axis=0)
        return pa.table({"block": [group.column("block")[0].as_py()], "v": [flat]})

    def objective(at: np.ndarray) -> tuple[float, np.ndarray]:
        held = spark.sparkContext.broadcast(at)
        got = part(held).groupBy("block").applyInArrow(added, "block long, v array<double>").collect()
        held.unpersist()
        total = np.concatenate([r["v"] for r in sorted(got, key=lambda r: r["block"])])
        return total[-1] + at[:-1] @ at[:-1] / (2 * c), np.r_[total[:width] + at[:-1] / c, total[width]]

    at = np.zeros(width + 1)
    value, gradient = objective(at)
    history: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(gradient).max() <= tol * max(1.0, abs(value)):
            break
        ahead, used = gradient.copy(), []
        for s, g in reversed(history):
            used.append(a := (s @ ahead) / (s @ g))
            ahead -= a * g
        if history:
            s, g = history[-1]
            ahead *= (s @ g) / (g @ g)
        else:
            ahead /= max(np.abs(ahead).max(), 1.0)
        for (s, g), a in zip(history, reversed(used), strict=True):
            ahead += (a - (g @ ahead) / (s @ g)) * s
        rate = 1.0
        while True:
            new_value, new_gradient = objective(at - rate * ahead)
            if new_value <= value - 1e-4 * rate * (gradient @ ahead) or rate < 1e-10:
                break
            rate /= 2
        if (s := -rate * ahead) @ (g := new_gradient - gradient) > 1e-14:
            history = [*history, (s, g)][-10:]
        if rate < 1e-10:
            break
        at, value, gradient = at + s, new_value, new_gradient
    return at[:-1].tolist(), float(at[-1])


def out_of_fold(df: DataFrame, features: list[str], label: str, row_id: str, k: int = 5, c: float = 0.3) -> DataFrame:
    """df with fused of models that haven't seen the row; all folds are fitted at once."""
    parts = folds(df, label, row_id, k)
    models = fusions(parts, [Fit(str(i), features, F.col("fold") != i, c) for i in range(k)], label)
    return parts.withColumn("fused", F.get(F.array(*(models[str(i)].score() for i in range(k))), F.col("fold").cast("int")))


def honest(df: DataFrame, heads: dict[str, list[str]], passed: list[str], label: str, row_id: str, k: int = 5, c: float = 0.1, fusion_c: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Training and test rows with a score of each head and, in the test rows, their fusion. Heads learn from the training rows only; in
    those, each row has the scores of models that haven't seen it, and on these the fusion (with the columns passed on) is
    fitted. One pass a step for all heads and folds."""
    split = stratified(df, label, row_id, 0.25)
    train = folds(split.where("split = 'train'").drop("split"), label, row_id, k)
    rows = kept(train.unionByName(split.where("split = 'test'").drop("split").withColumn("fold", F.lit(-1).cast(train.schema["fold"].dataType))), "honest")
    fits = [Fit(f"{h} {i}", x, (F.col("fold") >= 0) & (F.col("fold") != i), c) for h, x in heads.items() for i in range(-1, k)]
    models = fusions(rows, fits, label)
    own = lambda h: F.get(F.array(*(models[f"{h} {i}"].score() for i in range(-1, k))), (F.col("fold") + 1).cast("int"))
    scored = rows.withColumns({h: own(h) for h in heads})
    train, test = scored.where("fold >= 0"), scored.where("fold < 0").drop("fold")
    top = fusions(train, [Fit("fused", [*heads, *passed], F.lit(True), fusion_c)], label)["fused"]
    return train, test.withColumn("fused", top.score())


def calibrated(train: DataFrame, label: str, score: str) -> tuple[float, float]:
    """(t_med, t_high): the best F1 cut of the training scores, and 0.6 of it rounded to three digits."""
    rows = train.select(F.lit(0).alias("k"), F.col(label).alias("y"), F.col(score).alias("s"))
    high = metrics.best_threshold(rows, ["k"]).first()["threshold"]
    return math.floor(600 * high + 0.5) / 1000, high


def pull_centroids(c: list[float], x: list[float], decay: float = 0.99) -> list[float]:
    """One step of the moving average of a class centroid."""
    out = [decay * a + (1 - decay) * b for a, b in zip(c, x, strict=True)]
    norm = math.sqrt(sum(v * v for v in out)) or 1.0
    return [v / norm for v in out]
