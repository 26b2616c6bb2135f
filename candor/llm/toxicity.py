"""Toxic spans by a linear-chain conditional random field.

Token labels come from document labels: word features (the word, and its first 4, 5 and 6 letters) that are significantly
more frequent in toxic than in clean labelled documents mark, in toxic documents, their tokens as toxic. A two-state
chain (clean, toxic) with these features and transitions is fitted by gradient ascent of the conditional likelihood.
Forward-backward gives each token's marginal; a document's score is a logistic function of the expected number of
toxic tokens and the largest marginal, and its spans are the runs of tokens with marginal of a half or more.

Tokens without any selected feature share one emission, so between two tokens with features the chain is a power of one
2 x 2 matrix, of whatever exponent, made by squaring: forward-backward runs over the tokens with features alone and is exact. A
document of any length is scored whole.

The model is fitted on a bounded sample of labelled rows: about SAMPLE_ROWS, as even between the classes as they allow,
chosen by a hash of doc_id; on all their tokens with features, equal windows counted together before they reach the driver.
Every row is scored.

Cases: null and empty texts have no tokens, no spans and the score of a document without toxic tokens; documents labelled twice
count as toxic if any label says so; null labels are left out; without labels of both classes all scores are 0.
Repeated rows score alike; other columns are left aside.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm.common import held_out, small_batches, staged

#: Labelled rows that the model is fitted on, about.
SAMPLE_ROWS = 20_000
#: A feature needs this many toxic documents, and its log odds this many standard errors.
LEAST_DOCS, LEAST_Z, LEAST_LOG_ODDS = 4, 3.5, 2.0
#: Training windows: tokens on each side of a token with features.
CONTEXT = 4
WORD = re.compile(r"[^\W_]+")


def features(word: str) -> list[str]:
    """Of a lower-case word."""
    return ["=" + word, *(word[:k] for k in (4, 5, 6) if len(word) > k)]


@dataclass
class Model:
    index: dict[str, int] = field(default_factory=dict)
    #: For each feature and the bias (last): what it adds to the toxic state's log potential.
    emission: np.ndarray = field(default_factory=lambda: np.zeros(1))
    #: Log potentials: transition[a, b] from state a to b, start[a].
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    #: Logistic weights: expected number (log1p), largest marginal, constant. None: nothing was learnt.
    document: np.ndarray | None = None

    def starts(self) -> set[str]:
        return {f[1:5] if f[0] == "=" else f[:4] for f in self.index}

    def ids(self, word: str) -> list[int]:
        return [self.index[f] for f in features(word) if f in self.index]


def tokens_with_features(text: str, model: Model, first: set[str]) -> tuple[int, list[tuple[int, int, int, list[int]]]]:
    """Number of tokens, and (token number, begin, end, feature ids) of those with features."""
    words = WORD.findall(text)
    wanted = {w for w in set(words) if w.lower()[:4] in first and model.ids(w.lower())}
    if not wanted:
        return len(words), []
    return len(words), [(k, m.start(), m.end(), model.ids(m[0].lower())) for k, m in enumerate(WORD.finditer(text)) if m[0] in wanted]


Square = tuple[float, float, float, float]


def _times(x: Square, y: Square) -> Square:
    """Product of 2 x 2 matrices (rows one after another), scaled to sum 1."""
    a, b, c, d = x[0] * y[0] + x[1] * y[2], x[0] * y[1] + x[1] * y[3], x[2] * y[0] + x[3] * y[2], x[2] * y[1] + x[3] * y[3]
    total = a + b + c + d
    return a / total, b / total, c / total, d / total


class Chain:
    """The chain of a model, with the powers of its step over tokens without features; scales cancel in marginals."""

    #: Powers kept, of the smallest exponents; others are made anew each time.
    KEPT = 4096

    def __init__(self, model: Model) -> None:
        self.model = model
        self.step: Square = tuple(np.exp(model.transition).ravel().tolist())
        self.plain = math.exp(model.emission[-1])
        s = self.step
        self.squares: list[Square] = [_times((1.0, 0.0, 0.0, 1.0), (s[0], s[1] * self.plain, s[2], s[3] * self.plain))]
        self.made: dict[int, Square] = {}

    def power(self, k: int) -> Square:
        """Over k tokens without features."""
        if k in self.made:
            return self.made[k]
        out, bit = (0.5, 0.0, 0.0, 0.5), 0
        while k >> bit:
            if len(self.squares) == bit:
                self.squares.append(_times(self.squares[-1], self.squares[-1]))
            if k >> bit & 1:
                out = _times(out, self.squares[bit])
            bit += 1
        if k < self.KEPT:
            self.made[k] = out
        return out

    def across(self, k: int) -> Square:
        """Over k tokens without features, then into the next token."""
        return _times(self.power(k), self.step)

    def marginals(self, n: int, at: list[int], ids: list[list[int]]) -> np.ndarray:
        """P(toxic) of the tokens `at` among n, the others having no features."""
        m = self.model
        emit = [math.exp(max(-50.0, min(50.0, float(m.emission[-1] + m.emission[x].sum())))) for x in ids]
        clean, toxic = (math.exp(x) for x in m.start)
        forward: list[tuple[float, float]] = []
        steps: list[Square] = []
        for k, (pos, e) in enumerate(zip(at, emit, strict=True)):
            if k or pos:
                if not k:
                    toxic *= self.plain
                steps.append(self.across(pos - at[k - 1] - 1 if k else pos - 1))
                p = steps[-1]
                clean, toxic = clean * p[0] + toxic * p[2], clean * p[1] + toxic * p[3]
            else:
                steps.append((1.0, 0.0, 0.0, 1.0))
            toxic *= e
            total = clean + toxic
            clean, toxic = clean / total, toxic / total
            forward.append((clean, toxic))
        p = self.power(n - 1 - at[-1])
        x, y = p[0] + p[1], p[2] + p[3]
        out = np.zeros(len(at))
        for k in range(len(at) - 1, -1, -1):
            a, b = forward[k][0] * x, forward[k][1] * y
            out[k] = b / (a + b)
            y *= emit[k]
            p = steps[k]
            x, y = p[0] * x + p[1] * y, p[2] * x + p[3] * y
            total = x + y
            x, y = x / total, y / total
        return out


def marginals(model: Model, n: int, at: list[int], ids: list[list[int]]) -> np.ndarray:
    return Chain(model).marginals(n, at, ids)


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def flush() -> Iterator[pa.RecordBatch]:
        for toxic, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([toxic] * len(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], ["feature", "toxic", "n"])
            counts.clear()

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            held[toxic].update({f for w in set(WORD.findall((text or "").lower())) for f in features(w)})
        if sum(map(len, held.values())) > 500_000:
            yield from flush()
    yield from flush()


def _fit_chain(windows: list[list[list[int]]], labels: list[list[int]], counts: list[int], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emission, transition and start by Adam on the conditional log likelihood of padded windows, each counted so many times."""
    steps = max(map(len, windows))
    most = max((len(x) for w in windows for x in w), default=1) or 1
    n, times, total = len(windows), np.array(counts, float), float(sum(counts))
    ids = np.full((n, steps, most), size + 1)  # size is the bias, size + 1 adds nothing
    y, here = np.zeros((n, steps), int), np.zeros((n, steps), bool)
    for i, (w, lab) in enumerate(zip(windows, labels, strict=True)):
        for t, x in enumerate(w):
            ids[i, t, : len(x)] = x
        y[i, : len(w)], here[i, : len(w)] = lab, True
    w, trans, start = np.zeros(size + 2), np.zeros((2, 2)), np.zeros(2)
    w[size] = -2.0
    params, moment, square = [w, trans, start], None, None
    for it in range(1, 121):
        u = w[ids].sum(axis=2) + w[size]
        e = np.exp(np.stack([np.zeros_like(u), np.clip(u, -50, 50)], axis=2))
        a = np.exp(trans)
        f = np.zeros((n, steps, 2))
        for t in range(steps):
            v = (np.exp(start) if t == 0 else f[:, t - 1] @ a) * e[:, t]
            f[:, t] = np.where(here[:, t, None], v / v.sum(axis=1, keepdims=True), f[:, t - 1] if t else 0.5)
        b = np.ones((n, steps, 2))
        gt = np.zeros((2, 2))
        for t in range(steps - 2, -1, -1):
            ahead = e[:, t + 1] * b[:, t + 1]
            v = ahead @ a.T
            live = here[:, t + 1]
            b[:, t] = np.where(live[:, None], v / v.sum(axis=1, keepdims=True), 1.0)
            joint = f[:, t, :, None] * a * ahead[:, None, :]
            joint = joint[live] / joint[live].sum(axis=(1, 2), keepdims=True)
            gt -= (joint * times[live, None, None]).sum(axis=0)
            np.add.at(gt, (y[live, t], y[live, t + 1]), times[live])
        g = f * b
        g /= g.sum(axis=2, keepdims=True)
        miss = np.where(here, y - g[:, :, 1], 0) * times[:, None]
        gw = np.bincount(ids.ravel(), np.repeat(miss.ravel(), most), size + 2)
        gw[size] = miss.sum()
        gw[size + 1] = 0
        gs = np.bincount(y[:, 0], times, minlength=2) - (g[:, 0] * times[:, None]).sum(axis=0)
        grads = [gw / total - 1e-3 * w, gt / total - 1e-3 * trans, gs / total - 1e-3 * start]
        moment = [0.1 * x for x in grads] if moment is None else [0.9 * m + 0.1 * x for m, x in zip(moment, grads, strict=True)]
        square = [0.01 * x * x for x in grads] if square is None else [0.99 * s + 0.01 * x * x for s, x in zip(square, grads, strict=True)]
        for p, m, s in zip(params, moment, square, strict=True):
            p += 0.15 * (m / (1 - 0.9**it)) / (np.sqrt(s / (1 - 0.99**it)) + 1e-8)
        w[size + 1] = 0
    return w[: size + 1].copy(), trans, start


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        w += np.linalg.solve(hess, x.T @ (y - p) - 1e-2 * w)
    return w


def summary(p: np.ndarray) -> tuple[float, float]:
    return (math.log1p(float(p.sum())), float(p.max())) if len(p) else (0.0, 0.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About `rows` labelled documents, as even between the classes as they allow: all whose hash of doc_id is below a
    share. The sample's keys are bounded by `rows`, so they are broadcast."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(~held_out(5, 0))
    n = {int(r["toxic"]): r["count"] for r in known.groupBy("toxic").count().collect()}
    toxic = min(n.get(1, 0), max(rows // 2, rows - n.get(0, 0)))
    share = {1: toxic / max(n.get(1, 0), 1), 0: (rows - toxic) / max(n.get(0, 0), 1)}
    unit = (F.xxhash64("doc_id") % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003.0
    keys = known.where(unit < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(keys), "doc_id").select("doc_id", "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model, from labelled rows that aren't held out."""
    spark = docs.sparkSession
    small_batches(spark)
    sample = staged(labelled_sample(docs, labels), "toxicity-sample")
    n = {int(r["toxic"]): r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return Model()
    counts = sample.select("text", "toxic").mapInArrow(_feature_counts, "feature string, toxic int, n long")
    both = counts.groupBy("feature").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (n[1] - F.col("bad") + 0.5)) - F.log((F.col("good") + 0.5) / (n[0] - F.col("good") + 0.5))
    error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    best = both.where(F.col("bad") >= LEAST_DOCS).select("feature", odds.alias("odds"), (odds / error).alias("z")).where((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_LOG_ODDS))
    kept = sorted(r["feature"] for r in best.select("feature").collect())
    model = Model(index={f: i for i, f in enumerate(kept)})
    if not kept:
        return model
    first, size = model.starts(), len(kept)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, toxic in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic")), strict=True):
                total, found = tokens_with_features(text or "", model, first)
                at = {k: x for k, _, _, x in found}
                centres = [k for k, *_ in found] or ([total // 2] if total else [])
                done = -1
                for k in centres:
                    if k > done:  # windows don't overlap
                        lo, done = max(done + 1, k - CONTEXT), min(total - 1, k + CONTEXT)
                        out.append((toxic, [at.get(t, []) for t in range(lo, done + 1)]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.list_(pa.list_(pa.int32())))], ["toxic", "ids"])

    got = sample.select("text", "toxic").mapInArrow(windows, "toxic int, ids array<array<int>>").groupBy("toxic", "ids").agg(F.count("*").alias("n")).collect()
    got.sort(key=lambda r: (r["toxic"], r["ids"]))
    chains = [[list(x) for x in r["ids"]] for r in got]
    labels_ = [[int(r["toxic"] and len(x) > 0) for x in w] for r, w in zip(got, chains, strict=True)]
    model.emission, model.transition, model.start = _fit_chain(chains, labels_, [r["n"] for r in got], size)
    pairs = _scan(sample.withColumn("held_out", F.lit(False)), model, "toxic").select("toxic", "expected", "largest").toPandas()
    model.document = _logistic(pairs[["expected", "largest"]].to_numpy(), pairs["toxic"].to_numpy())
    return model


def _scan(docs: DataFrame, model: Model, keep: str) -> DataFrame:
    """keep: a column handed through."""
    small_batches(docs.sparkSession)
    first, chain = model.starts(), Chain(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            expected, largest, spans, counts = [], [], [], []
            for text in batch.column("text").to_pylist():
                n, found = tokens_with_features(text or "", model, first)
                p = chain.marginals(n, [x[0] for x in found], [x[3] for x in found]) if found else np.zeros(0)
                a, b = summary(p)
                expected.append(a)
                largest.append(b)
                counts.append(n)
                runs: list[dict] = []
                before = -2
                for (k, lo, hi, _), q in zip(found, p, strict=True):
                    if q >= 0.5:
                        if runs and k == before + 1:
                            runs[-1]["end"], runs[-1]["p"] = hi, max(runs[-1]["p"], float(q))
                        else:
                            runs.append({"start": lo, "end": hi, "p": float(q)})
                        before = k
                spans.append(runs)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), batch.column(keep), pa.array(expected, pa.float64()), pa.array(largest, pa.float64()), pa.array(counts, pa.int32()), pa.array(spans, kind)], ["doc_id", "held_out", keep, "expected", "largest", "n_tokens", "spans"])

    kinds = dict(docs.dtypes)
    rows = docs.select("doc_id", "held_out", F.col("text").cast("string").alias("text"), *([keep] if keep not in ("doc_id", "held_out") else []))
    if keep in ("doc_id", "held_out"):
        rows, keep = rows.withColumn("_keep", F.lit(0)), "_keep"
        kinds["_keep"] = "int"
    return rows.mapInArrow(score, f"doc_id {kinds['doc_id']}, held_out boolean, {keep} {kinds[keep]}, expected double, largest double, n_tokens int, spans array<struct<start:int,end:int,p:double>>")


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, n_tokens, spans (code points, end exclusive) of each row of docs."""
    scanned = _scan(docs.withColumn("held_out", held_out(5, 0)), model, "doc_id")
    w = model.document
    score = F.lit(0.0) if w is None else 1 / (1 + F.exp(-(F.col("expected") * float(w[0]) + F.col("largest") * float(w[1]) + float(w[2]))))
    return scanned.select("doc_id", "held_out", score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"), "n_tokens", "spans")


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return predict(docs, fit(docs, labels))
