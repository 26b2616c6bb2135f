"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds the vectors of its letters, each rotated by its
place, by elementwise product; bundling (summing) the trigram vectors of a text gives the text's vector, and that of a
language's training texts its prototype. A text gets the language whose prototype has the largest cosine with it.

The dot product of a text with a prototype is the sum, over the text's trigrams, of the trigram's dot product with the
prototype. Those are tabulated once for the letters' cube, so a text costs a table look-up per letter while the result
is that of the vectors themselves. Trigram vectors are nearly orthogonal, so the text vector's norm is taken as that of
the trigram counts.

Cases: null text, empty text and text without a letter get `und` with score 0; so do all texts if there is nothing to
learn from. Repeated rows are scored alike; ties go to the first language in alphabetical order; other columns are
left aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm.common import held_out, slices, small_batches

DIMENSIONS = 2048
#: Letter codes: 0 is any run of other characters, then a to z, then Latin-1 letters, then groups of all other letters.
LETTERS = 80
CUBE = LETTERS**3
UNDETERMINED = "und"
#: Languages that can be learnt at most; each takes 2 MB of the table that is broadcast. More are an error.
MOST_LANGUAGES = 256
#: A text is in none of the languages if its fit to each is below this, in standard errors; see `Typical`. Of 12,800 held-out texts of 0.1 GB
#: the worst had -3.75, and 12 less than -2.85; texts of 40 random words had -5.2 and less.
LEAST_FIT = -4.0
#: Each letter is in three trigrams, so a text has a third as many independent ones.
OVERLAP = 3.0
#: Trigrams of a text from which on it counts for how much texts of a language differ.
ENOUGH = 100
#: How sharply cosines turn into a score.
SHARPNESS = 24.0


@lru_cache(1)
def letter_codes() -> np.ndarray:
    codes = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            if 97 <= low <= 122:
                codes[cp] = low - 96
            elif 0xDF <= low <= 0xFF:
                codes[cp] = 27 + low - 0xDF
            else:
                codes[cp] = 60 + (low * 2654435761 >> 7) % (LETTERS - 60)
    return codes


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram codes, the text each belongs to, and which texts have a letter."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    joined = " " + "  ".join(texts) + " "
    codes = letter_codes()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lens)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0) | (owner[1:] != owner[:-1])
    codes, owner = codes[keep].astype(np.int32), owner[keep]
    lettered = np.bincount(owner[codes > 0], minlength=len(texts)) > 0
    inside = (owner[2:] == owner[:-2]) & (codes[1:-1] > 0)
    grams = (codes[:-2] * (LETTERS * LETTERS) + codes[1:-1] * LETTERS + codes[2:])[inside]
    return grams, owner[2:][inside], lettered


@lru_cache(1)
def letter_vectors() -> np.ndarray:
    return (np.random.default_rng(9).integers(0, 2, (LETTERS, DIMENSIONS), dtype=np.int8) * 2 - 1).astype(np.float32)


def trigram_vectors(grams: np.ndarray) -> np.ndarray:
    v = letter_vectors()
    once, twice = np.roll(v, 1, axis=1), np.roll(v, 2, axis=1)
    return twice[grams // LETTERS**2] * once[grams // LETTERS % LETTERS] * v[grams % LETTERS]


def prototypes(counts: np.ndarray, grams: np.ndarray, centred: bool = True) -> np.ndarray:
    """Table of each trigram's dot product with each language's unit prototype. centred: what all languages share is taken off
    before, as it tells none from another."""
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    if centred and len(share) > 1:
        share = share - share.mean(axis=0)
    bundled = np.zeros((len(counts), DIMENSIONS), np.float64)
    for i in range(0, len(grams), 4096):
        bundled += share[:, i : i + 4096] @ trigram_vectors(grams[i : i + 4096])
    bundled /= np.maximum(np.linalg.norm(bundled, axis=1, keepdims=True), 1e-12)
    dots = np.zeros((CUBE, len(counts)), np.float32)
    for i in range(0, len(grams), 4096):
        dots[grams[i : i + 4096]] = trigram_vectors(grams[i : i + 4096]) @ bundled.T
    return dots


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for part in slices(batch, "text"):
            langs = part.column("lang").to_pylist()
            grams, owner, _ = trigrams(part.column("text").to_pylist())
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs])[owner] if len(owner) else owner
            for k, lang in enumerate(names):
                held.setdefault(lang, np.zeros(CUBE, np.int64))
                held[lang] += np.bincount(grams[code == k], minlength=CUBE)
            if len(held) > 16:
                yield from flush()
    yield from flush()


def learnt(train: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their trigrams' counts, and the trigrams, from rows with text and lang. What reaches the driver is bounded by the
    letters' cube times the number of languages, whatever the number of rows."""
    small_batches(train.sparkSession)
    rows = train.select("text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    got = rows.mapInArrow(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"{len(langs)} languages to learn, {MOST_LANGUAGES} at most")
    grams, at = np.unique(got["gram"].to_numpy(np.int64), return_inverse=True)
    counts = np.zeros((len(langs), len(grams)))
    counts[np.searchsorted(np.array(langs, object), got["lang"].to_numpy(object)) if langs else [], at] = got["n"]
    return langs, counts, grams


def fit(train: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their table of dot products with the centred prototypes."""
    langs, counts, grams = learnt(train)
    return langs, prototypes(counts, grams) if langs else np.zeros((CUBE, 0), np.float32)


def _counted(owner: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text and the number of each distinct trigram of a text."""
    pairs = np.sort(owner.astype(np.int64) * CUBE + grams)
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pairs[first] // CUBE, np.diff(first, append=len(pairs))


class Typical:
    """How well a text fits a language: the mean dot product of its trigrams with the language's whole prototype (not
    centred), from what the language's own trigrams have on average, in standard errors. The error has two parts: a text is a
    sample of trigrams, so the shorter it is the more it may be off, and texts of one language differ. A text of few words can
    hardly be told from any language and fits; letters in an order that no language has don't, from a few dozen on."""

    def __init__(self, counts: np.ndarray, grams: np.ndarray) -> None:
        self.dots = prototypes(counts, grams, centred=False)
        share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        own = self.dots[grams].T.astype(float)
        self.mean = (share * own).sum(axis=1)
        self.spread = np.maximum((share * own**2).sum(axis=1) - self.mean**2, 1e-12)
        self.differ = np.zeros(len(counts))

    def means(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Effective number of trigrams of each text (that of equally frequent ones with the same sum of squared shares, so that a word said
        a thousand times is no evidence a thousand times), and their mean dot product with each language."""
        grams, owner, _ = trigrams([x or "" for x in texts])
        n = np.bincount(owner, minlength=len(texts))
        sums = np.stack([np.bincount(owner, self.dots[grams, k], len(texts)) for k in range(len(self.mean))], axis=1)
        text, counts = _counted(owner, grams)
        return n**2 / np.maximum(np.bincount(text, counts.astype(float) ** 2, len(texts)), 1), sums / np.maximum(n, 1)[:, None]

    def fit(self, texts: list[str | None]) -> np.ndarray:
        """Of each text to the language that it fits best."""
        n, found = self.means(texts)
        error = np.sqrt(OVERLAP * self.spread / np.maximum(n, 1)[:, None] + self.differ)
        return ((found - self.mean) / error).max(axis=1)

    def learn_texts(self, train: DataFrame, langs: list[str]) -> None:
        """The mean over texts, weighted by their effective number of trigrams up to ENOUGH, so that no repetitive text sets it; and how
        much texts differ beyond what their lengths explain. Both come from sums over all rows by language."""
        at, first = {x: i for i, x in enumerate(langs)}, self.mean
        names = ["weight", "weighted", "texts", "off", "square", "error"]

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(at), len(names)))
            for batch in batches:
                for part in slices(batch, "text"):
                    n, found = self.means(part.column("text").to_pylist())
                    k = np.array([at[x] for x in part.column("lang").to_pylist()])
                    off, weight, long = found[np.arange(len(k)), k] - first[k], np.minimum(n, ENOUGH), n >= ENOUGH
                    np.add.at(total, k, np.stack([weight, weight * off, *(long * x for x in (1, off, off**2, OVERLAP * self.spread[k] / np.maximum(n, 1)))], axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(at), dtype=np.int32)), *map(pa.array, total.T)], ["k", *names])

        rows = train.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
        sums = rows.mapInArrow(go, "k int, " + ", ".join(f"{n} double" for n in names)).groupBy("k").agg(*(F.sum(n).alias(n) for n in names)).collect()
        for r in sums:
            shift, texts = r["weighted"] / max(r["weight"], 1.0), max(r["texts"], 1.0)
            self.mean[r["k"]] += shift
            self.differ[r["k"]] = max(0.0, (r["square"] - 2 * shift * r["off"] + r["texts"] * shift**2 - r["error"]) / texts)


def _scored(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the language of each text (that of the languages if none), its score, and the cosine with its prototype."""
    n, known = len(texts), table.shape[1]
    grams, owner, lettered = trigrams([x or "" for x in texts])
    if not known:
        return np.zeros(n, int), np.zeros(n), np.zeros(n)
    sums = np.stack([np.bincount(owner, table[grams, k], n) for k in range(known)], axis=1)
    text, counts = _counted(owner, grams)
    norm = np.sqrt(DIMENSIONS * np.bincount(text, counts.astype(float) ** 2, n))
    cos = sums / np.maximum(norm, 1e-9)[:, None]
    e = np.exp(SHARPNESS * (cos - cos.max(axis=1, keepdims=True)))
    return np.where(lettered, cos.argmax(axis=1), known), np.where(lettered, 1 / e.sum(axis=1), 0.0), np.where(lettered, cos.max(axis=1), 0.0)


def predict(docs: DataFrame, langs: list[str], dots: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(dots)
    names = pa.array([*langs, UNDETERMINED], pa.string())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                best, sure, _ = _scored(part.column("text").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), names.take(pa.array(best)), pa.array(sure)], ["doc_id", "held_out", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", held_out(4, 2).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(score, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, least: float = LEAST_FIT) -> DataFrame:
    """The rows of docs whose text has a letter, a positive cosine with some centred prototype (texts without any letter sequence of
    the languages have none, however short), and fits some language, with all their columns. If there is nothing to learn from, nothing
    can be rejected."""
    small_batches(docs.sparkSession)
    train = docs.where(~held_out(4, 2))
    langs, counts, grams = learnt(train)
    if not langs:
        return docs
    typical = Typical(counts, grams)
    typical.learn_texts(train, langs)
    shared = docs.sparkSession.sparkContext.broadcast((typical, prototypes(counts, grams)))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts, (known, dots) = part.column("text").to_pylist(), shared.value
                best, _, near = _scored(texts, dots)
                yield part.filter(pa.array((best < len(langs)) & (near > 0) & (known.fit(texts) >= least)))

    return docs.mapInArrow(keep, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows of docs that aren't held out, and predict all of them."""
    return predict(docs, *fit(docs.where(~held_out(4, 2))))
