"""Phrase collocations by contiguous pattern growth, for each language on its own.

Texts are cut into pieces at stops and line ends, pieces into words. A phrase is 2 to LONGEST consecutive words of a piece with
at least LEAST occurrences; every part of a phrase then has as many. Growth goes from the left:

1. Words are counted, then pairs of frequent words.
2. Each place where a frequent pair begins points at its projection: the words from there on, up to LONGEST, while consecutive
   pairs are frequent. Equal projections are counted before they are shuffled.
3. One task per frequent prefix (a pair at first) sorts the prefix's projections and grows it to the right, depth first: the runs
   of the next word are its extensions, and frequent ones are grown in turn.

A prefix of more than SHARD occurrences isn't one task: its extensions are counted by partial sums, and each of them is a prefix
of its own, again split if it is too frequent. So no task holds more than SHARD projections, whatever their skew.

Tasks know which words and pairs are frequent by a bitmap of at most FILTER_BITS bits of their hashes. A word taken for frequent
by chance costs a count that is dropped later; none is missed, and all counts are exact sums. Words are told apart by 64 bits of
hash over language and word.

The score of a phrase is the least of floor(1000 * a * n / (l * r)) over its cuts in two, with decimals of 38 digits. Phrases inside a
longer one of as many occurrences are dropped: it is enough to look at phrases of one more word, as those between are phrases
with as many occurrences too.

Cases: null text has no words; null lang counts as `und`; empty pieces have no words; repeated rows count as often as they
stand; ties in score go by occurrences, then by the phrase's bytes; an empty table gives an empty table; other columns are left aside; a
very long text is one row of a batch, and what a task holds besides is bounded by HELD.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candor.llm.common import empty, mixed, slices, small_batches, staged, utf8
from candor.llm.words import bytes_of, find_words, lowered

LEAST, LONGEST, TOP = 100, 5, 2000
UNKNOWN = "und"
#: Text of a batch worked on at once, in bytes; counted rows that a task holds; bits of the bitmap of frequent words or pairs.
SLICE, HELD, FILTER_BITS = 1 << 20, 1 << 19, 1 << 27
#: Projections that one task grows at most.
SHARD = 200_000
#: Rows up to which a table of prefixes is broadcast.
BROADCAST_ROWS = 1_000_000
#: Parts in which a language's phrases are ranked before their best are put together.
PARTS = 64

_ENDS = bytes_of(*b".,;:!?\n\x0b\x0c\r")
_APART = _ENDS | bytes_of(*b" \t")
_STEP = np.uint64(0x9E3779B97F4A7C15)
W = [f"w{i}" for i in range(1, LONGEST + 1)]


class Frequent:
    """A bitmap of hashes: never misses one that was put in."""

    def __init__(self, at: np.ndarray, bits: np.ndarray, size: int) -> None:
        self.words, self.size = np.zeros(size // 64, np.uint64), np.uint64(size)
        self.words[at] = bits.view(np.uint64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        slot = mixed(hashes) % self.size
        return self.words[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1) > 0


def _bits(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slot = mixed(_joint(*(batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(batch.num_columns)))) % np.uint64(size)
        yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (slot & np.uint64(63))).view(np.int64))], ["at", "bits"])


def _joint(*ids: np.ndarray) -> np.ndarray:
    """One hash of a word, or of a pair."""
    return ids[0] if len(ids) == 1 else mixed(ids[0] * _STEP + ids[1])


def frequent(df: DataFrame, columns: list[str]) -> Frequent:
    """The bitmap of df's rows: 16 bits a row, FILTER_BITS at most, so what reaches the driver is bounded."""
    size = min(FILTER_BITS, max(1 << 12, 1 << (16 * df.count()).bit_length()))
    got = df.select(*columns).mapInArrow(lambda it: _bits(it, size), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    return Frequent(got["at"].to_numpy(np.int64), got["bits"].to_numpy(np.int64), size)


class Words:
    """The words of a batch: id (of language and word), piece, and where they stand."""

    def __init__(self, part: pa.RecordBatch) -> None:
        self.raw, offsets = utf8(part.column("text"))
        hashes, self.text, self.start, self.end = find_words(self.raw, offsets, lower=True, apart=_APART)
        langs = part.column("lang").dictionary_encode()
        self.langs, self.lang = langs.dictionary, langs.indices.to_numpy(zero_copy_only=False)
        salt = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in self.langs.to_pylist()] or [0], np.uint64)
        self.id = np.maximum(mixed(hashes ^ salt[self.lang[self.text]]), np.uint64(1)) if len(hashes) else hashes
        self.piece = np.cumsum(_ENDS[self.raw])[self.start] + self.text if len(hashes) else self.text

    def said(self, which: np.ndarray) -> pa.Array:
        """The words themselves, in lower case."""
        size = self.end[which] - self.start[which]
        offsets = np.r_[0, np.cumsum(size)]
        at = np.repeat(self.start[which] - offsets[:-1], size) + np.arange(offsets[-1])
        return pa.StringArray.from_buffers(len(which), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(lowered(self.raw[at]))) if len(which) else pa.array([], pa.string())


def _summed(tables: list[pa.Table], keys: list[str]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(keys).aggregate([("n", "sum")])
    return out.rename_columns([*out.column_names[:-1], "n"] if out.column_names[-1] == "n_sum" else ["n", *out.column_names[1:]]).select([*keys, "n"])


def _counted(tables: Iterator[pa.Table], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Sums of n by the keys, handed on whenever more than HELD rows would have to be held."""
    held, rows = [], 0
    for t in tables:
        held.append(t)
        rows += t.num_rows
        if rows > HELD:
            held = [_summed(held, keys)]
            rows = held[0].num_rows
            if rows > HELD // 2:
                yield from held[0].to_batches(1 << 16)
                held, rows = [], 0
    if rows:
        yield from _summed(held, keys).to_batches(1 << 16)


def _each(docs: DataFrame, of: Callable[[Words], pa.Table | None], keys: list[str], schema: str) -> DataFrame:
    """Partial counts, by task, of what `of` finds in the words of a batch."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (of(Words(part)) for batch in batches for part in slices(batch, "text", SLICE))
        return _counted((t for t in found if t is not None), keys)

    return docs.mapInArrow(go, schema)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _vocabulary(w: Words) -> pa.Table:
    ids, first, n = np.unique(w.id, return_index=True, return_counts=True)
    return pa.table({"id": _signed(ids), "lang": w.langs.take(pa.array(w.lang[w.text[first]])) if len(first) else pa.array([], pa.string()), "word": w.said(first), "n": pa.array(n.astype(np.int64))})


def _pairs(known: Frequent) -> Callable[[Words], pa.Table]:
    def of(w: Words) -> pa.Table:
        good = known.has(w.id)
        at = np.flatnonzero(good[:-1] & good[1:] & (w.piece[:-1] == w.piece[1:]))
        return pa.table({"w1": _signed(w.id[at]), "w2": _signed(w.id[at + 1]), "n": pa.array(np.ones(len(at), np.int64))})

    return of


def _projections(known: Frequent) -> Callable[[Words], pa.Table | None]:
    def of(w: Words) -> pa.Table | None:
        if len(w.id) < 3:
            return None
        linked = (w.piece[:-1] == w.piece[1:]) & known.has(_joint(w.id[:-1], w.id[1:]))
        linked = np.r_[linked, np.zeros(LONGEST, bool)]
        at = np.flatnonzero(linked[:-1] & linked[1:])
        ids, going, columns = np.r_[w.id, np.zeros(LONGEST, np.uint64)], np.ones(len(at), bool), {"w1": w.id[at]}
        for i, name in enumerate(W[1:]):
            going &= linked[at + i]
            columns[name] = np.where(going, ids[at + i + 1], np.uint64(0))
        return pa.table({k: _signed(x) for k, x in columns.items()} | {"n": pa.array(np.ones(len(at), np.int64))})

    return of


def _growth(depth: int, least: int) -> Callable[[pa.Table], pa.Table]:
    """Grows the prefix of `depth` words that all projections of a group share."""

    def grow(group: pa.Table) -> pa.Table:
        words = np.stack([group.column(c).to_numpy() for c in W])
        order = np.lexsort(words[::-1])
        words, n = words[:, order], group.column("n").to_numpy()[order]
        found: list[tuple[np.ndarray, int]] = []

        def extend(lo: int, hi: int, depth: int) -> None:
            following = words[depth, lo:hi]
            bounds = lo + np.flatnonzero(np.r_[True, following[1:] != following[:-1], True])
            counts = np.add.reduceat(n[lo:hi], bounds[:-1] - lo)
            for i in np.flatnonzero((counts >= least) & (words[depth, bounds[:-1]] != 0)):
                a, b = bounds[i], bounds[i + 1]
                found.append((np.r_[words[: depth + 1, a], np.zeros(LONGEST - depth - 1, np.int64)], counts[i]))
                if depth + 1 < LONGEST:
                    extend(a, b, depth + 1)

        extend(0, len(n), depth)
        rows = np.array([f for f, _ in found], np.int64).reshape(-1, LONGEST)
        return pa.table({c: pa.array(rows[:, i]) for i, c in enumerate(W)} | {"n": pa.array([int(c) for _, c in found], pa.int64())})

    return grow


_PHRASE = ", ".join(f"{c} long" for c in W) + ", n long"


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _grown(projections: DataFrame, pairs: DataFrame, least: int, shard: int) -> DataFrame:
    """w1 to w5 (0: none) and n of all frequent phrases of three words and more."""
    found, rest, large = [], projections, pairs.where(F.col("n") > shard)
    for depth in range(2, LONGEST):
        prefix = W[:depth]
        if empty(large):
            return reduce(DataFrame.unionByName, [*found, rest.groupBy(*prefix).applyInArrow(_growth(depth, least), _PHRASE)])
        large = _few(large.select(*prefix))
        small = rest.join(large, prefix, "left_anti")
        found.append(small.groupBy(*prefix).applyInArrow(_growth(depth, least), _PHRASE))
        rest = rest.join(large, prefix, "left_semi").where(F.col(W[depth]) != 0)
        longer = staged(rest.groupBy(*W[: depth + 1]).agg(F.sum("n").alias("n")).where(F.col("n") >= least), "prefixes")
        found.append(longer.select(*W[: depth + 1], *(F.lit(0).cast("long").alias(c) for c in W[depth + 1 :]), "n"))
        large = longer.where(F.col("n") > shard)
    return reduce(DataFrame.unionByName, found)


def frequent_phrases(docs: DataFrame, least: int = LEAST, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """vocabulary (id, lang, word, n) of all words, and phrases (w: ids, a: occurrences) of one word to LONGEST with at least
    `least` occurrences."""
    small_batches(docs.sparkSession)
    rows = docs.select(docs["text"].cast("string").alias("text"), F.coalesce(docs["lang"].cast("string"), F.lit(UNKNOWN)).alias("lang")).where("text is not null")
    vocabulary = _each(rows, _vocabulary, ["id", "lang", "word"], "id long, lang string, word string, n long")
    vocabulary = staged(vocabulary.groupBy("id", "lang", "word").agg(F.sum("n").alias("n")), "vocabulary")
    common = vocabulary.where(F.col("n") >= least)
    pairs = _each(rows, _pairs(frequent(common, ["id"])), W[:2], "w1 long, w2 long, n long").groupBy("w1", "w2").agg(F.sum("n").alias("n"))
    pairs = staged(pairs.where(F.col("n") >= least), "pairs")
    projections = staged(_each(rows, _projections(frequent(pairs, W[:2])), W, _PHRASE), "projections")
    longer = _grown(projections, pairs, least, shard)
    ids = F.filter(F.array(*W), lambda x: x != 0)
    phrases = longer.select(ids.alias("w"), F.col("n").alias("a")).unionByName(pairs.select(F.array("w1", "w2").alias("w"), F.col("n").alias("a")))
    return vocabulary, staged(phrases.unionByName(common.select(F.array("id").alias("w"), F.col("n").alias("a"))), "phrases")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, shard: int = SHARD) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: each language's `top` phrases by score, occurrences and phrase."""
    vocabulary, known = frequent_phrases(docs, least, shard)
    phrases, size = known.where(F.size("w") > 1), F.size("w")
    cuts = phrases.select("w", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("w", "a", "k", F.slice("w", 1, F.col("k")).alias("head"), F.slice("w", F.col("k") + 1, size - F.col("k")).alias("tail"))
    cuts = cuts.join(known.select(F.col("w").alias("head"), F.col("a").alias("l")), "head").join(known.select(F.col("w").alias("tail"), F.col("a").alias("r")), "tail")
    total = vocabulary.groupBy("lang").agg(F.sum("n").alias("total"))
    by_id = vocabulary.where(F.col("n") >= least).select("id", "lang", "word").join(total, "lang")
    spelt = phrases.select("w", F.posexplode("w").alias("pos", "id")).join(by_id, "id").groupBy("w", "lang", "total")
    spelt = spelt.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    spelt = staged(spelt, "spelt")
    # a phrase of one more word and as many occurrences hides its two parts
    inside = phrases.where(size > 2).select(F.explode(F.array(F.slice("w", 1, size - 1), F.slice("w", 2, size - 1))).alias("w"), "a").groupBy("w").agg(F.max("a").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", (wide("a") * wide("total")) * F.lit(1000).cast("decimal(4,0)"), wide("l") * wide("r")).cast("long")
    best = cuts.join(spelt.select("w", "total"), "w").groupBy("w", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    kept = best.join(inside, "w", "left").where(F.coalesce(F.col("longer") < F.col("a"), F.lit(True))).join(spelt, "w")
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    kept = kept.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
