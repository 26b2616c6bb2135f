"""Benchmark decontamination by SimHash of item-sized windows.

A window of a document is as long as the benchmark item it is compared with. Windows and items have 64-bit SimHash
fingerprints over weighted five-word shingles; an item of fewer words is one shingle. Each fingerprint is cut into RADIUS + 1
blocks; two within Hamming distance RADIUS agree in at least one block, so the block index of the items of a window's length
finds all of them. Candidates are verified by the exact weighted Jaccard similarity of their shingle sets, and count from
SIMILARITY.

Fingerprints are made of the windows that can count, wherever they begin: the similarity is at most the weight of the distinct
shingles that the window shares with an item, over the weight of the item, so windows with less than SIMILARITY of some item's
weight in common are left out. Each start whose window holds a shared shingle is tried, whatever the order of the shared passages.
Fingerprinting all windows of every length gives the same result for some 64 sums per word and item length.

A shingle weighs log(1 + items / items that have it), scaled to 1 for a shingle of one item, so phrases that many
items share tell little; shingles of no item weigh 1.

Texts, of items too, are told apart by 128 bits of hash, not by their ids: copies are searched once, and ids may be null or repeated.
Benchmark tables are broadcast up to BROADCAST_ROWS rows and joined by a shuffle beyond.

Cases: null and empty texts and texts with fewer words than an item's shingle are clean; null and wordless items take no part;
items without an id are searched like others but not listed; each text of a repeated item_id is searched; a null doc_id has a
result like any other; a document shorter than an item is compared as a whole; an empty benchmark leaves all
documents clean; other columns are left aside. Ties: the list of items is sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.llm.common import staged
from candor.llm.native import bound, shingle_hashes, words

SHINGLE, SIMILARITY = 5, 0.8
#: Shingle sets of similarity 0.8 have cosine 0.89: 9.7 of 64 bits differ on average, standard deviation 2.9. In a simulation of
#: 20,000 pairs of exactly that similarity for each of ten lengths, at most one in 20,000 differed by more than 24 bits.
RADIUS = 24
BROADCAST_ROWS = 1_000_000


def fingerprint(hashes: Column, weights: Column) -> Column:
    """SimHash: bit b is set where the weights of hashes with bit b outweigh the others."""
    both = F.arrays_zip(hashes.alias("h"), weights.alias("w"))
    def bit(b: Column) -> Column:
        total = F.aggregate(both, F.lit(0.0), lambda acc, x: acc + F.when(F.call_function("getbit", x["h"], b) == 1, x["w"]).otherwise(-x["w"]))
        return F.when(total > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(x))


def blocks(print_: Column) -> Column:
    """(block number, bits) of RADIUS + 1 blocks."""
    cuts = [64 * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    parts = [F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(print_, lo).bitwiseAND((1 << (hi - lo)) - 1).alias("bits")) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return F.array(*parts)


def _checked(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _shared_weight(places: Column) -> Column:
    """Weight of the distinct shingles of (pos, h, w)."""
    return F.aggregate(F.array_distinct(F.transform(places, lambda x: F.struct(x["h"], x["w"]))), F.lit(0.0), lambda acc, x: acc + x["w"])


def _starts(places: Column, n: Column, m: Column, needed: Column) -> Column:
    """Starts of the windows of n shingles, in a text of m, that share the weight needed with the item. places: (pos, h, w) of
    the text's shingles that the item has, by pos. Each start is tried once, with the first place that its window holds."""

    def of(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(places, i - 1)["pos"]).otherwise(-1)
        low, high = F.greatest(F.lit(0), before + 1, x["pos"] - n + 1), F.least(x["pos"], F.greatest(F.lit(0), m - n))
        inside = F.slice(places, i + 1, n)
        enough = lambda s: _shared_weight(F.filter(inside, lambda y: y["pos"] < s + n)) >= needed
        return F.when(low <= high, F.filter(F.sequence(low, F.greatest(low, high)), enough)).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(places, of))


def _text(df: DataFrame) -> Column:
    return df["text"].cast("string")


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")]


def _items(benchmark: DataFrame) -> DataFrame:
    """it (number of a distinct text), text, k (words of a shingle), h (hashes of its shingles, by place)."""
    items = benchmark.select(_text(benchmark).alias("text")).where("text is not null").distinct().withColumn("k", F.least(F.size(words(F.col("text"))), F.lit(SHINGLE))).where("k > 0")
    hashes = F.coalesce(*(F.when(F.col("k") == k, shingle_hashes(F.col("text"), k)) for k in range(1, SHINGLE + 1)))
    return staged(items.select(F.monotonically_increasing_id().alias("it"), "text", "k", hashes.alias("h")), "items")


def _windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """t1, t2 (a document's text), it, start (word), similarity of each verified window; one per start."""
    places = items.select("it", "k", F.size("h").alias("n"), F.posexplode("h").alias("off", "h"))
    total = items.count()
    share = F.log(1 + total / F.countDistinct("it")) / F.log(F.lit(1.0 + total))
    weights = staged(places.groupBy("h").agg(share.alias("w")), "weights")
    prints_of = places.join(weights, "h").groupBy("it", "k", "n").agg(F.collect_set(F.struct("h", "w")).alias("s"))
    known = staged(prints_of.select("it", "k", "n", "s", fingerprint(F.col("s.h"), F.col("s.w")).alias("fp")), "fingerprints")
    sought = staged(known.select("it", "k", "n", F.inline("s")), "sought")
    needed = sought.groupBy("it").agg((F.sum("w") * SIMILARITY - 1e-9).alias("needed"))

    rows = docs.select(_text(docs).alias("text")).select(*_keys(F.col("text")), "text")
    windows = []
    for k in sorted(r["k"] for r in items.select("k").distinct().collect()):
        hashed = rows.select("t1", "t2", shingle_hashes(F.col("text"), k).alias("hs"))
        shared = hashed.select("t1", "t2", F.size("hs").alias("m"), F.posexplode("hs").alias("pos", "h")).join(_checked(sought.where(F.col("k") == k)), "h")
        pairs = shared.distinct().groupBy("t1", "t2", "it", "n", "m").agg(F.array_sort(F.collect_list(F.struct("pos", "h", "w"))).alias("p"))
        pairs = pairs.join(_checked(needed), "it").where(_shared_weight(F.col("p")) >= F.col("needed"))
        seeds = pairs.select("t1", "t2", "n", F.explode(_starts(F.col("p"), F.col("n"), F.col("m"), F.col("needed"))).alias("start")).distinct()
        seeds = staged(seeds.groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "n")).alias("seeds")), "seeds")
        found = rows.join(_checked(seeds), ["t1", "t2"]).groupBy("t1", "t2").agg(F.any_value("text").alias("text"), F.any_value("seeds").alias("seeds"))
        cut = lambda hs: F.transform("seeds", lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"), F.array_distinct(F.slice(hs, x["start"] + 1, x["n"])).alias("w")))
        windows.append(found.select("t1", "t2", F.lit(k).alias("k"), F.inline(bound(shingle_hashes(F.col("text"), k), cut))))
    if not windows:
        return known.select(F.lit(0).cast("long").alias("t1"), F.lit(0).cast("long").alias("t2"), "it", F.lit(0).alias("start"), F.lit(0.0).alias("similarity")).where("false")
    windows = staged(reduce(DataFrame.unionByName, windows).withColumn("win", F.monotonically_increasing_id()), "windows")
    # weights of a window's shingles are those of the items where these have them
    weighed = windows.select("win", F.explode("w").alias("h")).join(_checked(weights), "h", "left").groupBy("win").agg(F.collect_list(F.struct("h", F.coalesce("w", F.lit(1.0)).alias("w"))).alias("ws"))
    prints = weighed.select("win", "ws", fingerprint(F.col("ws.h"), F.col("ws.w")).alias("wfp")).join(windows.drop("w"), "win")
    prints = staged(prints, "prints")
    index = known.select("it", "k", "n", F.inline(blocks(F.col("fp"))))
    hits = prints.select("win", "k", "n", F.inline(blocks(F.col("wfp")))).join(_checked(index), ["k", "n", "block", "bits"]).select("win", "it").distinct()
    near = prints.drop("k", "n").join(hits, "win").join(_checked(known), "it").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("wfp"))) <= RADIUS)
    weight = lambda s: F.aggregate(s, F.lit(0.0), lambda acc, x: acc + x["w"])
    common = weight(F.filter("s", lambda x: F.array_contains(F.col("ws.h"), x["h"])))
    similar = common / (weight(F.col("s")) + weight(F.col("ws")) - common)
    return near.select("t1", "t2", "it", "start", similar.alias("similarity")).where(F.col("similarity") >= SIMILARITY - 1e-9)


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """t1, t2, start, similarity and ids, the item_ids of the item found."""
    items = _items(benchmark)
    named = benchmark.select(_text(benchmark).alias("text"), benchmark["item_id"].cast("long").alias("item_id")).join(items.select("it", "text"), "text")
    named = named.groupBy("it").agg(F.collect_set("item_id").alias("ids"))
    return staged(_windows(docs, items).join(_checked(staged(named, "named")), "it"), "found")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start (word), similarity of each verified window; one per start and item_id."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), *_keys(_text(docs)))
    found = rows.join(_checked(_found(docs, benchmark)), ["t1", "t2"])
    return found.select("doc_id", F.explode("ids").alias("item_id"), "start", "similarity").distinct()


def _contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """t1, t2, items (sorted), similarity (largest), for texts that hold an item."""
    found = _found(docs, benchmark).groupBy("t1", "t2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"), F.max("similarity").alias("similarity"))
    return staged(found, "contaminated")


def check(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, items, similarity of every row of docs."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), *_keys(_text(docs)))
    out = rows.join(_checked(_contaminated(docs, benchmark)), ["t1", "t2"], "left")
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    bad = _contaminated(docs, benchmark).select("t1", "t2")
    t1, t2 = _keys(_text(docs))
    return docs.join(_checked(bad), (t1 == bad["t1"]) & (t2 == bad["t2"]), "left_anti")
