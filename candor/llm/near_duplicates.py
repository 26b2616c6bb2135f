"""Near-duplicate documents by MinHash with sequential Bayesian verification.

1. Each text gets its set of word shingles, the set's size and 128-bit fingerprint, and a MinHash signature. Texts with
   equal sets are one class from here on, so thousands of copies cost as much as one.
2. Bands of the signature send classes into buckets. A bucket has a few representatives (found by sums before the shuffle), and
   each of its classes is a candidate with these, in a bucket that these don't compare whole with the first alone: no more than
   REPS pairs for a row, however large the bucket.
3. Signatures of candidates are compared batch of positions after batch; as soon as the posterior chance (uniform prior) that
   the similarity reaches the threshold falls to MISS or below, the pair is dropped.
4. Survivors are verified exactly on full sets: first the most similar candidate of each class; then, of the others from buckets
   that are compared whole, those that the links found so far don't connect.
5. A bucket whose classes are still in different components can hold more links. Shingles that no other class of these buckets
   has bound what a class can share, exactly: with u of n such shingles, n - u at most. Classes for which this is too little for
   the threshold are linked with nothing and go. The others get longer signatures and their rarest shingles, in one order for all; those
   outside of the bucket's main component are queries against the whole bucket, in blocks of CHUNK rows. Up to the place in that order to which
   both lists reach, what two classes share is counted, and beyond it they share no more than the smaller rest: an exact bound (prefix
   filter) that few pairs under the threshold pass, as what sets near copies apart is rare and comes first. The most
   similar plausible class of another component for each query and block is verified first, and at last every plausible pair that
   is still apart and within the bound. So no link is lost, and a group that hangs together, or whose members differ by words
   that few others have, has pairs in proportion to its size, not the square of it; the blocks still compare each query with the whole bucket.
6. Components of the true links give each document the smallest doc_id reachable.

A linked pair shares no band with probability (1 - threshold^ROWS)^BANDS, 8e-7 at 0.85 and 7e-5 at 0.80; MISS comes on top.

Cases: null and empty texts, and texts without words, have an empty set and are linked with nothing; fewer words than
a shingle has make one shingle; rows that repeat a doc_id are one node, linked by what links any of them; a null doc_id
is linked with nothing (null component); other columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm.common import empty, mixed, slices, small_batches, staged, utf8
from candor.llm.components import components
from candor.llm.words import find_words, shingles

BANDS, ROWS = 24, 5
SIGNATURE = BANDS * ROWS
#: Positions of the signatures by which the rest of a bucket is compared.
LONG_SIGNATURE = 480
#: Signature positions compared at a time.
BATCH = 24
#: Chance at which a pair is given up.
MISS = 1e-6
#: Representatives of a bucket: the classes nearest to these numbers, by exclusive or, which picks them as good as at random.
REPS = (0, -1, 0x2545F4914F6CDD1D, -0x61C8864680B583EB)
#: Classes of a bucket compared in one block, and the same on the side of the queries.
CHUNK = 1024
#: Rare shingles held by a block, and the same on the side of the queries.
ELEMENTS = 1 << 20
#: Largest number of group members that is broadcast to fetch their texts; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


@lru_cache(2)
def _permutations(size: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.default_rng(6).integers(0, 1 << 32, (size, 2), dtype=np.uint32)
    return drawn[:, 0].copy(), drawn[:, 1] | np.uint32(1)


def signature(hashes: np.ndarray, size: int = SIGNATURE) -> np.ndarray:
    """MinHash signature of a set of 64-bit hashes; a longer one begins with the shorter one."""
    flip, odd = _permutations(size)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 256):
        x = low[i : i + 256, None] ^ flip
        x *= odd
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(out, x.min(axis=0), out=out)
    return out


@lru_cache(8)
def least_matches(bound: float) -> tuple[int, ...]:
    """For each batch, the matches so far with which the posterior chance that the similarity is `bound` or more is
    above MISS. With m matches of n positions the posterior is Beta(m + 1, n - m + 1)."""
    grid = np.linspace(0, 1, 4001)[1:-1]
    out = []
    for n in range(BATCH, LONG_SIGNATURE + 1, BATCH):
        for m in range(n + 1):
            logs = m * np.log(grid) + (n - m) * np.log(1 - grid)
            p = np.exp(logs - logs.max())
            if p[grid >= bound].sum() / p.sum() > MISS:
                break
        out.append(m)
    return tuple(out)


def plausible(x: np.ndarray, y: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of signatures x and y survive the sequential comparison, row with row, and in how many positions these match."""
    left = np.arange(len(x))
    matches = np.zeros(len(x), np.int64)
    for step, least in enumerate(least_matches(bound)[: x.shape[1] // BATCH]):
        at = slice(step * BATCH, (step + 1) * BATCH)
        matches[left] += (x[left, at] == y[left, at]).sum(axis=1)
        left = left[matches[left] >= least]
        if not len(left):
            break
    return left, matches[left]


def scan(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (set size), f1 and f2 (set fingerprint), sig."""
    small_batches(docs.sparkSession)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw, offsets = utf8(part.column("text"))
                hashes, owner, _, _ = find_words(raw, offsets, lower=True)
                ends = np.searchsorted(owner, np.arange(part.num_rows + 1))
                n, f1, f2, sig = [], [], [], []
                for i in range(part.num_rows):
                    s = shingles(hashes[ends[i] : ends[i + 1]], k)
                    n.append(len(s))
                    f1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                    f2.append(int(mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)))
                    sig.append(signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "n", "f1", "f2", "sig"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(go, f"doc_id {kind}, n long, f1 long, f2 long, sig binary")


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """(rows, BANDS): the bucket of each band."""
    sig = sigs[:, :SIGNATURE].reshape(-1, BANDS, ROWS)
    key = np.zeros(sig.shape[:2], np.uint64)
    for r in range(ROWS):
        key = mixed(key ^ sig[:, :, r]) + np.arange(BANDS, dtype=np.uint64)
    return key.view(np.int64)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = band_keys(_signatures(batch.column("sig")))
        ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(ids)], ["bucket", "id"])


def _signatures(column: pa.Array, size: int = SIGNATURE) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, size)


def _pairs(a: np.ndarray, b: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(m, pa.int64())], ["a", "b", "m"])


def _surviving(bound: float):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, m = plausible(_signatures(batch.column("x")), _signatures(batch.column("y")), bound)
            kept = batch.select(["a", "b", "small"]).take(pa.array(left))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(m, pa.int64())], ["a", "b", "small", "m"])

    return go


def _crossing(percent: int, best: bool):
    """From rows (bucket, block, slice, q, id, label, n, u, rare, sig), each block's together: plausible pairs of a query with a class of
    another component, each in the first bucket alone that both are in; best: the most similar one of each query alone."""
    bound = percent / 100

    def compared(rows: pa.Table) -> pa.RecordBatch:
        is_q = rows.column("q").to_numpy()
        out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if is_q.all():
            return _pairs(*map(np.concatenate, out))
        ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
        sigs = _signatures(rows.column("sig"), LONG_SIGNATURE)
        size, alone = rows.column("n").to_numpy(), rows.column("u").to_numpy()
        lengths = pc.list_value_length(rows.column("rare")).to_numpy()
        order, places = np.unique(pc.list_flatten(rows.column("rare")).to_numpy(), return_inverse=True)
        rare = np.split(places, np.cumsum(lengths)[:-1])
        all_ids, all_labels, all_sigs, all_size, all_alone = ids[~is_q], labels[~is_q], sigs[~is_q], size[~is_q], alone[~is_q]
        met, ends = places[np.repeat(~is_q, lengths)], np.cumsum(lengths[~is_q])
        begins, last = ends - lengths[~is_q], met[ends - 1]
        has = np.zeros(len(order), bool)
        keys, bucket = band_keys(all_sigs), rows.column("bucket")[0].as_py()
        asked = band_keys(sigs[is_q])
        band = (asked == bucket).argmax(axis=1)  # of this bucket
        for i, label, n, u, at, sig, own, b in zip(ids[is_q], labels[is_q], size[is_q], alone[is_q], np.flatnonzero(is_q), sigs[is_q], asked, band, strict=True):
            has[rare[at]] = True
            both = np.add.reduceat(has[met], begins, dtype=np.int64)
            has[rare[at]] = False
            # the rests beyond the place that both lists reach
            rest = n - u - np.searchsorted(rare[at], last, "right")
            both += np.minimum(rest, all_size - all_alone - np.add.reduceat(met <= rare[at][-1], begins, dtype=np.int64))
            others = np.flatnonzero((all_labels != label) & (100 * both >= percent * (n + all_size - both)))
            others = others[~(keys[others, :b] == own[:b]).any(axis=1)]  # the others are met in an earlier band's bucket
            left, m = plausible(all_sigs[others], np.broadcast_to(sig, (len(others), LONG_SIGNATURE)), bound)
            if best and len(left):
                top = np.lexsort((all_ids[others[left]], -m))[:1]
                left, m = left[top], m[top]
            for held, new in zip(out, (np.full(len(left), i), all_ids[others[left]], m), strict=True):
                held.append(new)
        return _pairs(*map(np.concatenate, out))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "block", "slice")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if held and at != tuple(keys[lo]):
                    yield compared(pa.Table.from_batches(held))
                    held = []
                at = tuple(keys[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield compared(pa.Table.from_batches(held))

    return go


def _linked(percent: int):
    """Pairs (a, b) of rows with their sets that have 100 * intersection >= percent * union."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                near[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(near)), batch.column("b").filter(pa.array(near))], ["a", "b"])

    return go


def _labelled(rows: DataFrame, labels: DataFrame | None, column: str, name: str) -> DataFrame:
    """rows with the component of `column`, the class itself where it has no link."""
    if labels is None:
        return rows.withColumn(name, F.col(column))
    found = labels.select(F.col("node").alias(column), F.col("component").alias(name))
    return rows.join(found, column, "left").withColumn(name, F.coalesce(name, column))


def _apart(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Pairs whose classes are in different components."""
    return _labelled(_labelled(pairs, labels, "a", "la"), labels, "b", "lb").where("la <> lb").drop("la", "lb")


def linked(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id: documents are linked whose sets of k-word shingles have
    100 * intersection >= percent * union."""
    small_batches(docs.sparkSession)
    bound = percent / 100
    scanned = staged(scan(docs, k), "minhash")
    has = scanned.where("n > 0 and doc_id is not null")
    classes = staged(has.groupBy("f1", "f2", "n").agg(F.min(F.struct(F.col("doc_id").cast("long").alias("id"), "sig")).alias("m")).select("f1", "f2", "n", "m.id", "m.sig"), "classes")

    rows = classes.select("id", "sig").mapInArrow(_bands, "bucket long, id long")
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("c"), *(F.min(F.col("id").bitwiseXOR(F.lit(r).cast("long"))).alias(f"r{i}") for i, r in enumerate(REPS))).where("c > 1")
    reps = F.array_distinct(F.array(*(F.col(f"r{i}").bitwiseXOR(F.lit(r).cast("long")) for i, r in enumerate(REPS))))
    members = staged(rows.join(buckets.select("bucket", "c", reps.alias("reps")), "bucket"), "members")
    # in a small bucket the representatives meet all; of a larger one the first is the smallest id
    met = members.withColumn("small", F.expr("c <= size(reps) + 1"))
    met = met.select(F.col("id").alias("a"), F.explode(F.when(F.col("small"), F.col("reps")).otherwise(F.slice("reps", 1, 1))).alias("b"), "reps", "small")
    pairs = met.where("a > b or (a < b and not array_contains(reps, a))").groupBy("a", "b").agg(F.max("small").alias("small"))
    banded = members.select("id").distinct()
    sigs = staged(classes.select("id", "sig").join(_checked(banded), "id"), "signatures")
    signed = lambda p: p.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("x")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("y")), "b")
    pairs = staged(signed(pairs).select("a", "b", "small", "x", "y").mapInArrow(_surviving(bound), "a long, b long, small boolean, m long"), "survivors")

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def sets_of(ids: DataFrame) -> DataFrame:
        # a repeated doc_id can have other texts: the set's size and fingerprint say which is the class's
        wanted = staged(ids.select(F.col("id").alias("doc_id")).distinct(), "wanted")
        sets = texts.join(_checked(wanted), "doc_id").mapInArrow(lambda it: _sets(it, k), "id long, f1 long, n long, hashes binary")
        return staged(sets.join(classes.select("id", "f1", "n"), ["id", "f1", "n"]).dropDuplicates(["id"]).select("id", "hashes"), "sets")

    def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        both = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b")
        return staged(both.select("a", "b", "x", "y").mapInArrow(_linked(percent), "a long, b long"), "links")

    links, labels = None, None

    def add(new: DataFrame) -> None:
        nonlocal links, labels
        links = new if links is None else links.unionByName(new)
        labels = components(links)

    if not empty(pairs):
        sets = sets_of(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))))
        first = pairs.groupBy("a").agg(F.max(F.struct("m", (-F.col("b")).alias("b"))).alias("t")).select("a", (-F.col("t.b")).alias("b"))
        add(verified(first, sets))
        rest = staged(_apart(pairs.where("small"), labels).join(first, ["a", "b"], "left_anti"), "rest")
        if not empty(rest):
            add(verified(rest, sets))
    # buckets in which representatives haven't met all
    large = members.where("c > size(reps) + 1").select("bucket", "id")
    mixed_ = _labelled(large, labels, "id", "label").groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
    large = staged(large.join(_checked(staged(mixed_, "mixed")), "bucket"), "large")
    rounds = () if empty(large) else (True, False)
    if rounds:
        sets = sets_of(large)
        rarest = staged(_rarest(sets, percent), "rarest")
        large = staged(large.join(rarest.select("id", "n", "u", F.size("rare").alias("r")), "id"), "linkable")
        longer = staged(sets.join(rarest.select("id", "rare"), "id").mapInArrow(_longer, "id long, sig binary, rare array<long>"), "longer")
    for best in rounds:
        by_label = _labelled(large, labels, "id", "label")
        counts = by_label.groupBy("bucket", "label").agg(F.count("*").alias("c"), F.sum("r").alias("r"))
        opened = counts.groupBy("bucket").agg(F.max(F.struct("c", "label", "r")).alias("main"), F.sum("c").alias("c"), F.sum("r").alias("r"), F.count("*").alias("labels")).where("labels > 1")
        blocks = lambda c, r: F.ceil(F.greatest(c / F.lit(CHUNK), r / F.lit(ELEMENTS))).cast("int")
        opened = opened.select("bucket", F.col("main.label").alias("main"), blocks(F.col("c"), F.col("r")).alias("blocks"), blocks(F.col("c") - F.col("main.c"), F.col("r") - F.col("main.r")).alias("slices"))
        found = staged(by_label.join(_checked(staged(opened, "opened")), "bucket"), "open")
        if empty(found):
            break
        of = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        asked = found.where("label <> main").withColumn("block", every("blocks")).withColumn("slice", of(2, "slices")).withColumn("q", F.lit(True))
        met = found.withColumn("slice", every("slices")).withColumn("block", of(1, "blocks")).withColumn("q", F.lit(False))
        dealt = asked.unionByName(met).select("bucket", "block", "slice", "q", "id", "label", "n", "u").join(longer, "id")
        dealt = dealt.repartition("bucket", "block", "slice").sortWithinPartitions("bucket", "block", "slice")
        more = dealt.mapInArrow(_crossing(percent, best), "a long, b long, m long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        more = staged(more, "crossing")
        if empty(more):
            break
        add(verified(more, sets))

    # class -> component, then every document by its set
    by_class = _labelled(classes.select("f1", "f2", "n", "id"), labels, "id", "component_id").drop("id")
    out = scanned.select("doc_id", "n", "f1", "f2").join(by_class, ["f1", "f2", "n"], "left")
    alone = (F.col("n") == 0) | F.col("component_id").isNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id").cast("long")).otherwise(F.col("component_id")).alias("component_id"))


def _longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sigs = [signature(np.frombuffer(h.as_buffer(), np.uint64), LONG_SIGNATURE).tobytes() for h in batch.column("hashes")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sigs, pa.binary()), batch.column("rare")], ["id", "sig", "rare"])


def _rarest(sets: DataFrame, percent: int) -> DataFrame:
    """id, n (size of the set), u (elements that no other set has) and rare: its rarest elements that others have, rarest first. With
    the u they are one more than a set may lack of a linked one. Sets with too few elements that others have are left out."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column("hashes")).to_numpy() // 8
            hashes = np.frombuffer(b"".join(batch.column("hashes").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("id").to_numpy(), sizes)), pa.array(hashes)], ["id", "h"])

    elements = sets.mapInArrow(go, "id long, h long")
    # the order is by steps of frequency, then by hash
    step = F.floor(2 * F.log2("c")).cast("long")
    shared = elements.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    shared = staged(shared.select("h", F.shiftleft(step, 57).bitwiseOR(F.col("h").bitwiseAND(F.lit((1 << 57) - 1))).alias("key")), "shared")
    keys = elements.join(shared, "h").groupBy("id").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    sized = sets.select("id", F.expr("octet_length(hashes) div 8").alias("n")).join(keys, "id").withColumn("u", F.col("n") - F.size("keys"))
    least = F.expr(f"({percent} * n + 99) div 100")
    return sized.where(f"100 * (n - u) >= {percent} * n").select("id", "n", "u", F.slice("keys", F.lit(1), (F.size("keys") - least + 1).cast("int")).alias("rare"))


def _checked(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with the smallest doc_id of each component alone, and one row (the first by text) of a repeated doc_id; rows without doc_id all stay."""
    found = linked(docs, k, percent)
    gone = staged(found.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    left = docs.join(_checked(gone), "doc_id", "left_anti").select(*docs.columns)
    repeated = staged(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"), "repeated")
    if empty(repeated):
        return left
    many = _checked(repeated)
    once = left.join(many, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*(F.col(c) for c in docs.columns)), F.struct("text")).alias("row"))
    return left.join(many, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select("row.*"))


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            raw, offsets = utf8(part.column("text"))
            hashes, owner, _, _ = find_words(raw, offsets, lower=True)
            ends = np.searchsorted(owner, np.arange(part.num_rows + 1))
            sets = [shingles(hashes[ends[i] : ends[i + 1]], k) for i in range(part.num_rows)]
            f1 = [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(f1, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "f1", "n", "hashes"])
