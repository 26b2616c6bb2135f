"""Passages of a fixed length that occur more than once in a corpus: the search that the suffix-automaton and
difference-cover operators share.

1. Anchors: each text gives, for each anchor, its name, a hash of its context (all passages whose anchor it is) and where it
   is. Passages that are equal have an anchor of the same name at the same place, so sorting by name brings them
   together; the rows are a few per cent of the units. Contexts that a task has seen before are settled in the task and only
   spread over the others, so a context that a third of all texts have is a row per task.
2. An anchor whose whole context has occurred elsewhere is decided: all its passages are repeated.
3. Otherwise, where a name has several contexts, one copy of each goes to the name's shard: the units left and right of
   the anchor, with the anchor itself as one symbol. The operator's own method compares the contexts of a shard. An anchor with
   over SHARD contexts is extended, once to the left and once to the right, by half of what a passage has besides it: each
   passage has one extension or the other whole. The longer anchors make smaller shards, and so on until the shards fit, at the
   latest when the anchor is the passage.
4. The spans of a document are merged.

Names and contexts are hashes of 64 bits each; a context is decided by both, a shard compares the units around the anchor
themselves. Nothing but counts reaches the driver. Tables by document are broadcast only up to a number of entries; beyond it,
they are joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candor.llm.anchors import Units, anchors, contexts
from candor.llm.common import empty, mixed, slices, small_batches, staged, utf8
from candor.llm.words import byte_values, find_words

#: Most contexts of one name that one task compares.
SHARD = 4096
#: Repeated contexts that a task remembers.
SEEN = 16_384
#: Entries up to which a table by document is broadcast.
BROADCAST_ENTRIES = 3_000_000

NO_ID = -(1 << 63)
RANGES = "array<struct<lo:int,hi:int>>"


class Words:
    """Units are words; the symbols of a context are their hashes."""

    @staticmethod
    def units(column: pa.Array) -> tuple[Units, np.ndarray]:
        raw, offsets = utf8(column)
        hashes, owner, _, _ = find_words(raw, offsets)
        return Units(hashes, np.searchsorted(owner, np.arange(len(column) + 1))), hashes


class Bytes:
    """Units are bytes."""

    @staticmethod
    def units(column: pa.Array) -> tuple[Units, np.ndarray]:
        raw, offsets = utf8(column)
        return Units(byte_values()[raw], offsets), raw


def keyed(docs: DataFrame) -> DataFrame:
    """doc and tk say which document a row is: rows that repeat doc_id and text are one document, rows that repeat
    doc_id alone are several."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.hash(text).bitwiseAND(0x7FFFFFFF).alias("tk"), text.alias("text"))


#: What a row of anchors is: the first of its context in its task, alone or not, or a later one, which needs no comparison.
ALONE, FIRST, LATER = 0, 1, 2


class _Seen:
    """The repeated contexts of a task, the SEEN last ones, with the first place of each."""

    def __init__(self) -> None:
        self.held = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def states(self, name: np.ndarray, ctx: np.ndarray, doc: np.ndarray, tp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the rows to go on with (one of rows that are equal), and their states."""
        old = len(self.held[0])
        name, ctx, doc, tp = (np.concatenate(x) for x in zip(self.held, (name, ctx, doc, tp), strict=True))
        order = np.lexsort((tp, doc, ctx, name))
        x, y, d, t = name[order], ctx[order], doc[order], tp[order]
        new = np.ones(len(order), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        same = np.zeros(len(order), bool)
        same[1:] = ~new[1:] & (d[1:] == d[:-1]) & (t[1:] == t[:-1])
        group = np.cumsum(new) - 1
        several = np.bincount(group[~same], minlength=group[-1] + 1 if len(group) else 0) > 1
        state = np.where(new, np.where(several[group], FIRST, ALONE), LATER)
        keep = order[new & several[group]]
        self.held = [z[keep][-SEEN:] for z in (name, ctx, doc, tp)]
        out = ~same & (order >= old)
        return order[out] - old, state[out]


def _anchors_of(kind: type, length: int, gram: int) -> Callable:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            for part in slices(batch, "text"):
                units, _ = kind.units(part.column("text"))
                at, lo, hi = anchors(units, length, gram)
                row = units.rows(at)
                name, around = contexts(units, at, lo, hi, gram)
                tk = part.column("tk").to_numpy().astype(np.int64)[row] & 0xFFFFFFFF
                tp = (at - units.offsets[row]) << 32 | tk
                lr = ((at - lo) << 16 | (hi - at)).astype(np.int32)
                doc = part.column("doc").to_numpy()[row]
                left, state = seen.states(name, around, doc, tp)
                name, around, doc, tp, lr = name[left], around[left], doc[left], tp[left], lr[left]
                # later ones meet nothing, so any place will do: those of a document travel together, which packs well
                name, around = np.where(state == LATER, mixed(doc.view(np.uint64)), name), np.where(state == LATER, np.uint64(0), around)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(around.view(np.int64)), pa.array(doc), pa.array(tp), pa.array(lr), pa.array(state.astype(np.int8))], ["name", "ctx", "doc", "tp", "lr", "state"])

    return go


def _contexts_of(kind: type, length: int, gram: int) -> Callable:
    """Rows (key, need, doc, tk, at, left, symbols): the contexts of anchors that begin at `at`, extended by gl units to the
    left and gr to the right; a passage has `need` symbols, the anchor being one."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                units, symbols = kind.units(part.column("text"))
                lists = part.column("found")
                row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                flat = lists.flatten()
                gl, gr, left, right = (flat.field(c).to_numpy().astype(np.int64) for c in ("gl", "gr", "left", "right"))
                place = units.offsets[row] + flat.field("pos").to_numpy()
                at, end = place - gl, place + gram + gr
                need = length - gram - gl - gr + 1
                lo, hi = np.maximum(place - left, at - need + 1), np.minimum(place + right, end + need - 1)
                good = np.flatnonzero((at >= lo) & (end <= hi) & (hi - lo >= length))
                row, at, end, lo, hi, gl, gr, left, right, need = (x[good] for x in (row, at, end, lo, hi, gl, gr, left, right, need))
                key = units.hashed(at, end)
                key = np.where(gl + gr > 0, mixed(key ^ (gl << 32 | gr).astype(np.uint64)), key)
                cut = [symbols[a:b].tobytes() + symbols[c:d].tobytes() for a, b, c, d in zip(lo.tolist(), at.tolist(), end.tolist(), hi.tolist(), strict=True)]
                doc, tk = part.column("doc").to_numpy()[row], part.column("tk").to_numpy()[row]
                columns = [key.view(np.int64), need.astype(np.int32), doc, tk, (at - units.offsets[row]).astype(np.int32), (at - lo).astype(np.int32), *(x.astype(np.int32) for x in (gl, gr, left, right))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(cut, pa.binary())], ["key", "need", "doc", "tk", "at", "left", "gl", "gr", "before", "after", "symbols"])

    return go


def union_of(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ranges [lo, hi) of each row, in order, those that overlap or touch as one."""
    if not len(row):
        return row, lo, hi
    order = np.lexsort((lo, row))
    apart = row[order].astype(np.int64) * (int(hi.max()) + 2)  # ranges of one row come before those of the next
    lo, end, row = lo[order], np.maximum.accumulate(hi[order] + apart), row[order]
    first = np.r_[True, (lo + apart)[1:] > end[:-1]]
    last = np.r_[first[1:], True]
    return row[first], lo[first], (end - apart)[last]


def _groups(batches: Iterator[pa.RecordBatch], resolve: Callable, length: int) -> Iterator[pa.RecordBatch]:
    """Hands runs of equal key to resolve(key arrays ...), and carries a run that goes on in the next batch."""
    held: list[pa.RecordBatch] = []

    def out(rows: pa.Table) -> pa.RecordBatch:
        key = rows.column("key").to_numpy()
        bounds = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        which, offset = resolve(bounds, rows.column("need").to_numpy(), rows.column("left").to_numpy(), rows.column("symbols").to_pylist())
        lo = rows.column("at").to_numpy()[which].astype(np.int64) - rows.column("left").to_numpy()[which] + offset
        which, lo, hi = union_of(which, lo, lo + length)
        return pa.RecordBatch.from_arrays([pa.array(rows.column("doc").to_numpy()[which]), pa.array(rows.column("tk").to_numpy()[which]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["doc", "tk", "lo", "hi"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        last = int(np.searchsorted(key != key[-1], False)) if key[0] == key[-1] else len(key) - int(np.argmax(key[::-1] != key[-1]))
        if held and key[0] != held[-1].column("key")[0].as_py() and last == 0:
            yield out(pa.Table.from_batches(held))
            held = [batch]
        elif last == 0:
            held.append(batch)
        else:
            yield out(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = [batch.slice(last)]
    if held:
        yield out(pa.Table.from_batches(held))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("spans")
        flat = lists.flatten()
        row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        row, lo, hi = union_of(row, flat.field("lo").to_numpy().astype(np.int64), flat.field("hi").to_numpy().astype(np.int64))
        ranges = pa.StructArray.from_arrays([pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["lo", "hi"])
        at = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tk"), pa.ListArray.from_arrays(pa.array(at), ranges)], ["doc", "tk", "ranges"])


def joined(rows: DataFrame, by_doc: DataFrame, column: str, how: str) -> DataFrame:
    """rows with a table of lists by document: broadcast only if its rows and list items are few."""
    size = by_doc.agg(F.count("*") * 4 + F.coalesce(F.sum(F.size(column)), F.lit(0))).first()[0]
    return rows.join(F.broadcast(by_doc) if size <= BROADCAST_ENTRIES else by_doc, ["doc", "tk"], how)


def find(docs: DataFrame, kind: type, length: int, gram: int, earlier: bool, resolve: Callable) -> DataFrame:
    """doc, tk and ranges: the units, counted in their document, that repeated passages of `length` units cover.
    earlier: only passages that also begin earlier (smaller doc, or same doc and earlier) count; else all that occur
    anywhere else too. resolve: compares the contexts of shards; see the operators."""
    small_batches(docs.sparkSession)
    rows = keyed(docs)
    found = rows.mapInArrow(_anchors_of(kind, length, gram), "name long, ctx long, doc long, tp long, lr int, state tinyint")
    found = found.repartition("name")  # serves both windows
    same = Window.partitionBy("name", "ctx").orderBy("doc", "tp")
    name = Window.partitionBy("name")
    differs = lambda d, t: (d != F.col("doc")) | (t != F.col("tp"))
    found = found.withColumns({"nth": F.row_number().over(same), "fd": F.first("doc").over(same), "ft": F.first("tp").over(same), "nd": F.lead("doc").over(same), "nt": F.lead("tp").over(same)})
    again = differs(F.col("fd"), F.col("ft")) | (F.col("state") == LATER)
    if not earlier:
        again = again | (F.col("state") == FIRST) | F.coalesce(differs(F.col("nd"), F.col("nt")), F.lit(False))
    found = found.withColumn("n_ctx", F.sum(F.when(F.col("nth") == 1, 1).otherwise(0)).over(name))
    found = found.select("doc", F.col("tp").bitwiseAND(0xFFFFFFFF).cast("int").alias("tk"), F.shiftright("tp", 32).cast("int").alias("pos"), F.shiftright("lr", 16).alias("left"), F.col("lr").bitwiseAND(0xFFFF).alias("right"), again.alias("decided"), ((F.col("nth") == 1) & (F.col("n_ctx") > 1) & (F.col("state") != LATER)).alias("open"), (F.col("n_ctx") > SHARD).alias("hot"))
    found = staged(found.where("decided or open"), "anchors")
    asks = found.where("open").withColumns({"gl": F.lit(0), "gr": F.lit(0)})
    halves = _halves(length - gram)
    sides = ["doc", "tk", "pos", "left", "right"]
    asks = asks.where("not hot").select(*sides, "gl", "gr").unionByName(asks.where("hot").select(*sides, F.inline(halves)))
    spans = [found.where("decided").select("doc", "tk", (F.col("pos") - F.col("left")).alias("lo"), (F.col("pos") + F.col("right")).alias("hi"))]
    while True:
        by_doc = staged(asks.groupBy("doc", "tk").agg(F.collect_list(F.struct("pos", "gl", "gr", "left", "right")).alias("found")), "open")
        parts = joined(rows, by_doc, "found", "inner").mapInArrow(_contexts_of(kind, length, gram), "key long, need int, doc long, tk int, at int, left int, gl int, gr int, before int, after int, symbols binary")
        parts = staged(parts, "contexts")
        sizes = parts.where("gl + gr > 0").groupBy("key").agg(F.count("*").alias("c"))  # others fit, as counted above
        large = staged(sizes.where(F.col("c") > SHARD).select("key"), "large")
        more = not empty(large)
        if more:
            few = F.broadcast(large) if large.count() <= BROADCAST_ENTRIES else large
            hot, parts = parts.join(few, "key", "left_semi"), parts.join(few, "key", "left_anti")
            spans.append(_equal(hot.where("need = 1"), earlier).withColumn("hi", F.col("lo") + length))
            asks = hot.where("need > 1").select("doc", "tk", (F.col("at") + F.col("gl")).alias("pos"), F.col("before").alias("left"), F.col("after").alias("right"), "gl", "gr", (F.col("need") - 1).alias("s"))
            asks = asks.select(*sides, F.inline(_halves(F.col("s"), F.col("gl"), F.col("gr"))))
        n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sharded = parts.select("key", "need", "doc", "tk", "at", "left", "symbols").repartition(n * 2, "key").sortWithinPartitions("key", "doc", "at", "tk")
        spans.append(sharded.mapInArrow(lambda it: _groups(it, resolve, length), "doc long, tk int, lo int, hi int"))
        if not more:
            break
    spans = reduce(DataFrame.unionByName, spans).groupBy("doc", "tk").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return staged(spans.mapInArrow(_merged, f"doc long, tk int, ranges {RANGES}"), "ranges")


def _halves(s: int | F.Column, gl: F.Column | None = None, gr: F.Column | None = None) -> F.Column:
    """The two extensions of an anchor extended by gl and gr, where a passage has s units besides: any passage has s units
    beside the anchor, so `half` to its left, or else more than s - half to its right."""
    s = F.lit(s) if isinstance(s, int) else s
    gl, gr = F.lit(0) if gl is None else gl, F.lit(0) if gr is None else gr
    half = F.ceil(s / 2).cast("int")
    return F.array(F.struct((gl + half).alias("gl"), gr.alias("gr")), F.struct(gl.alias("gl"), (gr + s - half + 1).alias("gr")))


def _equal(parts: DataFrame, earlier: bool) -> DataFrame:
    """Begins of repeated passages, where the anchor is the passage: rows of a key are equal."""
    place = F.struct("doc", "at", "tk")
    ends = parts.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    found = parts.join(ends, "key").where((place != F.col("first")) if earlier else (F.col("first") != F.col("last")))
    return found.select("doc", "tk", F.col("at").alias("lo"))


def scan(docs: DataFrame, ranges: DataFrame, each: Callable[[str, list[tuple[int, int]]], tuple], schema: str) -> DataFrame:
    """each(text, ranges of it) of every row of docs, after its doc_id."""
    rows = joined(keyed(docs), ranges, "ranges", "left").select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "text", "ranges")
    names = [x.split()[0] for x in schema.split(",")]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [each(t, [(r["lo"], r["hi"]) for r in x or ()]) for t, x in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **{n: [x[i] for x in out] for i, n in enumerate(names)}})

    return rows.mapInArrow(go, f"doc_id long, {schema}")
