"""Repeated byte strings, by difference-cover suffix sorting of shards.

`repeats` deals the corpus into shards of contexts that share a long string. A shard's contexts, end to end, are suffix
sorted with the difference cover {1, 2} modulo 3: the triples at sampled places are sorted and named, the names' string is sorted
by recursion unless all differ, the remaining suffixes are sorted by first symbol and rank of the rest, and both
orders are merged. Neighbours in the suffix order whose prefixes of the wanted length are equal, compared byte by byte, are repeats.

Sorting all suffixes of the corpus in one order would move some 20 bytes per byte in each round; the shards hold only
what anchors leave undecided.

Cases: null and empty texts have no bytes; texts shorter than a passage lose nothing; passages that overlap in one
document count; rows that repeat doc_id and text are one document (their copies alone remove nothing), and equal results
come back for each; rows that repeat doc_id alone are different documents; other columns are left aside.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from candor.llm import repeats
from candor.llm.anchors import Units
from candor.llm.common import mixed

#: Bytes of an anchor; any passage of the length removed has one.
GRAM = 128


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Begins of the suffixes of s (values from 1) in order; a suffix comes before those that it begins."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    top = int(s.max()) + 1
    if top > 1_000_000 and top > n:
        s = np.unique(s, return_inverse=True)[1] + 1
        top = int(s.max()) + 1
    x = np.concatenate([s, np.zeros(3, np.int64)]).astype(np.int64)
    ones = np.arange(1, n + (n % 3 == 1), 3)  # one more if needed, so that the mod-1 triples end in a zero
    places = np.concatenate([ones, np.arange(2, n, 3)])
    if float(top) ** 3 < 9e18:
        triple = (x[places] * top + x[places + 1]) * top + x[places + 2]
        order = np.argsort(triple)
        new = np.diff(triple[order], prepend=-1) != 0
    else:
        cols = x[places], x[places + 1], x[places + 2]
        order = np.lexsort(cols[::-1])
        new = np.ones(len(order), bool)
        new[1:] = np.any([np.diff(c[order]) != 0 for c in cols], axis=0)
    names = np.empty(len(places), np.int64)
    names[order] = np.cumsum(new)
    if not new.all():
        order = suffix_array(names)
    sample = places[order]
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = np.arange(1, len(sample) + 1)
    sample = sample[sample < n]
    rest = np.arange(0, n, 3)
    size = n + 3
    rest = rest[np.argsort(x[rest] * size + rank[rest + 1])]
    first = sample[sample % 3 == 1]
    second = sample[sample % 3 == 2]
    before = np.searchsorted(x[first] * size + rank[first + 1], x[rest] * size + rank[rest + 1])
    pairs = np.unique(np.concatenate([x[second] * top + x[second + 1], x[rest] * top + x[rest + 1]]), return_inverse=True)[1]
    before += np.searchsorted(pairs[: len(second)] * size + rank[second + 2], pairs[len(second) :] * size + rank[rest + 2])
    out = np.empty(n, np.int64)
    at = np.arange(len(rest)) + before
    out[at] = rest
    others = np.ones(n, bool)
    others[at] = False
    out[others] = sample
    return out


def sharing(bounds: np.ndarray, need: np.ndarray, left: np.ndarray, symbols: list[bytes]) -> np.ndarray:
    """Which rows can have a passage in common with another row of their shard: a passage has half of its symbols to the left
    of the anchor or more than the other half to its right, so rows that share neither with another row don't."""
    sizes = np.array([len(x) for x in symbols], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    units = Units(mixed(np.frombuffer(b"".join(symbols), np.uint8).astype(np.uint64) + np.uint64(1)), begin)
    group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)).astype(np.uint64)
    half = need // 2
    out = np.zeros(len(symbols), bool)
    anchor = begin[:-1] + left
    for lo, hi, whole in ((anchor - half, anchor, left >= half), (anchor, anchor + need - half, sizes - left >= need - half)):
        rows = np.flatnonzero(whole)
        key = mixed(units.hashed(lo[rows], hi[rows]) + group[rows] * np.uint64(0x9E3779B97F4A7C15))
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        out[rows[count[which] > 1]] = True
    return out


def neighbours_share(s: np.ndarray, order: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Whether each suffix in order and the next begin with the same `need` symbols, compared symbol by symbol: a step of
    the loop compares one symbol of all pairs that are equal so far."""
    a, b, n = order[:-1], order[1:], need[:-1]
    open_ = np.flatnonzero(n == need[1:])
    out = np.zeros(len(a), bool)
    k = 0
    while len(open_):
        done = n[open_] == k
        out[open_[done]] = True
        open_ = open_[~done]
        open_ = open_[s[a[open_] + k] == s[b[open_] + k]]
        k += 1
    return out


def resolve(bounds: np.ndarray, need: np.ndarray, left: np.ndarray, symbols: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and offsets (bytes from the context's begin) of passages that another place of the shard has. need: symbols of a
    passage, the anchor being one."""
    group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    rows = np.flatnonzero(sharing(bounds, need, left, symbols))
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    symbols, left, need = [symbols[i] for i in rows], left[rows], need[rows]
    sizes = np.array([len(x) for x in symbols]) + 2  # with the anchor and a mark after the context
    begin = np.concatenate([[0], np.cumsum(sizes)])
    s = np.ones(begin[-1], np.int64)
    own = np.ones(begin[-1], bool)
    own[begin[1:] - 1] = False
    own[begin[:-1] + left] = False
    s[own] = np.frombuffer(b"".join(symbols), np.uint8).astype(np.int64) + 2
    s[begin[:-1] + left] = 258 + np.unique(group[rows], return_inverse=True)[1]
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = suffix_array(s)
    order = order[order + need[row[order]] < begin[row[order] + 1]]
    equal = neighbours_share(s, order, need[row[order]])
    found = order[np.r_[equal, False] | np.r_[False, equal]]
    return rows[row[found]], found - begin[row[found]]


def repeated(docs: DataFrame, length: int = 200, gram: int = GRAM) -> DataFrame:
    """doc, tk, ranges (in bytes): what strings of `length` bytes that also begin elsewhere cover."""
    return repeats.find(docs, repeats.Bytes, length, gram, False, resolve)


def without(text: str, ranges: list[tuple[int, int]]) -> tuple[int, int, int, bytes]:
    """Number of bytes, of removed bytes and of removed runs, and the remaining bytes."""
    raw = text.encode("utf-8", "surrogatepass")
    kept, at = [], 0
    for lo, hi in ranges:
        kept.append(raw[at:lo])
        at = hi
    left = b"".join([*kept, raw[at:]])
    return len(raw), len(raw) - len(left), len(ranges), left


def removed(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (what is left)."""
    return repeats.scan(docs, repeated(docs, length), without, "n_bytes long, n_removed long, n_spans long, kept binary")


def digests(docs: DataFrame, length: int = 200) -> DataFrame:
    """As removed, with the hash of the bytes left in their place."""

    def each(text: str, ranges: list[tuple[int, int]]) -> tuple[int, int, int, str]:
        n, gone, spans, kept = without(text, ranges)
        return n, gone, spans, hashlib.sha256(kept).hexdigest()

    return repeats.scan(docs, repeated(docs, length), each, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
