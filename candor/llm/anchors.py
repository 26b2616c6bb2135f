"""Anchors of repeated passages: what two texts that share a passage are sure to have in common.

A text is a row of units (words or bytes). Of each `length` consecutive units, the sub-row of `gram` units with the
smallest hash is an anchor, so equal passages have the same anchor at the same place. All ties count as anchors.
"""

from __future__ import annotations

import numpy as np

from candor.llm.common import mixed
from candor.llm.words import INVERSES, POWERS

MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


class Units:
    """The units of several texts, end to end: values (64-bit, random), and where each text begins (offsets, with the
    end as last)."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray) -> None:
        self.offsets, self.size = offsets, len(values)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * POWERS.upto(len(values)), dtype=np.uint64, out=self.sums[1:])
        self.end = np.repeat(offsets[1:], np.diff(offsets))  # of the text that a unit is in

    def hashed(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * INVERSES.upto(self.size + 1)[start] + (end - start).astype(np.uint64))

    def grams(self, gram: int) -> np.ndarray:
        """Hashes of all sub-rows of `gram` units."""
        n = max(0, self.size - gram + 1)
        return mixed((self.sums[gram:] - self.sums[: self.size + 1 - gram]) * INVERSES.upto(self.size + 1)[:n]) if n else np.zeros(0, np.uint64)

    def rows(self, start: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, start, side="right") - 1


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """out[i]: best of x[i : i + width], for each full window."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[:-step], out[step:])
        have += step
    return out


def anchors(units: Units, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of anchors, and begin and end of the passages whose anchor each is: those that hold it and no gram with a smaller
    hash, which begin one after another."""
    width = length - gram + 1
    n = units.size - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none
    g = units.grams(gram)
    low = _sliding(g, width, np.minimum)  # of the passage that begins here
    low = np.where(np.arange(n) + length <= units.end[:n], low, 0)  # passages end in their text
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    high = _sliding(padded, width, np.maximum)[: len(g)]  # of the passages that hold the gram
    at = np.flatnonzero((high == g) & (high > 0))
    begins = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])  # of runs of passages with the same least hash
    ends = np.r_[begins[1:], n] - 1
    first = np.searchsorted(begins, np.maximum(at - width + 1, 0), side="right") - 1
    run, todo = first.copy(), np.flatnonzero(low[begins[first]] != g[at])
    while len(todo):
        run[todo] += 1
        todo = todo[low[begins[run[todo]]] != g[at[todo]]]
    lo = np.maximum(begins[run], at - width + 1)
    return at, lo, np.minimum(ends[run], at) + length


def contexts(units: Units, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each anchor: its name (hash of the gram), and hash of the passages whose anchor it is and of its place in them."""
    return units.hashed(at, at + gram), mixed(units.hashed(lo, hi) ^ ((at - lo) * 1_000_003 + (hi - at)).astype(np.uint64))
