"""Repeated word passages, by suffix automata of reference shards.

`repeats` deals the corpus into shards of contexts that share a long word sequence. For each shard a suffix automaton is
grown over its reference contexts in corpus order; each context is first streamed through the automaton of the
earlier ones. Its matching statistics (the longest earlier match that ends at each symbol) show the passages that also
begin earlier, and the context then joins the reference. An automaton holds one shard, so it is bounded, however large
the corpus.

Cases: null and empty texts have no words; a text shorter than a passage loses nothing; rows that repeat doc_id and
text are one document, and equal results come back for each; rows that repeat doc_id alone count as documents of which
the earlier place comes first; a null doc_id is the smallest; other columns are left aside.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame

from candor.llm import repeats

#: Words of an anchor; any passage of the length removed has one.
GRAM = 12
WORD = re.compile(r"[^ \t-\r]+")


class Automaton:
    """Suffix automaton of several sequences, grown one at a time."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, symbols: list[int]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in symbols:
            if c in nxt[last]:  # of an earlier sequence
                q = nxt[last][c]
                last = q if length[q] == length[last] + 1 else self._split(last, c, q)
                continue
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = new

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link = self.next, self.link
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        self.length.append(self.length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def statistics(self, symbols: list[int]) -> list[int]:
        """For each symbol, the length of the longest match that ends there."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        out = []
        for c in symbols:
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                size += 1
            out.append(size)
        return out


def resolve(bounds: np.ndarray, need: np.ndarray, left: np.ndarray, symbols: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and offsets (units from the context's begin) of passages that an earlier row of the shard has. need: symbols of a
    passage, the anchor being one."""
    which, offset = [], []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        reference, enough = Automaton(), int(need[lo])
        for i in range(lo, hi):
            around = np.frombuffer(symbols[i], np.uint64).tolist()
            around.insert(int(left[i]), -1)
            if i > lo:
                for end, size in enumerate(reference.statistics(around)):
                    if size >= enough:
                        which.append(i)
                        offset.append(end - enough + 1)
            if i + 1 < hi:
                reference.add(around)
    return np.array(which, np.int64), np.array(offset, np.int64)


def repeated(docs: DataFrame, length: int = 20, gram: int = GRAM) -> DataFrame:
    """doc, tk, ranges (in words): what passages of `length` words that also begin earlier cover."""
    return repeats.find(docs, repeats.Words, length, gram, True, resolve)


def without(text: str, ranges: list[tuple[int, int]]) -> tuple[int, int, str]:
    """Number of words, of removed words, and the kept words joined by a space."""
    words = WORD.findall(text)
    kept, at = [], 0
    for lo, hi in ranges:
        kept += words[at:lo]
        at = hi
    kept += words[at:]
    return len(words), len(words) - len(kept), " ".join(kept)


def removed(docs: DataFrame, length: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, text (what is left)."""
    return repeats.scan(docs, repeated(docs, length), without, "n_words long, n_removed long, text string")


def digests(docs: DataFrame, length: int = 20) -> DataFrame:
    """As removed, with the hash of the text left in its place, so that texts needn't leave the executors."""

    def each(text: str, ranges: list[tuple[int, int]]) -> tuple[int, int, str]:
        n, gone, kept = without(text, ranges)
        return n, gone, hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()

    return repeats.scan(docs, repeated(docs, length), each, "n_words long, n_removed long, kept_sha256 string")
