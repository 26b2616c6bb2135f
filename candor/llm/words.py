"""Words of many texts at once: positions and 64-bit hashes, by array operations over the UTF-8 bytes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

from candor.llm.common import mixed

#: Polynomial hashes modulo 2^64 are equal for certain long texts (Thue-Morse sequences from some 1,000 letters on); words of
#: more bytes than this are hashed otherwise.
LONG_WORD = 64

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(1)
def byte_values() -> np.ndarray:
    """A random 64-bit value for each byte."""
    return np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Powers:
    def __init__(self, base: int) -> None:
        self.base, self.held = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.held) < n:
            size = max(n, 1 << 16)
            out = np.full(size, self.base, np.uint64)
            out[0] = 1
            self.held = np.cumprod(out, dtype=np.uint64)
        return self.held[:n]


POWERS, INVERSES = _Powers(_BASE), _Powers(_INVERSE)


def bytes_of(*codes: int) -> np.ndarray:
    """A table of 256 that is true at the codes."""
    out = np.zeros(256, bool)
    out[list(codes)] = True
    return out


_SPACE = bytes_of(0x20, *range(0x09, 0x0E))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """sums[i]: of value(byte j) * base^j over j < i, modulo 2^64."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(byte_values()[raw] * POWERS.upto(len(raw)), dtype=np.uint64, out=sums[1:])
    return sums


def spans_hashed(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span: equal bytes, equal hash, wherever they stand."""
    return mixed((sums[end] - sums[start]) * INVERSES.upto(len(sums))[start] + (end - start).astype(np.uint64))


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return _LOWER[raw]


def find_words(raw: np.ndarray, offsets: np.ndarray, lower: bool = False, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, runs of bytes that don't set words apart (white space), of texts laid end to end: hash, text number, begin and end
    byte. lower: A-Z count as a-z."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    inside = ~apart[raw]
    cut = np.zeros(len(raw) + 1, bool)  # a text begins here
    cut[offsets] = True
    before = np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    before[cut[:-1]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(raw), bool)
    after[:-1] = inside[1:]
    after[cut[1:]] = False
    end = np.flatnonzero(inside & ~after) + 1
    raw = lowered(raw) if lower else raw
    hashes = spans_hashed(prefix_sums(raw), start, end)
    for i in np.flatnonzero(end - start > LONG_WORD):
        hashes[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]].tobytes())
    return hashes, np.searchsorted(offsets, start, side="right") - 1, start, end


_STEP = np.uint64(0xD6E8FEB86659FD93)


def sequences_hashed(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= _STEP
        out += words[i : i + n]
    return mixed(out + np.uint64(k))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of k-word shingles of one text, sorted; of fewer words, that of the whole sequence."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(sequences_hashed(words, min(k, len(words))))
