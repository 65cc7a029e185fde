"""Word hashes of many texts at once, without a Python step for each word."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BYTE_CASED = _rng.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
#: Multipliers by position in the word; longer words start over.
_PLACE = _rng.integers(1, 2**64, 4096, dtype=np.uint64) | np.uint64(1)

_SPACES = np.ones(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = False
_MARKS = np.zeros(256, dtype=bool)
_MARKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words(NamedTuple):
    """Words of a pack of texts: hash, byte range in ``data``, and ``first[i]``: index of the first word of text i."""

    data: bytes
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    offsets: np.ndarray


def words_of(texts: list[bytes], marks_split: bool = True, fold: bool = True) -> Words:
    """Words are runs of letters, digits and bytes above 127 (``marks_split``), or runs of non-space bytes.

    ``fold``: A-Z hash as a-z.
    """
    data = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(data, dtype=np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    offsets = np.concatenate([[0], np.cumsum(sizes)])[: len(texts) + 1] if texts else np.zeros(1, np.int64)
    inside = (_MARKS if marks_split else _SPACES)[raw]
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        change = np.concatenate([[0], change])
    starts, ends = change[0::2], change[1::2]
    if not len(starts):
        empty = np.empty(0, np.int64)
        return Words(data, np.empty(0, np.uint64), empty, empty, np.zeros(len(texts) + 1, np.int64), offsets)
    place = np.arange(len(raw), dtype=np.int64)
    begun = np.zeros(len(raw), dtype=np.int64)
    begun[starts] = starts
    place -= np.maximum.accumulate(begun)
    place &= len(_PLACE) - 1
    value = (_BYTE if fold else _BYTE_CASED)[raw]
    value *= _PLACE[place]
    value *= inside
    hashes = mixed(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64))
    return Words(data, hashes, starts, ends, np.searchsorted(starts, offsets), offsets)


def doc_of_word(words: Words) -> np.ndarray:
    return np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))


class Lookup:
    """Index of each hash in a bounded sorted list, or -1. A bitmap turns most misses away."""

    def __init__(self, hashes: np.ndarray, bits: int = 18):
        self.hashes, self.shift = hashes, np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, dtype=bool)
        self.seen[hashes >> self.shift] = True

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` that are in the list, and where in the list."""
        maybe = np.flatnonzero(self.seen[hashes >> self.shift])
        if not len(self.hashes) or not len(maybe):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        wanted = hashes[maybe]
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        sure = self.hashes[at] == wanted
        return maybe[sure], at[sure]
