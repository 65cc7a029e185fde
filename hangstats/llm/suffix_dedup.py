"""Repeated byte strings by prefix-free parsing.

A rolling hash over eight bytes triggers the ends of phrases, so equal bytes
give equal phrases. A phrase is named by its content with the trigger that ends
it; the names make up the parse. The suffixes of the parse, cut to the phrases
that cover the first bytes, are the symbols that order windows into classes:
what the suffix arrays of dictionary and parse would put side by side gets the
same key. The parts of phrases at both ends of a window are told apart by
comparing digests of the text itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from hangstats.llm.common import encoded
from hangstats.llm.repeats import Pack, Symbols, repeated_windows, without_repeats
from hangstats.llm.words import mixed

SIZE, BLOCK = 400, 12
#: One trigger in so many bytes; a symbol is the phrases from a trigger on that cover so many bytes.
_RARITY_BITS, _COVER, _TRIGGER = 3, 96, 8
#: No trigger within so many bytes.
_QUIET = 64
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.Generator(np.random.PCG64(5))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 2**64, 4096, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_EMPTY = Symbols(np.empty(0, np.uint64), np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), base)]))[:n]


def parse_suffixes(data: bytes) -> Symbols:
    """For each trigger, the phrases from it on that cover enough bytes, named by their contents."""
    if len(data) < _COVER:
        return _EMPTY
    raw = np.frombuffer(data, dtype=np.uint8)
    rolling = np.ndarray(len(data) - _TRIGGER + 1, dtype="<u8", buffer=data, strides=(1,)) * _SPREAD
    triggers = np.flatnonzero(rolling >> np.uint64(64 - _RARITY_BITS) == 0)
    if len(triggers) < 2:
        return _EMPTY
    place = np.arange(len(raw))
    begun = np.zeros(len(raw), dtype=np.int64)
    begun[triggers] = triggers
    value = _BYTE[raw] * _PLACE[(place - np.maximum.accumulate(begun)) & (len(_PLACE) - 1)]
    lengths = np.diff(triggers)
    names = np.add.reduceat(value, triggers)[:-1]
    names = mixed(names + mixed(rolling[triggers[1:]]) + lengths.astype(np.uint64) * _BASE)
    # Names of consecutive phrases, as differences of sums over the parse.
    n = len(names)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(names * _powers(_BASE, n))])
    stop = np.searchsorted(triggers, triggers[:-1] + (_COVER - _TRIGGER))
    whole = np.flatnonzero(stop <= n)
    stop = stop[whole]
    combined = mixed((sums[stop] - sums[whole]) * _powers(_BASE_INVERSE, n)[whole])
    starts = triggers[whole]
    return Symbols(combined, mixed(combined), starts, starts, triggers[stop] + _TRIGGER)


def quiet_places(data: bytes) -> Symbols:
    """Places far from any trigger, named by their bytes: for windows with too few triggers, in periodic text mostly."""
    if len(data) < 2 * _QUIET + _TRIGGER:
        return _EMPTY
    rolling = np.ndarray(len(data) - _TRIGGER + 1, dtype="<u8", buffer=data, strides=(1,))
    triggers = np.flatnonzero(rolling * _SPREAD >> np.uint64(64 - _RARITY_BITS) == 0)
    bounds = np.concatenate([[-1], triggers, [len(rolling)]])
    gaps = np.flatnonzero(np.diff(bounds) > 2 * _QUIET)
    places = [np.arange(max(bounds[g] + _QUIET + 1, _QUIET), bounds[g + 1] - _QUIET) for g in gaps]
    at = np.concatenate([np.empty(0, np.int64), *places]).astype(np.int64)
    at = at[at + _QUIET + _TRIGGER <= len(data)]
    total = np.zeros(len(at), dtype=np.uint64)
    for i in range(_QUIET // 8):
        total += rolling[at + 8 * i] * _PLACE[i]
    names = mixed(total)
    return Symbols(names, mixed(names), at, at - _QUIET, at + _QUIET + _TRIGGER)


def parse_bytes(texts: list[str | None], with_symbols: bool) -> Pack:
    data = encoded(texts)
    first = np.concatenate([[0], np.cumsum([len(d) for d in data], dtype=np.int64)])
    joined = b"".join(data)
    place = np.arange(len(joined), dtype=np.int64)
    return Pack(
        joined, place, place + 1, first, parse_suffixes(joined) if with_symbols else None, lambda: quiet_places(joined)
    )


SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<array<bigint>>"


def remove_repeated_bytes(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Every whole text without the bytes of strings of ``size`` bytes that also start elsewhere.

    A row for each row of ``docs``. NULL and empty texts have no bytes; rows
    repeated in ``docs`` count as further occurrences; windows do not cross
    texts. ``spans``: the removed ranges in bytes. A cut may split a character.
    """
    texts, listed = repeated_windows(docs, parse_bytes, size, BLOCK)

    def cut(doc_id: int | None, data: bytes, spans: list[tuple[int, int]]) -> tuple:
        kept, done = hashlib.sha256(), 0
        for a, b in spans:
            kept.update(data[done:a])
            done = b
        kept.update(data[done:])
        return doc_id, len(data), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [list(s) for s in spans]

    return without_repeats(texts, listed, size, SCHEMA, cut)
