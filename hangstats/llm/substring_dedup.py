"""Repeated word sequences by recompression.

Rounds rename a text: first each run of one token becomes a token, then, with
all tokens dealt into left and right ones by name, each left one and the right
one after it become a token. A name is a hash of what it stands for, so the same
for every text of the corpus without a table of names. Next to each token goes
the range of words that decided it; equal word sequences have equal tokens in
their interior, and those link repeats, which digests of the words then verify.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from hangstats.llm.common import encoded
from hangstats.llm.repeats import Pack, Symbols, repeated_windows, without_repeats
from hangstats.llm.words import mixed, words_of

SIZE, BLOCK, ROUNDS = 35, 4, 4
#: Tokens of fewer words are taken only where a window has no longer one.
_LEAST_WORDS = 3
_RUN, _PAIR = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def _grouped(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the groups that begin where ``new`` is true."""
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(new)) - 1


def recompress(words: np.ndarray, rounds: int = ROUNDS) -> tuple[Symbols, np.ndarray, np.ndarray]:
    """Tokens after some rounds over one sequence of word hashes, with the first and the last word of each.

    Contexts: that a run ends is seen from the next word alone, if that is not
    the first word of the token; else, and for a token that found no partner,
    from all that decides the neighbour. Beyond the ends of the sequence nothing
    is known, so what depends on them has an endless context.
    """
    n = len(words)
    names, begin, end = words, np.arange(n), np.arange(n)
    low, high = begin.copy(), end + 1
    far = 1 << 40
    for turn in range(rounds):
        # Runs.
        new = np.ones(len(names), dtype=bool)
        new[1:] = names[1:] != names[:-1]
        first, last = _grouped(new)
        times = (last - first + 1).astype(np.uint64)
        run = np.where(times > 1, mixed(names[first] * _RUN + times), names[first])
        before, after = begin[first] - 1, end[last] + 1
        left, right = np.append(-far, low)[first], np.append(high, far)[last + 1]
        seen = (before >= 0) & (words[before] != words[end[first]])
        left = np.where(seen, np.minimum(low[first], before), left)
        seen = (after < n) & (words[np.minimum(after, n - 1)] != words[begin[last]])
        right = np.where(seen, np.maximum(high[last], after + 1), right)
        names, begin, end, low, high = run, begin[first], end[last], left, right
        # Pairs.
        is_right = mixed(names + np.uint64(turn + 1)) >> np.uint64(63) == 1
        joined = np.zeros(len(names), dtype=bool)  # with the token before it
        joined[1:] = ~is_right[:-1] & is_right[1:]
        first, last = _grouped(~joined)
        pair = first < last
        name = np.where(pair, mixed(mixed(names[first] * _PAIR) + names[last]), names[first])
        left, right = low[first].copy(), high[last].copy()
        alone_right, alone_left = ~pair & is_right[first], ~pair & ~is_right[first]
        left[alone_right] = np.append(-far, low)[first[alone_right]]
        right[alone_left] = np.append(high, far)[last[alone_left] + 1]
        names, begin, end, low, high = name, begin[first], end[last], left, right
    short = (end - begin + 1 < _LEAST_WORDS).astype(np.uint64) << np.uint64(63)
    return Symbols(names, mixed(names) >> np.uint64(1) | short, begin, low, high), begin, end


def triples(words: np.ndarray) -> Symbols:
    """Every three words, decided by themselves alone: for windows whose tokens reach too far, in repetitive text."""
    at = np.arange(max(len(words) - 2, 0))
    names = mixed(mixed(words[at] * _RUN + words[at + 1]) * _PAIR + words[at + 2])
    return Symbols(names, mixed(names), at, at, at + 3)


def parse_words(texts: list[str | None], with_symbols: bool) -> Pack:
    """Words joined by one space; contexts keep symbols that reach over the end of a text out of every window."""
    words = words_of([b" ".join(t.split()) for t in encoded(texts)], marks_split=False, fold=False)
    symbols = recompress(words.hashes)[0] if with_symbols and len(words.hashes) else None
    if symbols is None:
        symbols = Symbols(np.empty(0, np.uint64), np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)))
    return Pack(words.data, words.starts, words.ends, words.first, symbols, lambda: triples(words.hashes))


SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans array<array<bigint>>"


def remove_repeated_words(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Every whole text without the words of windows of ``size`` words that also start elsewhere.

    A row for each row of ``docs``. NULL and empty texts have no words; rows
    repeated in ``docs`` count as further occurrences; windows do not cross
    texts. ``spans``: the removed ranges in words.
    """
    texts, listed = repeated_windows(docs, parse_words, size, BLOCK)

    def cut(doc_id: int | None, data: bytes, spans: list[tuple[int, int]]) -> tuple:
        words, kept, done = data.split(), [], 0
        for a, b in spans:
            kept += words[done:a]
            done = b
        kept += words[done:]
        digest = hashlib.sha256(b" ".join(kept)).hexdigest()
        return doc_id, len(words), sum(b - a for a, b in spans), digest, [list(s) for s in spans]

    return without_repeats(texts, listed, size, SCHEMA, cut)
