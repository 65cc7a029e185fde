"""Benchmark passages in training texts, found by spaced seeds.

A mask fixes which words of a span take part in a hash, so a changed word
outside of it does no harm; several masks leave out different places, so that no
choice of as many changed words as are allowed spoils all of them. Hashes of
the benchmark, in blocks of bounded size, are looked up by the hashes at every
word of every text. Around each hit the text is laid on the benchmark passage
word by word and the stretch in which enough words agree is measured.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hangstats.llm.common import encoded, filter_rows, id_and_text, map_rows
from hangstats.llm.words import Lookup, Words, mixed, words_of

#: A text is contaminated by a stretch of so many words (or the whole passage, if shorter) of which so many agree.
LEAST_WORDS, LEAST_PART = 13, 0.8
#: 1: the word takes part. Wherever two of 13 words differ, one of these misses both in at least one place, so every
#: stretch that counts is hit (the tests try all places).
MASKS = ("111110101", "1010011111", "11101010011")
#: Words of benchmark passages in one block: about 24 bytes for each mask and word are sent to the tasks.
BLOCK_WORDS = 1_000_000

_WEIGHTS = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, LEAST_WORDS, dtype=np.uint64) * np.uint64(
    2
) + np.uint64(1)


def _words(texts: list[str | None]) -> Words:
    return words_of(encoded([(text or "").lower() for text in texts]))


def masks_for(size: int) -> list[str]:
    """The masks that find a passage of ``size`` words.

    A passage shorter than a stretch is laid down as a whole and has masks of
    its own length: its words are dealt to two groups more than words may
    differ, and each mask leaves out as many groups as words may differ.
    """
    if size >= LEAST_WORDS:
        return list(MASKS)
    if not size:
        return []
    free = size - math.ceil(LEAST_PART * size)
    groups = free + 2 if free else 1
    return [
        "".join("0" if i % groups in out else "1" for i in range(size))
        for out in itertools.combinations(range(groups), free)
    ]


def seed_hashes(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the masked words from each word on, for all places where the whole mask fits."""
    count = len(hashes) - len(mask) + 1
    total = np.zeros(max(count, 0), dtype=np.uint64)
    if count > 0:
        for i, bit in enumerate(mask):
            if bit == "1":
                total += hashes[i : i + count] * _WEIGHTS[i]
    return mixed(total)


class Block(NamedTuple):
    """Seeds of some benchmark passages. ``tables``: (mask, sorted hashes, passage and place of each)."""

    items: np.ndarray
    words: np.ndarray
    first: np.ndarray
    tables: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]


def block_of(items: list[tuple[int, str | None]]) -> Block:
    """Index a bounded list of passages; those without words match nothing."""
    words = _words([text for _, text in items])
    parts: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for i in range(len(items)):
        own = words.hashes[words.first[i] : words.first[i + 1]]
        for mask in masks_for(len(own)):
            found = seed_hashes(own, mask)
            parts.setdefault(mask, []).append((found, np.full(len(found), i), np.arange(len(found))))
    tables = []
    for mask, found in sorted(parts.items()):
        hashes, passage, place = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(hashes, kind="stable")
        tables.append((mask, hashes[order], passage[order], place[order]))
    ids = np.array([i if i is not None else -1 for i, _ in items], dtype=np.int64)
    return Block(ids, words.hashes, words.first, tables)


def blocks_of(benchmark: DataFrame, most: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark in blocks of at most ``most`` words (or of one passage), streamed through the driver."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        n = len((row[1] or "").split()) + 1
        if held and size + n > most:
            yield block_of(held)
            held, size = [], 0
        held.append((row[0], row[1]))
        size += n
    if held:
        yield block_of(held)


class Overlap(NamedTuple):
    text: int
    passage: int
    start: int
    words: int
    agreeing: int


class Scanner:
    """Overlaps of texts with one block."""

    def __init__(self, block: Block):
        self.block = block
        self.lookups = [Lookup(np.unique(hashes)) for _, hashes, _, _ in block.tables]

    def __getstate__(self) -> Block:
        return self.block

    def __setstate__(self, block: Block) -> None:
        self.__init__(block)

    def _laid(self, words: Words) -> np.ndarray:
        """(text, passage, difference of positions) of all hits, each once."""
        found = [np.empty((0, 3), dtype=np.int64)]
        for (mask, hashes, passage, place), lookup in zip(self.block.tables, self.lookups, strict=True):
            at, entry = lookup.hits(seed_hashes(words.hashes, mask))
            if not len(at):
                continue
            text = np.searchsorted(words.first, at, side="right") - 1
            inside = at + len(mask) <= words.first[text + 1]
            at, text, wanted = at[inside], text[inside], lookup.hashes[entry[inside]]
            low, high = np.searchsorted(hashes, wanted), np.searchsorted(hashes, wanted, side="right")
            counts = high - low
            index = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            laid = np.stack([np.repeat(text, counts), passage[index], np.repeat(at, counts) - place[index]], axis=1)
            found.append(np.unique(laid, axis=0))
        return np.unique(np.concatenate(found), axis=0)

    def overlaps(self, texts: list[str | None]) -> list[Overlap]:
        """The longest accepted stretch of each (text, passage, difference of positions)."""
        words = _words(texts)
        out = []
        for text, passage, shift in self._laid(words).tolist():
            own = self.block.words[self.block.first[passage] : self.block.first[passage + 1]]
            low, high = max(shift, int(words.first[text])), min(shift + len(own), int(words.first[text + 1]))
            agree = np.concatenate([[0], np.cumsum(words.hashes[low:high] == own[low - shift : high - shift])])
            size = min(LEAST_WORDS, len(own))
            if high - low < size:
                continue
            good = np.flatnonzero(agree[size:] - agree[:-size] >= LEAST_PART * size)
            if not len(good):
                continue
            # Overlapping good windows make one stretch.
            cuts = np.flatnonzero(np.diff(good) > size)
            firsts, lasts = good[np.concatenate([[0], cuts + 1])], good[np.concatenate([cuts, [len(good) - 1]])] + size
            best = int(np.argmax(lasts - firsts))
            a, b = int(firsts[best]), int(lasts[best])
            out.append(
                Overlap(text, passage, low + a - int(words.first[text]), b - a, int(agree[b] - agree[a]))
            )
        return out


SCHEMA = (
    "doc_id bigint, item_id bigint, start_word bigint, n_words bigint, n_agreeing bigint, item_words bigint, "
    "part_of_item double"
)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Each (document, passage) with a shared stretch; of several, the longest, then the first.

    Only contaminated documents have rows. NULL and empty texts and passages
    match nothing; rows repeated in ``docs`` give repeated rows, NULL document ids
    stay NULL, a passage without an id has item_id -1; an empty benchmark gives
    an empty result. Each block of the benchmark is one pass.
    """
    rows = id_and_text(docs)
    out = None
    for block in blocks_of(benchmark):
        scanner = Scanner(block)

        def work(table: pa.Table, scanner: Scanner = scanner) -> dict[str, list] | None:
            best: dict[tuple[int, int], Overlap] = {}
            for found in scanner.overlaps(table.column("text").to_pylist()):
                known = best.get(found[:2])
                if known is None or (-found.words, found.start) < (-known.words, known.start):
                    best[found[:2]] = found
            if not best:
                return None
            ids = table.column("doc_id").to_pylist()
            sizes = np.diff(scanner.block.first).tolist()
            columns = zip(
                *(
                    (ids[o.text], int(scanner.block.items[o.passage]), o.start, o.words, o.agreeing, sizes[o.passage],
                     o.words / sizes[o.passage])
                    for o in best.values()
                ),
                strict=True,
            )
            names = [part.split()[0] for part in SCHEMA.split(", ")]
            return dict(zip(names, map(list, columns), strict=True))

        found = map_rows(rows, SCHEMA, work)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that share no stretch with the benchmark."""
    for block in blocks_of(benchmark):
        scanner = Scanner(block)

        def keep(texts: list[str | None], scanner: Scanner = scanner) -> list[bool]:
            bad = {o.text for o in scanner.overlaps(texts)}
            return [i not in bad for i in range(len(texts))]

        docs = filter_rows(docs, keep)
    return docs
