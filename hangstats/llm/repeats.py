"""Which windows of fixed length occur more than once, over all texts, without a row for each window.

A text is a sequence of units (bytes or words); a window is ``size`` consecutive
units of one text. A locally consistent parse gives symbols: equal contents give
equal symbols, as far as the units that decide a symbol (its context) lie
inside. Each window is given to the smallest of the symbols whose context it
holds, so equal windows go to equal symbols at the same offset, and the windows
of one symbol are a run of consecutive starts.

Runs are settled in three rounds, each finer than the last:

1. whole runs, keyed by the symbol;
2. blocks of a few window starts, aligned to the symbol, keyed by what all
   windows of the block share;
3. single windows.

In each round an entry has a key (its core, part of all its windows) and a
digest of all it covers. A core seen once: none of the windows occurs again. A
digest seen twice: all of them do. Only what lies between goes to the next
round, with one representative of each repeated digest next to it. So the work
after round 1 follows the number of ends of repeats, not their length.

Counting is partial before each shuffle, and no group is ever gathered: entries
meet their counts in joins of two plain shuffles, which Spark splits when one
key is hot.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hangstats.llm.common import encoded, id_and_text, map_rows, stage_table, staged


class Symbols(NamedTuple):
    """Symbols of a pack of texts, in order: name, rank (smaller is preferred), place, and context [low, high)."""

    names: np.ndarray
    ranks: np.ndarray
    places: np.ndarray
    low: np.ndarray
    high: np.ndarray


class Pack(NamedTuple):
    """Units of some texts: ``data[begin[i] : end[j]]`` holds units i to j; text k has units first[k] to first[k + 1].

    ``spare``: further symbols, for windows that hold none of ``symbols``.
    """

    data: bytes
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    symbols: Symbols | None
    spare: Callable[[], Symbols] | None


class Runs(NamedTuple):
    """Window starts first to last (inclusive) and the place of their symbol; all are unit numbers in the pack."""

    first: np.ndarray
    last: np.ndarray
    place: np.ndarray
    name: np.ndarray


Parse = Callable[[list[str | None], bool], Pack]


def _smallest(ranks: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Index of the leftmost smallest rank in each [begin, end), -1 where that is empty."""
    width = end - begin
    out = np.full(len(begin), -1, dtype=np.int64)
    table, reach = np.arange(len(ranks)), 1
    while True:
        here = np.flatnonzero((width >= reach) & (width < 2 * reach))
        if len(here):
            a, b = table[begin[here]], table[end[here] - reach]
            out[here] = np.where(ranks[b] < ranks[a], b, a)
        if not (width >= 2 * reach).any():
            return out
        a, b = table[:-reach], table[reach:]
        table = np.where(ranks[b] < ranks[a], b, a)
        reach *= 2


def runs_of(symbols: Symbols, spare: Callable[[], Symbols], first: np.ndarray, size: int) -> Runs:
    """Every window of every text, by the symbol it is given to; place -1: it holds no symbol's context."""
    valid_from, valid_to = first[:-1], first[1:] - size + 1
    long = valid_to > valid_from
    valid_from, valid_to = valid_from[long], valid_to[long]
    # All four parts are sorted, which a stable sort makes use of.
    cuts = np.sort(np.concatenate([symbols.low + 1, symbols.high - size, valid_from, valid_to]), kind="stable")
    cuts = cuts[np.append(True, cuts[1:] != cuts[:-1])] if len(cuts) else cuts
    owner = np.searchsorted(valid_from, cuts, side="right") - 1
    if not len(valid_from):
        empty = np.empty(0, np.int64)
        return Runs(empty, empty, empty, np.empty(0, np.uint64))
    inside = (owner >= 0) & (cuts < valid_to[owner])
    following = np.append(cuts[1:], cuts[-1])
    start, stop = cuts[inside], np.minimum(following, valid_to[owner])[inside]
    begin = np.searchsorted(symbols.low, start)
    chosen = _smallest(symbols.ranks, begin, np.maximum(begin, np.searchsorted(symbols.high, start + size, side="right")))
    new = np.ones(len(start), dtype=bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (start[1:] != stop[:-1])
    heads = np.flatnonzero(new)
    chosen, last = chosen[heads], stop[np.append(heads[1:], len(start)) - 1] - 1
    start = start[heads]
    alone = chosen < 0
    own = Runs(
        start[~alone], last[~alone], symbols.places[chosen[~alone]], symbols.names[chosen[~alone]]
    )
    if not alone.any():
        return own
    counts = (last - start + 1)[alone]
    single = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(start[alone], counts)
    others = _by_spare(single, spare(), size)
    return Runs(*(np.concatenate(pair) for pair in zip(own, others, strict=True)))


def _by_spare(windows: np.ndarray, spare: Symbols, size: int) -> Runs:
    """Runs of single windows by their spare symbol; a window without one stands alone, place -1."""
    begin = np.searchsorted(spare.low, windows)
    end = np.maximum(begin, np.searchsorted(spare.high, windows + size, side="right"))
    chosen = _smallest(spare.ranks, begin, end)
    new = np.ones(len(windows), dtype=bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (windows[1:] != windows[:-1] + 1) | (chosen[1:] < 0)
    heads = np.flatnonzero(new)
    chosen, last = chosen[heads], windows[np.append(heads[1:], len(windows)) - 1]
    none = chosen < 0
    if not len(spare.names):
        return Runs(windows[heads], last, chosen, chosen.astype(np.uint64))
    return Runs(
        windows[heads], last, np.where(none, -1, spare.places[chosen]), np.where(none, np.uint64(0), spare.names[chosen])
    )


def _digests(data: bytes, begin: list[int], end: list[int], seeds: list[int]) -> np.ndarray:
    """128-bit digests of parts of ``data`` as two columns."""
    digest = xxhash.xxh3_128_digest
    found = b"".join([digest(data[a:b], s) for a, b, s in zip(begin, end, seeds, strict=True)])
    return np.frombuffer(found, dtype=np.int64).reshape(-1, 2)


_ENTRY = "doc_id bigint, th bigint, s_lo int, s_hi int, t int, core bigint, c1 bigint, c2 bigint"
_NAMES = [part.split()[0] for part in _ENTRY.split(", ")]


def _whole_runs(rows: DataFrame, parse: Parse, size: int) -> DataFrame:
    """Round 1. A window without a symbol has no place: its own start serves as one, and its digest as its core."""

    def work(table: pa.Table) -> dict[str, list] | None:
        pack = parse(table.column("text").to_pylist(), True)
        runs = runs_of(pack.symbols, pack.spare, pack.first, size)
        if not len(runs.first):
            return None
        text = np.searchsorted(pack.first, runs.first, side="right") - 1
        base = pack.first[text]
        place = np.where(runs.place < 0, runs.first, runs.place)
        begin, end = pack.begin[runs.first].tolist(), pack.end[runs.last + size - 1].tolist()
        seeds = ((place - runs.first) << 32) + (runs.last - runs.first)
        c1, c2 = _digests(pack.data, begin, end, seeds.tolist()).T
        ids, hashes = table.column("doc_id").to_pylist(), table.column("th").to_numpy()
        columns = (
            [ids[i] for i in text.tolist()], hashes[text], runs.first - base, runs.last - base, place - base,
            np.where(runs.place < 0, c1, runs.name.view(np.int64)), c1, c2,
        )
        return dict(zip(_NAMES, columns, strict=True))

    return map_rows(rows, _ENTRY, work)


def _blocks(rows: DataFrame, parse: Parse, size: int, block: int) -> DataFrame:
    """Rounds 2 and 3: the windows of ``runs`` in blocks of ``block`` starts, counted back from the symbol.

    A block takes in its other windows in the text too, so that blocks of
    different texts cover the same offsets.
    """

    def work(table: pa.Table) -> dict[str, list] | None:
        pack = parse(table.column("text").to_pylist(), False)
        listed = table.column("runs").combine_chunks()
        counts, runs = pc.list_value_length(listed).to_numpy(), listed.flatten()
        text = np.repeat(np.arange(len(counts)), counts)
        s_lo, s_hi, t = (runs.field(name).to_numpy().astype(np.int64) for name in ("s_lo", "s_hi", "t"))
        b_lo, b_hi = (t - s_hi) // block, (t - s_lo) // block
        many = b_hi - b_lo + 1
        b = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(b_lo, many)
        wanted = np.stack([np.repeat(text, many), np.repeat(t, many), b], axis=1)
        wanted = wanted[np.lexsort(wanted.T[::-1])]
        text, t, b = wanted[np.append(True, (wanted[1:] != wanted[:-1]).any(axis=1))].T
        base, n_windows = pack.first[text], (np.diff(pack.first) - size + 1)[text]
        low, high = t - b * block - block + 1, t - b * block
        s_lo, s_hi = np.maximum(low, 0), np.minimum(high, n_windows - 1)
        begin, end = pack.begin[base + s_lo].tolist(), pack.end[base + s_hi + size - 1].tolist()
        c1, c2 = _digests(pack.data, begin, end, (((t - s_lo) << 32) + (s_hi - s_lo)).tolist()).T
        core = c1
        if block > 1:
            begin, end = pack.begin[base + high].tolist(), pack.end[base + low + size - 1].tolist()
            core = _digests(pack.data, begin, end, (b & 0xFFFFFFFF).tolist())[:, 0]
        ids, hashes = table.column("doc_id").to_pylist(), table.column("th").to_numpy()
        columns = ([ids[i] for i in text.tolist()], hashes[text], s_lo, s_hi, t, core, c1, c2)
        return dict(zip(_NAMES, columns, strict=True))

    return map_rows(rows, _ENTRY, work)


class Settled(NamedTuple):
    """Entries all of whose windows occur again, entries that only a finer round can settle, and what deletes them."""

    certain: DataFrame
    open: DataFrame
    drop_certain: Callable[[], None]
    drop_kept: Callable[[], None]


def _settled(raw: DataFrame, label: str) -> Settled:
    """One round over its entries; they are deleted when it is done."""
    entries, drop_entries = staged(raw, label)
    key, row = ["core", "c1", "c2"], ["doc_id", "th", "s_lo", "s_hi", "t"]
    place = F.xxhash64("doc_id", "th", "s_lo", "t")  # tells the entries of a class apart
    classes = entries.groupBy(key).agg(
        F.count("*").alias("n"), F.min(place).alias("least"), *(F.min(c).alias(c) for c in row)
    )
    cores = classes.groupBy("core").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).filter("total > 1")
    kept, drop_kept = staged(
        classes.join(cores.select("core", "kinds"), "core").filter("n > 1 or kinds > 1"), f"{label}-kept"
    )
    twice = kept.filter("n > 1").select(*key, "least", (F.col("kinds") > 1).alias("open"))
    shown = (F.col("open") & (place == F.col("least"))).alias("shown")
    certain, drop_certain = staged(entries.join(twice, key).select(*row, shown), f"{label}-certain")
    drop_entries()
    # The only row of a class is its minimum in every column.
    open_ = kept.filter("n = 1").select(*row).unionByName(certain.filter("shown").select(*row))
    return Settled(certain.select(*row), open_, drop_certain, drop_kept)


def _with_runs(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """Texts that have runs to look at, each with its own.

    Equal rows have equal runs, which are listed once, so the list of a text is
    bounded by its length: three numbers for a window start at most.
    """
    listed = runs.groupBy("doc_id", "th").agg(F.collect_set(F.struct("s_lo", "s_hi", "t")).alias("runs"))
    listed = listed.select(F.col("doc_id").alias("run_id"), F.col("th").alias("run_th"), "runs")
    same = texts["doc_id"].eqNullSafe(listed["run_id"]) & (texts["th"] == listed["run_th"])
    return texts.join(listed, same).select("doc_id", "th", "text", "runs")


def repeated_windows(docs: DataFrame, parse: Parse, size: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The texts (``doc_id, text, th``) and, for those that have some, the list of their repeated windows.

    The list (``doc_id, th, windows``) has each window once, overlaps included;
    equal rows share one list. It is the only intermediate table that is left.

    NULL and empty texts have no windows. A text that stands in several rows is
    repeated as a whole. Rows are told apart by id and text hash, so equal or
    NULL ids do no harm.
    """
    texts = id_and_text(docs).withColumn("th", F.xxhash64("text"))
    first = _settled(_whole_runs(texts, parse, size), "runs")
    some, drop_some = staged(_with_runs(texts, first.open), "texts")
    first.drop_kept()
    second = _settled(_blocks(some, parse, size, block), "blocks")
    single, drop_single = staged(_blocks(_with_runs(some.drop("runs"), second.open), parse, size, 1), "windows")
    second.drop_kept()
    drop_some()
    twice = single.groupBy("c1", "c2").agg(F.count("*").alias("n")).filter("n > 1").select("c1", "c2")
    columns = ["doc_id", "th", "s_lo", "s_hi"]
    third = single.join(twice, ["c1", "c2"])
    found = first.certain.select(columns).unionByName(second.certain.select(columns)).unionByName(third.select(columns))
    # Equal rows have equal windows, which are listed once.
    listed = stage_table(
        found.groupBy("doc_id", "th").agg(F.collect_set(F.struct("s_lo", "s_hi")).alias("windows")), "cuts"
    )
    for drop in (first.drop_certain, second.drop_certain, drop_single):
        drop()
    return texts, listed


def spans_of(low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
    """Maximal ranges that the ranges [low, high) cover; ranges that touch make one."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order]) if len(low) else high
    first = np.flatnonzero(np.append(True, low[1:] > high[:-1])) if len(low) else np.empty(0, np.int64)
    last = np.append(first[1:], len(low)) - 1
    return list(zip(low[first].tolist(), high[last].tolist() if len(low) else [], strict=True))


def with_windows(texts: DataFrame, listed: DataFrame) -> DataFrame:
    """Each row of the texts with the windows of its text, NULL if it has none."""
    listed = listed.select(F.col("doc_id").alias("cut_id"), F.col("th").alias("cut_th"), "windows")
    same = texts["doc_id"].eqNullSafe(listed["cut_id"]) & (texts["th"] == listed["cut_th"])
    return texts.join(listed, same, "left").select("doc_id", "text", "windows")


def without_repeats(
    texts: DataFrame,
    listed: DataFrame,
    size: int,
    schema: str,
    cut: Callable[[int | None, bytes, list[tuple[int, int]]], tuple],
) -> DataFrame:
    """``cut(doc_id, text, spans)`` for each text; each text travels once, to its own windows."""
    rows = with_windows(texts, listed)
    names = [part.split()[0] for part in schema.split(", ")]

    def work(table: pa.Table) -> dict[str, list]:
        ids = table.column("doc_id").to_pylist()
        listed = table.column("windows").combine_chunks()
        counts, windows = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(), listed.flatten()
        bounds = np.concatenate([[0], np.cumsum(counts)])
        low, high = (windows.field(name).to_numpy().astype(np.int64) for name in ("s_lo", "s_hi"))
        found = []
        for i, text in enumerate(encoded(table.column("text").to_pylist())):
            own = slice(bounds[i], bounds[i + 1])
            found.append(cut(ids[i], text, spans_of(low[own], high[own] + size) if counts[i] else []))
        return dict(zip(names, map(list, zip(*found, strict=True)), strict=True))

    return map_rows(rows, schema, work)
