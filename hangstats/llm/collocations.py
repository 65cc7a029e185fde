"""Collocations: phrases of two to five words that occur together more often than their parts suggest.

Phrases are counted in a trie over word ids whose upper nodes are short word
prefixes and whose containers hold what follows them (up to five words in all):

* a task fills its containers; when it holds :data:`RUN_POSITIONS` places, whole
  subtrees are spilled as sorted runs, equal entries added up, and dealt to
  prefix partitions;
* the container below a prefix of words that are frequent everywhere would be
  hot, so it is burst: its entries go below longer prefixes, and the counts of
  the shorter phrases travel as entries of their own;
* each prefix partition merges its runs and counts the phrases of all lengths
  in one pass over the sorted entries.

A phrase can only be frequent if its words and its pairs of adjacent words are,
so an entry ends where one is not. Frequent words are told by a bitmap of fixed
size, frequent pairs by one made of saturating counters in hash buckets, whose
number is bounded too: what they let through by chance is counted and then found
to be too rare. All counts are exact.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hangstats.llm.common import stage_table
from hangstats.llm.words import mixed

MAX_WORDS = 5
MIN_COUNT = 100
TOP = 2000
#: Places of a run, and about as many of a prefix partition.
RUN_POSITIONS = 1 << 20
#: A word of at least this share of all words is hot, so there are at most this many of them.
HOT_WORDS = 4096
#: Bits of the bitmap of frequent words (2 MB, whatever the corpus).
BITMAP_BITS = 1 << 24
#: Buckets in which pairs are counted: one for so many words, within these bounds (at most 64 MB of a task, 4 MB sent).
WORDS_PER_BUCKET, MIN_BUCKETS, MAX_BUCKETS = 16, 1 << 17, 1 << 25
_RANGE = 1 << 17  # buckets of one row of a sketch
#: Bytes of text that are cut into words together; distinct words counted in a task before they are handed on.
_CUT_BYTES, _COUNTED = 1 << 20, 100_000
_NO_LANGUAGE = "und"

_BREAK = b"\n"
# Breaks become line feeds, tabs spaces, A-Z a-z: then spaces alone separate words.
_FOLD = bytearray(bytes(range(256)).lower())
for _c in b".,;:!?\n\x0b\x0c\r":
    _FOLD[_c] = 10
_FOLD[9] = 32
_FOLD = bytes(_FOLD)


def _tokens(text: str) -> Iterator[list[bytes]]:
    """Words, breaks and empty tokens of a text, piece by piece; a cut at a space does not part words."""
    data = text.encode().translate(_FOLD)
    start = 0
    while start < len(data):
        end = len(data)
        if end - start > _CUT_BYTES:
            end = data.rfind(b" ", start, start + _CUT_BYTES) + 1 or data.find(b" ", start + _CUT_BYTES) + 1 or end
        yield data[start:end].replace(b"\n", b" \n ").split(b" ")
        start = end


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, word, n)``: partial word counts, and with a NULL word those of all words."""
    counted: dict[str, Counter] = {}

    def flush() -> pa.RecordBatch:
        langs, words, numbers = [], [], []
        for lang, counts in counted.items():
            counts.pop(b"", None)
            counts.pop(_BREAK, None)
            langs += [lang] * (len(counts) + 1)
            words += [*counts, None]
            numbers += [*counts.values(), counts.total()]
        counted.clear()
        columns = [pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(numbers, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text")):
            counts = counted.setdefault(lang.as_py(), Counter())
            for tokens in _tokens(text.as_py()):
                counts.update(tokens)
                if len(counts) >= _COUNTED:
                    yield flush()
                    counts = counted.setdefault(lang.as_py(), Counter())
        if sum(map(len, counted.values())) >= _COUNTED:
            yield flush()
    yield flush()


class _Ids(dict):
    """Ids of the words of one language in one run; 0 for a break or a word that is too rare, -1 for no word."""

    def __init__(self, lang: str, frequent: np.ndarray):
        super().__init__({_BREAK: 0, b"": -1})
        self.seed = xxhash.xxh64_intdigest(lang.encode(), 42)
        self.frequent, self.words, self.hashes = frequent, [b""], [0]

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, self.seed)
        found = 0
        if int(self.frequent[(value % BITMAP_BITS) >> 6]) >> (value & 63) & 1:
            found = len(self.words)
            self.words.append(word)
            self.hashes.append(value)
        self[word] = found
        return found


def _sorted_entries(columns: list[np.ndarray], others: list[np.ndarray], words: int) -> tuple[list, list]:
    """Entries in word id order."""
    bits = max(int(words).bit_length(), 1)
    if 3 * bits <= 64:
        shift = np.uint64(bits)
        w = [c.astype(np.uint64) for c in columns]
        order = np.lexsort(((w[3] << shift) | w[4], (((w[0] << shift) | w[1]) << shift) | w[2]))
    else:
        order = np.lexsort(tuple(reversed(columns)))
    return [c[order] for c in columns], [o[order] for o in others]


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """True where a row differs from the one before it."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _added_up(columns: list[np.ndarray], counts: np.ndarray, shortest: np.ndarray, words: int):
    """Equal entries as one, in order."""
    columns, (counts, shortest) = _sorted_entries(columns, [counts, shortest], words)
    starts = np.flatnonzero(_changes([*columns, shortest]))
    return [c[starts] for c in columns], np.add.reduceat(counts, starts) if len(starts) else counts, shortest[starts]


def _pair_buckets(ids: np.ndarray, hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of adjacent words, and the bucket of each pair."""
    places = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    pairs = mixed(hashes[ids[places]] * np.uint64(0x9E3779B97F4A7C15) + hashes[ids[places + 1]])
    return places, (pairs & np.uint64(buckets - 1)).astype(np.int64)


def _linked(ids: np.ndarray, hashes: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Whether the word at a place and the next one may be a frequent pair."""
    linked = np.zeros(len(ids), dtype=bool)
    places, bucket = _pair_buckets(ids, hashes, 8 * len(pairs))
    linked[places] = (pairs[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1
    return linked


def _run(
    ids: np.ndarray, size: int, known: _Ids, pairs: np.ndarray, hot: np.ndarray, partitions: int
) -> Iterator[tuple[int, bytes]]:
    """The subtrees of the first ``size`` places in ``ids`` as sorted runs, one for each prefix partition.

    An entry is up to five word ids (0 after its end), a count, and the length
    of the shortest phrase it counts for.
    """
    hashes = np.array(known.hashes, dtype=np.uint64)
    padded = np.concatenate([ids, np.zeros(MAX_WORDS, ids.dtype)])
    linked = _linked(padded, hashes, pairs)
    places = np.flatnonzero(linked[:size])
    if not len(places):
        return
    columns = [padded[places]]
    for k in range(1, MAX_WORDS):
        columns.append(np.where((columns[-1] > 0) & linked[places + k - 1], padded[places + k], 0))
    ones = np.ones(len(places), np.int64)
    columns, counts, _ = _added_up(columns, ones, np.zeros(len(places), np.int8), len(known.words))

    is_hot = np.isin(hashes, hot)
    is_hot[0] = False
    length = sum((c > 0).astype(np.int8) for c in columns)
    burst = np.full(len(counts), 2, np.int8)  # length of the prefix that an entry lies below
    hot_so_far = is_hot[columns[0]] & is_hot[columns[1]]
    for k in range(2, MAX_WORDS):
        burst += hot_so_far
        hot_so_far &= is_hot[columns[k]]
    parts = [([c[keep] for c in columns], counts[keep], burst[keep], burst[keep]) for keep in (length >= burst,)]
    for k in range(2, MAX_WORDS):  # phrases above a burst container
        above = (burst > k) & (length >= k)
        cut = [c[above] if i < k else np.zeros(int(above.sum()), c.dtype) for i, c in enumerate(columns)]
        short, n, _ = _added_up(cut, counts[above], np.zeros(int(above.sum()), np.int8), len(known.words))
        parts.append((short, n, np.full(len(n), k, np.int8), np.full(len(n), k, np.int8)))
    columns = [np.concatenate([p[0][i] for p in parts]) for i in range(MAX_WORDS)]
    counts, shortest, below = (np.concatenate([p[j] for p in parts]) for j in (1, 2, 3))

    prefix = np.full(len(counts), known.seed, dtype=np.uint64)
    for k in range(MAX_WORDS):
        prefix = np.where(below > k, mixed(prefix ^ hashes[columns[k]]), prefix)
    where = (prefix % np.uint64(partitions)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    where = where[order]
    starts = np.flatnonzero(_changes([where]))
    for start, end in zip(starts, [*starts[1:], len(where)]):
        rows = order[start:end]
        yield int(where[start]), _packed([c[rows] for c in columns], counts[rows], shortest[rows], known.words)


def _packed(columns: list[np.ndarray], counts: np.ndarray, shortest: np.ndarray, words: list[bytes]) -> bytes:
    """A run with a word list of its own, compressed."""
    used = np.unique(np.concatenate(columns))
    used = used[used > 0]
    table = b" ".join([words[i] for i in used])
    kind = np.uint16 if len(used) < 1 << 16 else np.uint32
    body = [np.where(c > 0, np.searchsorted(used, c) + 1, 0).astype(kind).tobytes() for c in columns]
    raw = b"".join([*body, counts.astype(np.int64).tobytes(), shortest.astype(np.int8).tobytes(), table])
    head = struct.pack("<iiq", len(counts), len(used), len(raw))
    return head + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list[bytes]]:
    rows, used, size = struct.unpack_from("<iiq", data)
    raw = pa.decompress(data[16:], decompressed_size=size, codec="zstd", asbytes=True)
    kind = np.dtype(np.uint16 if used < 1 << 16 else np.uint32)
    columns = [np.frombuffer(raw, kind, rows, i * rows * kind.itemsize) for i in range(MAX_WORDS)]
    at = MAX_WORDS * rows * kind.itemsize
    counts, shortest = np.frombuffer(raw, np.int64, rows, at), np.frombuffer(raw, np.int8, rows, at + 8 * rows)
    return columns, counts, shortest, raw[at + 9 * rows :].split(b" ")


def _id_runs(
    batches: Iterator[pa.RecordBatch], frequent: np.ndarray, most: int
) -> Iterator[tuple[str, np.ndarray, int, _Ids]]:
    """Texts as word ids of some ``most`` places: language, ids, how many of them are starts of phrases, the words.

    The last ids of a text that goes on only follow others: they start the next run.
    """
    known: dict[str, _Ids] = {}
    held: dict[str, list[np.ndarray]] = {}

    def spill(within: str | None) -> Iterator[tuple[str, np.ndarray, int, _Ids]]:
        kept: dict[str, list[bytes]] = {}
        for lang, arrays in held.items():
            ids = np.concatenate(arrays)
            size = len(ids)
            if lang == within:
                size = max(size - (MAX_WORDS - 1), 0)
                kept[lang] = [known[lang].words[i] or _BREAK for i in ids[size:]]
            yield lang, ids, size, known[lang]
        known.clear()
        held.clear()
        for lang, words in kept.items():
            known[lang] = _Ids(lang, frequent)
            held[lang] = [np.fromiter(map(known[lang].__getitem__, words), np.int32, len(words))]

    places = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text")):
            lang = lang.as_py()
            for tokens in _tokens(text.as_py()):
                if lang not in known:
                    known[lang], held[lang] = _Ids(lang, frequent), []
                ids = np.fromiter(map(known[lang].__getitem__, tokens), np.int32, len(tokens))
                held[lang].append(ids[ids >= 0])
                places += len(held[lang][-1])
                if places >= most:
                    yield from spill(lang)
                    places = sum(len(a) for arrays in held.values() for a in arrays)
            if lang in held:
                held[lang].append(np.zeros(1, np.int32))
    yield from spill(None)


def _sketch_pairs(frequent: np.ndarray, buckets: int, least: int, most: int):
    """Arrow batches of texts to ``(range, counters)``: pairs of frequent words counted in buckets, up to ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(buckets, dtype=np.uint16)
        for _, ids, size, known in _id_runs(batches, frequent, most):
            places, bucket = _pair_buckets(ids, np.array(known.hashes, dtype=np.uint64), buckets)
            found, n = np.unique(bucket[places < size], return_counts=True)
            counters[found] = np.minimum(counters[found] + n, least)
        for start in range(0, buckets, _RANGE):
            part = counters[start : start + _RANGE]
            if part.any():
                packed = pa.compress(part.tobytes(), codec="zstd", asbytes=True)
                columns = [pa.array([start // _RANGE], pa.int32()), pa.array([packed], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["range", "counters"])

    return run


def _add_sketches(least: int):
    """Sorted ``(range, counters)`` to ``(range, bits)``: which buckets reach ``least``; one range is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bits(at: int, total: np.ndarray) -> pa.RecordBatch:
            packed = np.packbits(total >= least, bitorder="little").tobytes()
            columns = [pa.array([at], pa.int32()), pa.array([packed], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["range", "bits"])

        current, total = None, np.zeros(_RANGE, dtype=np.int64)
        for batch in batches:
            for at, data in zip(batch.column("range").to_pylist(), batch.column("counters")):
                if at != current:
                    if current is not None:
                        yield bits(current, total)
                    current, total = at, np.zeros(_RANGE, dtype=np.int64)
                raw = pa.decompress(data.as_buffer(), decompressed_size=2 * _RANGE, codec="zstd", asbytes=True)
                total += np.frombuffer(raw, np.uint16)
        if current is not None:
            yield bits(current, total)

    return run


def _spill_runs(frequent: np.ndarray, pairs: np.ndarray, hot: np.ndarray, partitions: int, most: int):
    """Arrow batches of texts to ``(partition, lang, run)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, size, known in _id_runs(batches, frequent, most):
            rows = list(_run(ids, size, known, pairs, hot, partitions))
            if rows:
                columns = [
                    pa.array([p for p, _ in rows], pa.int32()),
                    pa.array([lang] * len(rows), pa.string()),
                    pa.array([r for _, r in rows], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["partition", "lang", "run"])

    return run


def _merged(runs: list[bytes], least: int) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """``(k, phrases, counts)`` of the frequent phrases below one prefix partition."""
    ids: dict[bytes, int] = {}
    parts = []
    for data in runs:
        columns, counts, shortest, words = _unpacked(data)
        table = np.array([0, *(ids.setdefault(w, len(ids) + 1) for w in words)], dtype=np.int64)
        parts.append(([table[c] for c in columns], counts, shortest))
    columns = [np.concatenate([p[0][i] for p in parts]) for i in range(MAX_WORDS)]
    counts, shortest = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    columns, (counts, shortest) = _sorted_entries(columns, [counts, shortest], len(ids) + 1)
    listed = [b"", *ids]
    new = np.zeros(len(counts), dtype=bool)
    new[:1] = True
    new[1:] |= columns[0][1:] != columns[0][:-1]
    for k in range(2, MAX_WORDS + 1):
        new[1:] |= columns[k - 1][1:] != columns[k - 1][:-1]
        starts = np.flatnonzero(new)
        sums = np.add.reduceat(np.where((columns[k - 1] > 0) & (shortest <= k), counts, 0), starts)
        found = sums >= least
        rows = starts[found]
        phrases = [b" ".join([listed[c[row]] for c in columns[:k]]).decode() for row in rows]
        yield k, phrases, sums[found]


def _merge_partitions(least: int):
    """Sorted ``(partition, lang, run)`` rows to ``(lang, k, phrase, f)``; one prefix partition is held at a time."""

    def batch(lang: str, runs: list[bytes]) -> Iterator[pa.RecordBatch]:
        for k, phrases, counts in _merged(runs, least):
            columns = [
                pa.array([lang] * len(phrases), pa.string()),
                pa.array([k] * len(phrases), pa.int32()),
                pa.array(phrases, pa.string()),
                pa.array(counts, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "k", "phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, runs = None, []
        for rows in batches:
            for *at, data in zip(*(rows.column(i) for i in range(3))):
                at = (at[0].as_py(), at[1].as_py())
                if at != key:
                    if runs:
                        yield from batch(key[1], runs)
                    key, runs = at, []
                runs.append(data.as_py())
        if runs:
            yield from batch(key[1], runs)

    return run


def _bitmap(words: DataFrame) -> np.ndarray:
    """Bits of the hashes of ``(lang, word)``; its size is fixed."""
    at = F.pmod(F.xxhash64("lang", "word"), F.lit(BITMAP_BITS)).alias("at")
    cells = words.select(at).selectExpr("at div 64 as cell", "shiftleft(1L, cast(at % 64 as int)) as bits")
    bitmap = np.zeros(BITMAP_BITS >> 6, dtype=np.uint64)
    for row in cells.groupBy("cell").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        bitmap[row["cell"]] = row["bits"] & (1 << 64) - 1
    return bitmap


def _frequent_pairs(texts: DataFrame, frequent: np.ndarray, total: int, least: int, run_positions: int) -> np.ndarray:
    """Bits of the buckets whose pairs occur ``least`` times together."""
    wanted = min(max(total // WORDS_PER_BUCKET, MIN_BUCKETS), MAX_BUCKETS)
    buckets = 1 << (wanted - 1).bit_length()
    least = min(least, 0xFFFF)  # (a lower bound only lets more through)
    sketches = texts.mapInArrow(_sketch_pairs(frequent, buckets, least, run_positions), "range int, counters binary")
    ranges = buckets // _RANGE
    bits = (
        sketches.repartition(ranges, "range")
        .sortWithinPartitions("range")
        .mapInArrow(_add_sketches(least), "range int, bits binary")
    )
    pairs = np.zeros((ranges, _RANGE >> 3), dtype=np.uint8)
    for row in bits.toLocalIterator():
        pairs[row["range"]] = np.frombuffer(row["bits"], np.uint8)
    return pairs.reshape(-1)


def frequent_phrases(docs: DataFrame, least: int = MIN_COUNT, run_positions: int = RUN_POSITIONS):
    """``(lang, k, phrase, f)`` of all phrases of 1 to 5 words with ``f >= least``, and ``(lang, n)``: all words."""
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(_NO_LANGUAGE)).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    partial = texts.mapInArrow(_count_words, "lang string, word string, n bigint")
    words = stage_table(
        partial.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("word").isNull() | (F.col("f") >= least)),
        "words",
    )
    totals = words.where(F.col("word").isNull()).select("lang", F.col("f").alias("n"))
    single = words.where(F.col("word").isNotNull())
    total = totals.agg(F.sum("n")).first()[0] or 0
    hot_from = max(total // HOT_WORDS, 1)
    hot = [r[0] for r in single.where(F.col("f") > hot_from).select(F.xxhash64("lang", "word")).collect()]
    hot = np.array([h & (1 << 64) - 1 for h in hot], dtype=np.uint64)
    partitions = max(16, -(-total // run_positions))
    frequent = _bitmap(single)
    pairs = _frequent_pairs(texts, frequent, total, least, run_positions)
    runs = texts.mapInArrow(
        _spill_runs(frequent, pairs, hot, partitions, run_positions), "partition int, lang string, run binary"
    )
    merged = (
        runs.repartition(partitions, "partition")
        .sortWithinPartitions("partition", "lang")
        .mapInArrow(_merge_partitions(least), "lang string, k int, phrase string, f bigint")
    )
    longer = stage_table(merged, "phrases")
    ones = single.select("lang", F.lit(1).alias("k"), F.col("word").alias("phrase"), "f")
    return ones.unionByName(longer), totals


def collocations(
    docs: DataFrame, least: int = MIN_COUNT, top: int = TOP, run_positions: int = RUN_POSITIONS
) -> DataFrame:
    """The ``top`` phrases of each language by how much more often they occur than their parts suggest.

    ``docs`` has ``lang`` and ``text``; ids and further columns are not looked at.
    NULL texts count as empty, a NULL language as ``und``. Every row counts, so
    repeated rows count again. Equal scores rank by count, then by phrase. An
    empty table, or one without a frequent phrase, gives no rows.
    """
    phrases, totals = frequent_phrases(docs, least, run_positions)
    candidates = phrases.where("k >= 2").withColumnRenamed("f", "a")
    # A phrase is dropped for a longer one around it that is as frequent. One with one more word is enough to
    # look at: it lies between the two and its count as well.
    inner = candidates.where("k >= 3").select(
        "lang", "a", F.explode(F.expr("array(substring_index(phrase, ' ', k - 1), substring_index(phrase, ' ', 1 - k))")).alias("phrase")
    )
    around = inner.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = candidates.join(around, ["lang", "phrase"], "left").where("around is null or around < a").drop("around")
    cuts = kept.select("*", F.explode(F.expr("sequence(1, k - 1)")).alias("cut")).selectExpr(
        "lang", "phrase", "a", "cut",
        "substring_index(phrase, ' ', cut) as left_part", "substring_index(phrase, ' ', cut - k) as right_part",
    )
    left = phrases.select("lang", F.col("phrase").alias("left_part"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("right_part"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "left_part"]).join(right, ["lang", "right_part"]).join(totals, "lang")
    exact = lambda name: F.col(name).cast("decimal(19,0)")
    scored = scored.withColumn("above", (exact("a") * exact("n")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)"))
    scored = scored.withColumn("below", exact("l") * exact("r")).withColumn("score", F.expr("above div below"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = lowest.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
