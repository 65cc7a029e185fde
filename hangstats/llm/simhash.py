"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints of 64 bits in six blocks: two that differ in at most three bits
agree in three blocks at least. Each distinct fingerprint is keyed by every
choice of three blocks, fingerprints with a common key are compared bit by bit,
and links within the distance are joined to components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hangstats.llm.common import encoded, id_and_text, map_rows, stage_table
from hangstats.llm.components import components

SHINGLE, DISTANCE, SEED = 3, 3, 42
BLOCKS = (11, 11, 11, 11, 10, 10)
#: A larger bucket is compared in tasks for each pair of its parts, of about so many fingerprints each.
PART = 4096


def fingerprint_of(text: bytes) -> int:
    """Bits set in over half of the shingles' hashes; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=False)]
    return majority(np.array(hashes, dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(counts * 2 > len(hashes)).tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``th`` (text hash), ``fp`` (the 64 bits as a signed number) of each row; NULL texts count as empty."""

    def work(table: pa.Table) -> dict[str, list]:
        found = np.array([fingerprint_of(t) for t in encoded(table.column("text").to_pylist())], dtype=np.uint64)
        ids, hashes = table.column("doc_id").to_pylist(), table.column("th").to_numpy()
        return {"doc_id": ids, "th": hashes, "fp": found.view(np.int64)}

    rows = id_and_text(docs).withColumn("th", F.xxhash64("text"))
    return map_rows(rows, "doc_id bigint, th bigint, fp bigint", work)


def _masks() -> list[int]:
    ends = np.cumsum(BLOCKS).tolist()
    blocks = [((1 << size) - 1) << (end - size) for size, end in zip(BLOCKS, ends, strict=True)]
    masks = [sum(chosen) for chosen in combinations(blocks, len(BLOCKS) - DISTANCE)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def linked(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is within the distance: to the smallest fingerprint of each local component."""
    fps = np.unique(fps)
    bits, label = fps.view(np.uint64), np.arange(len(fps))
    while True:
        before = label.copy()
        for i in range(0, len(fps), 512):
            near = np.bitwise_count(bits[i : i + 512, None] ^ bits[None, :]) <= DISTANCE
            label[i : i + 512] = np.where(near, label[None, :], len(fps)).min(axis=1)
        label = label[label]
        if (label == before).all():
            break
    other = np.flatnonzero(label != np.arange(len(fps)))
    return fps[label[other]], fps[other]


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each bucket; rows come sorted by bucket, the last one of a batch waits for the next."""
    names = ("a", "b")
    rest: np.ndarray | None = None

    def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero((rows[1:, :-1] != rows[:-1, :-1]).any(axis=1)) + 1
        found = [linked(part) for part in np.split(rows[:, -1], cuts) if len(part) > 1]
        if found:
            columns = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        rows = np.column_stack([c.to_numpy() for c in batch.columns])
        if not len(rows):
            continue
        rows = rows if rest is None else np.concatenate([rest, rows])
        last = (rows[:, :-1] == rows[-1, :-1]).all(axis=1)
        start = len(rows) - int(np.argmin(last[::-1])) if not last.all() else 0
        rest = rows[start:]
        if start:
            yield from links(rows[:start])
    if rest is not None:
        yield from links(rest)


def links_between(distinct: DataFrame) -> DataFrame:
    """Links ``a`` < ``b`` that join all of ``fp`` (distinct) within the distance; not every pair has one."""
    keys = F.array(*(F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(_masks())))
    keyed = distinct.select("fp", F.explode(keys).alias("key")).select("fp", "key.k", "key.v")
    shared = stage_table(keyed.groupBy("k", "v").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    parts = F.ceil(F.col("n") / PART).cast("int")
    rows = keyed.join(shared, ["k", "v"]).withColumn("parts", parts)
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    rows = rows.select(
        F.col("k").cast("long"), "v", F.least("own", "other").cast("long").alias("i"),
        F.greatest("own", "other").cast("long").alias("j"), "fp",
    )
    bucket = ["k", "v", "i", "j"]
    sorted_rows = rows.repartition(*bucket).sortWithinPartitions(*bucket)
    return sorted_rows.mapInArrow(_bucket_links, "a bigint, b bigint").distinct()


def _grouped(docs: DataFrame) -> DataFrame:
    """``doc_id, th, fp, root, component_id`` for each row of ``docs``."""
    found = stage_table(fingerprints(docs), "simhash")
    distinct = stage_table(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links_between(distinct.select("fp")))
    labelled = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = stage_table(labelled.join(smallest, "root").select("fp", "root", "component_id"), "labels")
    return found.join(labels, "fp")


def group_documents(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``: the smallest id reachable over links.

    Texts without words share the fingerprint zero and link like any other. A
    row for each row of ``docs``; a NULL id is never the smallest, and is the
    component's id only where no document of it has another. Only distinct
    fingerprints are compared, so copies add no links.
    """
    return _grouped(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns: of each component the one with the smallest id, then text hash.

    A row with a NULL id stays only where its component has no other ids; of
    repeated rows one stays.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("first")
    kept = _grouped(docs).groupBy("root").agg(first).select(
        F.col("first.doc_id").alias("kept_id"), F.col("first.th").alias("kept_th")
    )
    text_hash, rank = "_th", "_rank"
    while {text_hash, rank} & set(docs.columns):
        text_hash, rank = text_hash + "_", rank + "_"
    rows = docs.withColumn(text_hash, F.xxhash64(F.col("text").cast("string")))
    same = rows["doc_id"].cast("long").eqNullSafe(kept["kept_id"]) & (rows[text_hash] == kept["kept_th"])
    repeated = Window.partitionBy("doc_id", text_hash).orderBy(text_hash)
    rows = rows.join(kept, same, "left_semi").withColumn(rank, F.row_number().over(repeated))
    return rows.filter(F.col(rank) == 1).select(*docs.columns)
