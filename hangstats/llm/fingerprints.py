"""Document fingerprints from content-defined chunks.

A gear hash over the last 16 bytes marks chunk ends wherever the same bytes
stand, so a change moves few chunks. Normalised chunking makes ends rare before
the normal length and frequent after it. A fingerprint lists the digests of a
text's chunks with the bytes that each covers; the part of these bytes whose
chunks another fingerprint also has measures containment.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hangstats.llm.common import id_and_text, stage_table

MIN_CHUNK, NORMAL_CHUNK, MAX_CHUNK = 16, 64, 256
#: Bits of the gear hash that must be zero at an end before the normal length, and after it.
_STRICT, _LOOSE = np.uint16(0b1111_1110_0000_0000), np.uint16(0b1111_0000_0000_0000)
_WINDOW = 16
_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 16, 256, dtype=np.uint16)


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """h[i]: sum of GEAR[byte i - k] << k over the last 16 bytes, by doubling the window."""
    h = _GEAR[raw]
    width = 1
    while width < _WINDOW:
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint16(width)
        h, width = wider, 2 * width
    return h


def chunk_ends(data: bytes, known: list[int] | None = None) -> list[int]:
    """End offsets of the chunks of ``data``, after those in ``known``, which hold already."""
    ends = list(known or ())
    size, start = len(data), ends[-1] if ends else 0
    skipped = max(0, start - _WINDOW)
    h = gear_hashes(np.frombuffer(data, dtype=np.uint8)[skipped:])
    loose_at = np.flatnonzero((h & _LOOSE) == 0)
    strict = (loose_at[(h[loose_at] & _STRICT) == 0] + (skipped + 1)).tolist()
    loose = (loose_at + (skipped + 1)).tolist()
    while start < size:
        normal, last = start + NORMAL_CHUNK, min(start + MAX_CHUNK, size)
        i = bisect_left(strict, start + MIN_CHUNK)
        if i < len(strict) and strict[i] < normal:
            end = strict[i]
        else:
            i = bisect_left(loose, normal)
            end = loose[i] if i < len(loose) else last
        start = min(end, last)
        ends.append(start)
    return ends


class Chunks:
    """Chunk digests of a text with the bytes they cover."""

    def __init__(self, data: bytes, before: Chunks | None = None, same: int = 0):
        """``before``: chunks of a text with the same first ``same`` bytes; those well inside are taken over."""
        kept = 0
        if before is not None:
            # An end at the limit of a chunk or before byte ``same`` depends on bytes up to itself only.
            kept = bisect_left(before.ends, same + 1)
            while kept and before.ends[kept - 1] == len(before.data) != len(data):
                kept -= 1
        self.data = data
        self.ends = chunk_ends(data, before.ends[:kept] if before is not None else None)
        digest = xxhash.xxh3_64_hexdigest
        starts = [self.ends[kept - 1] if kept else 0, *self.ends[kept:]]
        self.digests = (before.digests[:kept] if before is not None else []) + [
            digest(data[a:b])[:12] for a, b in pairwise(starts)
        ]

    def weights(self) -> dict[str, int]:
        out: dict[str, int] = {}
        start = 0
        for digest, end in zip(self.digests, self.ends, strict=True):
            out[digest] = out.get(digest, 0) + end - start
            start = end
        return out


def containment(own: dict[str, int], other: dict[str, int]) -> float:
    """The part of the first text's bytes whose chunks the second has too; two empty texts are alike."""
    total = sum(own.values())
    if not total:
        return 1.0 if not other else 0.0
    return sum(min(n, other[d]) for d, n in own.items() if d in other) / total


def fingerprint(weights: dict[str, int]) -> str:
    return ",".join([f"{digest}{n:x}" for digest, n in sorted(weights.items())])


def parse(text: str) -> dict[str, int]:
    """The weights of a fingerprint."""
    return {part[:12]: int(part[12:], 16) for part in text.split(",") if part}


class _Print:
    """A text with its chunks."""

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.chunks = Chunks(text.encode())
        self.weights = self.chunks.weights()

    def against(self, following: _Print) -> tuple:
        """The row of this text, edited with the start of the following one."""
        keep = len(self.text) - len(self.text) // 3
        head = self.text[:keep]
        edited = head + following.text[: len(self.text) // 3]
        if edited == self.text:
            weights = self.weights
        else:
            weights = Chunks(edited.encode(), self.chunks, len(head.encode())).weights()
        return (
            self.doc_id,
            len(self.text),
            hashlib.sha256(edited.encode()).hexdigest(),
            fingerprint(self.weights),
            fingerprint(weights),
            containment(self.weights, weights),
            containment(self.weights, following.weights),
        )


SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
_ROLES = SCHEMA + ", role string, part int, text string"
_OUT_ROWS = 256


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprint of every whole text and of the text edited with the next document's start.

    The next document is the one after it by descending id, NULL ids last, equal
    ids by text hash; after the last comes the first, so a single document is
    its own next one. NULL texts count as empty. A row for each row of ``docs``.

    Documents are range-partitioned by id and sorted within the partitions, so
    each text travels once and its next one follows it. Only the first and the
    last text of each partition are paired in a second, small step.
    """
    rows = id_and_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    target = docs.sparkSession.createDataFrame([], _ROLES).schema
    final = docs.sparkSession.createDataFrame([], SCHEMA).schema

    def batch_of(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) if found else [[] for _ in schema]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
        )

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, part = to_arrow_schema(target), TaskContext.get().partitionId()
        blank = (None,) * 6
        last, found = None, []
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                this = _Print(doc_id, text)
                if last is None:
                    found.append((doc_id, *blank, "head", part, text))
                else:
                    found.append((*last.against(this), "done", None, None))
                last = this
                if len(found) >= _OUT_ROWS:
                    yield batch_of(found, schema)
                    found = []
        if last is not None:
            found.append((last.doc_id, *blank, "tail", part, last.text))
        yield batch_of(found, schema)

    table = stage_table(ranged.mapInArrow(neighbours, target), "fingerprints")
    done = table.filter("role = 'done'").select(*final.names)
    # One number for each partition of the shuffle.
    parts = [row["part"] for row in table.filter("role = 'head'").select("part").orderBy("part").collect()]
    if not parts:
        return done
    links = docs.sparkSession.createDataFrame(
        list(zip(parts, [*parts[1:], parts[0]], strict=True)), "part int, next_part int"
    )
    tails = table.filter("role = 'tail'").select("doc_id", "text", "part")
    heads = table.filter("role = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    ends = tails.join(links, "part").join(heads, "next_part").select("doc_id", "text", "next_text")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(final)
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            found = [_Print(doc_id, text).against(_Print(None, following)) for doc_id, text, following in rows]
            yield batch_of(found, schema)

    return done.unionByName(ends.mapInArrow(pairs, final))
