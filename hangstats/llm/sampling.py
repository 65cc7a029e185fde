"""Bounded samples of labelled or unlabelled documents to fit a classifier on."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(by))


def held_out(doc_id: Column, by: int, at: int) -> Column:
    """Rows whose labels are not learned from; a NULL id has no labels and is not held out."""
    return F.coalesce(remainder(doc_id, by) == at, F.lit(False))


def sample_ids(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` distinct rows, chosen by a hash of their id: the same for any layout of the table.

    The number of distinct ids, estimated to some two hundredths, tells below
    which hash a few more lie than are wanted; only those are shuffled and
    sorted, however many partitions the table has. Equal rows count once, so a
    row that stands for a third of the table takes one place; a table of fewer
    rows is taken whole.
    """
    place = F.xxhash64(F.col("doc_id"), F.lit(17))
    known = rows.agg(F.approx_count_distinct("doc_id", 0.02)).first()[0]
    share = (1.1 * most + 8 * math.sqrt(most) + 64) / max(known, 1)
    if share < 1:
        rows = rows.filter(place <= F.lit(int(share * 2**64) - 2**63))
    return rows.distinct().orderBy(place, *rows.columns).limit(most)


def texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of a bounded sample, each with a text: of an id that stands in several documents, the least.

    So there are at most as many rows as the sample has. The sample, not the
    texts, goes to all tasks; of equal ids each task passes on one text.
    """
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy(*chosen.columns).agg(F.min("text").alias("text"))
