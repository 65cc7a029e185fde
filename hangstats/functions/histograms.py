"""Column functions on duration histograms.

A histogram is ``array<struct<label string, count bigint>>``: the label is the
lower edge of the bin in ms, the upper edge is twice as high. Counts beyond 64
bits are in an array of their own, ``array<struct<label string, count
decimal(38,0)>>``, which is NULL for almost every hang.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HISTOGRAM = "array<struct<label:string,count:bigint>>"
LARGE_COUNTS = "array<struct<label:string,count:decimal(38,0)>>"


def bin_edge(label: Column | str) -> Column:
    """Lower edge as BIGINT, NULL for a label that is no whole number."""
    column = F.col(label) if isinstance(label, str) else label
    return column.try_cast("bigint")


def bin_midpoint(edge: Column | str) -> Column:
    """Middle between a lower edge and twice that edge."""
    column = F.col(edge) if isinstance(edge, str) else edge
    return F.lit(1.5) * column.cast("double")


def weight_of(count: Column) -> Column:
    """How many hangs a count stands for; NULL unless it is positive."""
    return F.when(count > 0, count)


def hang_weight(bins: Column | str) -> Column:
    """Number of hangs in a histogram, whatever its labels say; a sum beyond BIGINT stops the job."""
    return F.aggregate(
        bins,
        F.lit(0).cast("bigint"),
        lambda total, entry: total + F.coalesce(weight_of(entry["count"]), F.lit(0)),
    )


def count_total(bins: Column | str) -> Column:
    """Plain sum of all integer counts, as DOUBLE so that it cannot overflow."""
    return F.aggregate(
        bins,
        F.lit(0.0),
        lambda total, entry: total + entry["count"].cast("double"),
    )


def hang_moments(bins: Column | str) -> Column:
    """Count, sum of durations and sum of squared durations of one histogram."""
    zero = F.struct(
        F.lit(0).cast("bigint").alias("n"),
        F.lit(0.0).alias("sum_t"),
        F.lit(0.0).alias("sum_t2"),
    )
    weighted = F.transform(
        bins,
        lambda entry: F.struct(
            weight_of(entry["count"]).alias("weight"),
            bin_midpoint(bin_edge(entry["label"])).alias("mid"),
        ),
    )
    usable = F.filter(weighted, lambda e: e["weight"].isNotNull() & e["mid"].isNotNull())
    return F.aggregate(
        usable,
        zero,
        lambda acc, e: F.struct(
            (acc["n"] + e["weight"]).alias("n"),
            (acc["sum_t"] + e["weight"] * e["mid"]).alias("sum_t"),
            (acc["sum_t2"] + e["weight"] * e["mid"] * e["mid"]).alias("sum_t2"),
        ),
    )
