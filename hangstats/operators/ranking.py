"""Counting, shares, top lists and rank ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_counts(rows: DataFrame, *keys: str, weight: str = "weight") -> DataFrame:
    """``n`` per key: map-side partial sums, so a hot key is no hot task."""
    return rows.groupBy(*keys).agg(F.sum(weight).alias("n"))


def total(counts: DataFrame, count: str = "n") -> Column:
    """The sum of all counts as a scalar subquery."""
    return counts.agg(F.sum(count).alias("total")).scalar()


def top_k(counts: DataFrame, k: int, *ties: str, count: str = "n") -> DataFrame:
    """The ``k`` largest counts; ties are broken by the given columns."""
    return counts.orderBy(F.col(count).desc(), *ties).limit(k)


def rank_range(
    counts: DataFrame, skip: int, last: int, *ties: str, count: str = "n"
) -> DataFrame:
    """Ranks ``skip + 1`` to ``last`` by count.

    The global numbering only sees the ``last`` rows that survive the limit.
    """
    order = Window.orderBy(F.col(count).desc(), *ties)
    ranked = top_k(counts, last, *ties, count=count).select(
        F.row_number().over(order).alias("rank"), *counts.columns
    )
    return ranked.where(F.col("rank") > skip)


def top_k_per_group(
    counts: DataFrame, by: str, k: int, *ties: str, count: str = "n", rank: str = "rank"
) -> DataFrame:
    """The ``k`` largest counts of each group.

    Catalyst cuts each task's input to ``k`` rows per group before the shuffle.
    """
    order = Window.partitionBy(by).orderBy(F.col(count).desc(), *ties)
    return counts.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def percent(part: Column | str, whole: Column | str) -> Column:
    """``100 * part / whole``, NULL when the whole is 0."""
    column = F.col(part) if isinstance(part, str) else part
    whole = F.col(whole) if isinstance(whole, str) else whole
    return F.try_divide(F.lit(100.0) * column, whole.cast("double"))
