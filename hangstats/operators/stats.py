"""Order statistics and weighted moments."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(names: Sequence[str], other: Callable[[str], str]) -> Column:
    """Null-safe equality, from which no filter is inferred: a filter on one use of a shuffle would make it two."""
    return reduce(lambda a, b: a & b, [F.col(name).eqNullSafe(F.col(other(name))) for name in names])


def value_at_rank(
    rows: DataFrame,
    by: Sequence[str],
    keys: Sequence[Column],
    rank: Callable[[Column], Column],
    weight: Column | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Exact order statistic per group, for keys of any type Spark can sort, without a group in one task.

    Weights are summed once by group and key. The sums are dealt to ``ranges``
    ranges of (group, key), by default as many as the session shuffles to. A
    small table of the weight of each group in each range tells in which range
    the wanted rank lies; only there are running sums over single keys formed.
    All uses read the same shuffle, so ``rows`` is read once.

    ``rank`` maps the group's total weight to the 0-based rank. Returns ``by``,
    the keys as ``key_0`` ..., and the total weight ``n``. A group whose rank
    lies outside its weight gives no row.
    """
    names = [f"key_{i}" for i in range(len(keys))]
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weight = F.lit(1) if weight is None else weight
    sums = (
        rows.select(*by, *[k.alias(n) for k, n in zip(keys, names)], weight.cast("bigint").alias("_w"))
        .groupBy(*by, *names)
        .agg(F.sum("_w").alias("_w"))
    )
    # A given number of ranges is not merged by adaptive execution, so the number of a range means the same in each use.
    ranged = sums.repartitionByRange(ranges, *by, *names).withColumn("_range", F.spark_partition_id())
    group = Window.partitionBy(*by)
    up_to_here = (Window.unboundedPreceding, Window.currentRow)

    def holding_the_rank(frame: DataFrame, order: Sequence[str]) -> DataFrame:
        upto = F.sum("_w").over(group.orderBy(*order).rowsBetween(*up_to_here))
        within = (F.col("_rank") >= 0) & (F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_w") <= F.col("_rank"))
        return frame.withColumn("_upto", upto).where(within)

    weights = ranged.groupBy(*by, "_range").agg(F.sum("_w").alias("_w"))
    weights = weights.withColumn("n", F.sum("_w").over(group)).withColumn("_rank", rank(F.col("n")).cast("bigint"))
    holders = holding_the_rank(weights, ["_range"]).select(
        *[F.col(name).alias(f"_{name}") for name in by],
        F.col("_range").alias("__range"),
        F.col("_w").alias("_range_weight"),
        "n",
        (F.col("_rank") - (F.col("_upto") - F.col("_w"))).alias("_rank"),
    )
    inside = ranged.join(holders, _same([*by, "_range"], lambda name: f"_{name}"))
    # Had a use been shuffled anew with other bounds, its weight would differ; that must not pass unseen.
    seen = F.sum("_w").over(group)
    wrong = F.raise_error(F.lit("ranges differ between two uses of one shuffle")).cast("boolean")
    inside = inside.withColumn("_seen", seen).where(F.when(F.col("_seen") == F.col("_range_weight"), True).otherwise(wrong))
    return holding_the_rank(inside, names).select(*by, *names, "n")


def upper_median(
    rows: DataFrame,
    by: Sequence[str],
    value: str,
    weight: str | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Element ``n div 2`` (0-based) of each group's sorted values, and ``n``."""
    usable = rows.where(F.col(value).isNotNull())
    if weight:
        usable = usable.where(F.col(weight) > 0)
    half = lambda n: F.shiftright(n, 1)
    found = value_at_rank(usable, by, [F.col(value)], half, F.col(weight) if weight else None, ranges)
    return found.select(*by, F.col("key_0").alias("median"), "n")


def prefix_fraction(rows: DataFrame, key: str, fraction: float, ranges: int | None = None) -> DataFrame:
    """Rows of the first ``floor(n * fraction)`` of the ``n`` units named by ``key``.

    A fixed prefix in key order, not a random sample. The last key kept is a
    scalar subquery that reads the key column once; the rows are filtered by it
    while they are scanned. No key list passes through the driver or a join.
    """
    units = rows.select(key).where(F.col(key).isNotNull()).distinct()
    last_unit = lambda n: F.least(F.floor(n * F.lit(float(fraction))), n) - 1
    bound = value_at_rank(units, [], [F.col(key)], last_unit, ranges=ranges).select("key_0").scalar()
    return rows.where(F.col(key) <= bound)


def moments(weight: Column, value: Column) -> dict[str, Column]:
    """Aggregates for count, sum and sum of squares of weighted values."""
    return {
        "n": F.coalesce(F.sum(weight), F.lit(0)),
        "sum": F.sum(weight * value),
        "sum_squares": F.sum(weight * value * value),
    }


def mean(total: Column, n: Column) -> Column:
    return F.try_divide(total, n.cast("double"))


def standard_deviation(total: Column, squares: Column, n: Column) -> Column:
    """Population deviation; rounding below 0 counts as 0."""
    average = mean(total, n)
    variance = mean(squares, n) - average * average
    return F.sqrt(F.when(variance.isNotNull(), F.greatest(variance, F.lit(0.0))))


def standard_error(total: Column, squares: Column, n: Column) -> Column:
    return F.try_divide(standard_deviation(total, squares, n), F.sqrt(n.cast("double")))
