"""Set operators on whole rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hangstats.operators.reports import replicate


def subtract_keep_dups(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` that equal no row of ``right``, duplicates included.

    ``EXCEPT`` would remove the duplicates and ``EXCEPT ALL`` would subtract
    multiplicities. NULLs are equal to each other. Both sides meet in one
    aggregate over all columns, whose partial counts keep a hot row from
    travelling row by row; what is left is repeated by its count.
    """
    if len(left.columns) != len(right.columns):
        raise ValueError("both sides need the same number of columns")
    names = [f"_{i}" for i in range(len(left.columns))]
    own = left.toDF(*names).withColumn("_n", F.lit(1).cast("bigint"))
    others = right.toDF(*names).withColumn("_n", F.lit(None).cast("bigint"))
    counted = own.unionByName(others).groupBy(*names).agg(
        F.sum("_n").alias("_n"), F.bool_or(F.col("_n").isNull()).alias("_excluded")
    )
    kept = replicate(counted.where(~F.col("_excluded")).select(*names, "_n"), "_n")
    return kept.select(*names).toDF(*left.columns)
