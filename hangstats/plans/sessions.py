"""Hangs per session against its uptime."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hangstats.functions.histograms import count_total


def hang_totals(hang: Column) -> Column:
    """Plain count sum of a hang, NULL without a histogram; negative counts and those beyond 64 bits take part in it."""
    beyond = F.when(hang["large"].isNotNull(), count_total(hang["large"]))
    return F.when(hang["bins"].isNotNull(), count_total(hang["bins"]) + F.coalesce(beyond, F.lit(0.0)))


def _totals(hangs: Column | str) -> Column:
    """The sums of the hangs that have a histogram."""
    return F.transform(F.filter(hangs, lambda hang: hang["bins"].isNotNull()), hang_totals)


def _threads(reports: DataFrame, *kept: str) -> DataFrame:
    """Thread entries of pings that have an integer uptime."""
    usable = F.when(F.col("uptime").isNotNull(), F.col("threads"))
    rows = reports.select(*kept, F.explode_outer(usable).alias("thread"))
    return rows.where(F.col("thread").isNotNull())


def session_total(hangs: Column | str) -> Column:
    """Hangs of one thread entry, those left out whose counts do not add up to a positive number."""
    positive = F.filter(_totals(hangs), lambda value: value > 0)
    return F.aggregate(positive, F.lit(0.0), lambda acc, value: acc + value)


def session_hangs(reports: DataFrame, strict: bool = False) -> DataFrame:
    """``(hangs, uptime)`` per thread entry, 0.0 for one without hangs.

    A hang whose counts do not add up to a positive number is left out, see
    :func:`invalid_hangs`; with ``strict`` it stops the job. Everything happens
    inside the row, without a shuffle.
    """
    def valid(value: Column) -> Column:
        if not strict:
            return F.when(value > 0, value).otherwise(F.lit(0.0))
        return F.when(value > 0, value).otherwise(
            F.raise_error(F.lit("hang without a positive count")).cast("double")
        )

    hangs = F.aggregate(_totals("thread.hangs"), F.lit(0.0), lambda acc, value: acc + valid(value))
    return _threads(reports, "uptime").select(hangs.alias("hangs"), "uptime")


def session_hangs_checked(reports: DataFrame) -> DataFrame:
    """:func:`session_hangs` with ``invalid``: how many hangs of the session it leaves out."""
    totals = _threads(reports, "uptime").select("uptime", _totals("thread.hangs").alias("totals"))
    positive = F.filter("totals", lambda value: value > 0)
    left_out = F.filter("totals", lambda value: value <= 0)
    return totals.select(
        F.aggregate(positive, F.lit(0.0), lambda acc, value: acc + value).alias("hangs"),
        "uptime",
        F.size(left_out).cast("long").alias("invalid"),
    )


def invalid_hangs(reports: DataFrame) -> DataFrame:
    """``(hangs, invalid)``: all hangs of sessions, and those without a positive count."""
    totals = _threads(reports, "uptime").select(_totals("thread.hangs").alias("totals"))
    return totals.agg(
        F.coalesce(F.sum(F.size("totals")), F.lit(0)).alias("hangs"),
        F.coalesce(
            F.sum(F.size(F.filter("totals", lambda value: value <= 0))), F.lit(0)
        ).alias("invalid"),
    )
