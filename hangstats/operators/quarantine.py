"""What the analyses leave out, row by row with its cause, and counts that come with an analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from hangstats.functions.histograms import bin_edge, weight_of
from hangstats.plans.sessions import hang_totals

# Causes, and what they keep out of.
MALFORMED = "malformed line"  # every report
NO_THREADS = "no thread list"  # every report but the number of lines
NO_UPTIME = "uptime is no integer"  # sessions
NO_STACK = "hang without a stack"  # stacks and durations
NO_HISTOGRAM = "hang without a histogram"  # all reports
NOT_POSITIVE = "hang without a positive count"  # sessions
LARGE_COUNT = "count beyond 64 bits"  # stacks and durations
NO_NUMBER = "label that is no number"  # durations

_FOUND = "array<struct<cause:string,thread_pos:int,hang_pos:int,label:string>>"


def _found(cause: str, thread: Column | None = None, hang: Column | None = None, label: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(cause).alias("cause"),
        (none if thread is None else thread).cast("int").alias("thread_pos"),
        (none if hang is None else hang).cast("int").alias("hang_pos"),
        (none if label is None else label).cast("string").alias("label"),
    )


def _joined(*parts: Column) -> Column:
    """Arrays of findings as one; a NULL one has none."""
    return F.concat(*[F.coalesce(part.cast(_FOUND), F.array().cast(_FOUND)) for part in parts])


def _of_hang(thread: Column, hang: Column) -> Column:
    at = thread["thread_pos"], hang["hang_pos"]
    unread = F.filter(
        hang["bins"], lambda e: weight_of(e["count"]).isNotNull() & bin_edge(e["label"]).isNull()
    )
    return _joined(
        F.when(hang["stack"].isNull(), F.array(_found(NO_STACK, *at))),
        F.when(hang["bins"].isNull(), F.array(_found(NO_HISTOGRAM, *at))),
        F.when(hang_totals(hang) <= 0, F.array(_found(NOT_POSITIVE, *at))),
        F.transform(hang["large"], lambda e: _found(LARGE_COUNT, *at, e["label"])),
        F.transform(unread, lambda e: _found(NO_NUMBER, *at, e["label"])),
    )


def _findings() -> Column:
    def of_thread(thread: Column) -> Column:
        return F.flatten(F.transform(thread["hangs"], lambda hang: _of_hang(thread, hang)))

    lost_sessions = F.col("uptime").isNull() & (F.size("threads") > 0)
    return _joined(
        F.when(~F.col("well_formed"), F.array(_found(MALFORMED))),
        F.when(F.col("well_formed") & F.col("threads").isNull(), F.array(_found(NO_THREADS))),
        F.when(lost_sessions, F.array(_found(NO_UPTIME))),
        F.flatten(F.transform("threads", of_thread)),
    )


def quarantine(reports: DataFrame) -> DataFrame:
    """``(ping_id, cause, thread_pos, hang_pos, label)``: each part of a line that some analysis leaves out.

    A hang may be listed for several causes. A repeated or missing id stays as
    it is. Everything happens inside the row, without a shuffle.
    """
    rows = reports.select("ping_id", F.explode_outer(_findings()).alias("found"))
    return rows.where(F.col("found").isNotNull()).select("ping_id", "found.*")


def counted(reports: DataFrame, name: str = "reports") -> tuple[DataFrame, Observation]:
    """``reports``, and what becomes known of them while an analysis of this frame runs.

    After the first action on the analysis, ``observation.get`` has
    ``pings_analyzed``, ``malformed``, ``hangs``, ``invalid_hangs`` (no positive
    count) and ``large_counts`` (beyond 64 bits): no second scan is needed.
    """
    hangs = F.flatten(F.transform("threads", lambda thread: thread["hangs"]))
    totals = F.filter(F.transform(hangs, hang_totals), lambda total: total.isNotNull())
    large = F.flatten(F.transform(hangs, lambda hang: F.coalesce(hang["large"], F.array())))

    def total(column: Column) -> Column:
        return F.coalesce(F.sum(F.greatest(F.size(column), F.lit(0))), F.lit(0))

    observation = Observation(name)
    frame = reports.observe(
        observation,
        F.count_if(F.col("well_formed")).alias("pings_analyzed"),
        F.count_if(~F.col("well_formed")).alias("malformed"),
        total(totals).alias("hangs"),
        total(F.filter(totals, lambda value: value <= 0)).alias("invalid_hangs"),
        total(large).alias("large_counts"),
    )
    return frame, observation
