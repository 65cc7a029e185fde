"""Hangs with a plugin frame against other hangs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hangstats.constants import PLUGIN_PREFIX, TOP_LIST
from hangstats.functions.histograms import HISTOGRAM, LARGE_COUNTS, bin_midpoint, hang_moments
from hangstats.functions.stacks import (
    frames_with_prefix,
    has_frame_prefix,
    last_frame,
    stack_text,
)
from hangstats.operators.ranking import percent, top_k, total, weighted_counts
from hangstats.operators.reports import hang_rows, histogram_rows
from hangstats.operators.stats import (
    mean,
    moments,
    standard_error,
    value_at_rank,
)

OTHER, PLUGIN, PING = 0, 1, 2


def duration_counts(reports: DataFrame, prefix: str = PLUGIN_PREFIX) -> DataFrame:
    """``(class, bin, weight)``: all the duration analyses need, in one pass.

    Class 1 has a plugin frame, class 0 none. Every well-formed ping adds one
    marker of class 2, so the pings are counted by the same scan.
    """
    marker = F.struct(
        F.lit(None).cast("int").alias("hang_pos"),
        F.lit(None).cast("array<string>").alias("stack"),
        F.array(
            F.struct(F.lit("0").alias("label"), F.lit(1).cast("bigint").alias("count"))
        ).cast(HISTOGRAM).alias("bins"),
        F.lit(None).cast(LARGE_COUNTS).alias("large"),
    )
    hangs = F.filter(
        F.flatten(F.transform("threads", lambda thread: thread["hangs"])),
        lambda hang: hang["stack"].isNotNull() & hang["bins"].isNotNull(),
    )
    entries = F.when(
        F.col("well_formed"), F.concat(F.array(marker), F.coalesce(hangs, F.array()))
    )
    rows = reports.select(F.explode_outer(entries).alias("hang")).select(
        F.when(F.col("hang.stack").isNull(), F.lit(PING))
        .when(has_frame_prefix("hang.stack", prefix), F.lit(PLUGIN))
        .otherwise(F.lit(OTHER))
        .alias("class"),
        F.col("hang.bins").alias("bins"),
    )
    durations = histogram_rows(rows).where(F.col("bin").isNotNull())
    return durations.groupBy("class", "bin").agg(F.sum("weight").alias("weight"))


def _of(kind: int, column: Column) -> Column:
    return F.when(F.col("class") == kind, column)


def plugin_hang_stats(reports: DataFrame, prefix: str = PLUGIN_PREFIX) -> DataFrame:
    """One row: counts, plugin ratio, mean duration and standard error by class.

    ``mean_other_as_published`` divides the time of all hangs by the number of
    other hangs; it is kept for comparison with published reports.
    """
    return stats_of(duration_counts(reports, prefix))


def stats_of(counts: DataFrame) -> DataFrame:
    """:func:`plugin_hang_stats` from ``(class, bin, weight)``."""
    weight, mid = F.col("weight"), bin_midpoint("bin")
    plugin = moments(_of(PLUGIN, weight), mid)
    other = moments(_of(OTHER, weight), mid)
    sums = counts.agg(
        F.coalesce(F.sum(_of(PING, weight)), F.lit(0)).alias("pings_analyzed"),
        *[column.alias(f"plugin_{name}") for name, column in plugin.items()],
        *[column.alias(f"other_{name}") for name, column in other.items()],
    )
    n_plugin, n_other = F.col("plugin_n"), F.col("other_n")
    time_plugin, time_other = F.col("plugin_sum"), F.col("other_sum")
    time_all = F.coalesce(time_plugin, F.lit(0.0)) + F.coalesce(time_other, F.lit(0.0))
    return sums.select(
        "pings_analyzed",
        (n_plugin + n_other).alias("n_total"),
        n_plugin.alias("n_plugin"),
        n_other.alias("n_other"),
        F.try_divide(n_plugin, n_plugin + n_other).alias("plugin_ratio"),
        mean(time_plugin, n_plugin).alias("mean_plugin"),
        standard_error(time_plugin, F.col("plugin_sum_squares"), n_plugin).alias("se_plugin"),
        mean(time_other, n_other).alias("mean_other"),
        standard_error(time_other, F.col("other_sum_squares"), n_other).alias("se_other"),
        mean(time_all, n_other).alias("mean_other_as_published"),
    )


def plugin_hang_median(reports: DataFrame, prefix: str = PLUGIN_PREFIX) -> DataFrame:
    """One row: counts, plugin ratio and upper median duration by class."""
    return median_of(duration_counts(reports, prefix))


def median_of(counts: DataFrame) -> DataFrame:
    """:func:`plugin_hang_median` from ``(class, bin, weight)``."""
    found = value_at_rank(counts, ["class"], [F.col("bin")], lambda n: F.shiftright(n, 1), F.col("weight"))
    n, median = F.col("n"), bin_midpoint("key_0")
    row = found.agg(
        F.coalesce(F.max(_of(PING, n)), F.lit(0)).alias("pings_analyzed"),
        F.coalesce(F.max(_of(PLUGIN, n)), F.lit(0)).alias("n_plugin"),
        F.coalesce(F.max(_of(OTHER, n)), F.lit(0)).alias("n_other"),
        F.max(_of(PLUGIN, median)).alias("median_plugin"),
        F.max(_of(OTHER, median)).alias("median_other"),
    )
    return row.select(
        "pings_analyzed",
        "n_plugin",
        "n_other",
        F.try_divide("n_plugin", F.col("n_plugin") + F.col("n_other")).alias("plugin_ratio"),
        "median_plugin",
        "median_other",
    )


def plugin_frames(reports: DataFrame, prefix: str = PLUGIN_PREFIX) -> DataFrame:
    """The distinct plugin frames."""
    frames = hang_rows(reports).select(
        F.explode_outer(frames_with_prefix("stack", prefix)).alias("frame")
    )
    return frames.where(F.col("frame").isNotNull()).distinct()


def plugin_stack_counts(reports: DataFrame, prefix: str = PLUGIN_PREFIX) -> DataFrame:
    """``(stack, n)`` over plugin hangs with a usable duration."""
    hangs = hang_rows(reports).where(has_frame_prefix("stack", prefix))
    rows = hangs.select("stack", hang_moments("bins")["n"].alias("weight"))
    return weighted_counts(rows, "stack").where(F.col("n") > 0)


def top_plugin_stacks(
    reports: DataFrame, k: int = TOP_LIST, prefix: str = PLUGIN_PREFIX
) -> DataFrame:
    """``(stack, percent)``: the most frequent plugin stacks."""
    return top_stacks_of(plugin_stack_counts(reports, prefix), k)


def top_stacks_of(counts: DataFrame, k: int = TOP_LIST) -> DataFrame:
    """:func:`top_plugin_stacks` from ``(stack, n)``."""
    return top_k(counts, k, "stack").select(
        stack_text("stack").alias("stack"), percent("n", total(counts)).alias("percent")
    )


def top_plugin_frames(
    reports: DataFrame, k: int = TOP_LIST, prefix: str = PLUGIN_PREFIX
) -> DataFrame:
    """``(frame, percent)``: the most frequent innermost frames of plugin stacks."""
    return top_frames_of(plugin_stack_counts(reports, prefix), k)


def top_frames_of(stacks: DataFrame, k: int = TOP_LIST) -> DataFrame:
    """:func:`top_plugin_frames` from ``(stack, n)``."""
    frames = weighted_counts(
        stacks.select(last_frame("stack").alias("frame"), "n"), "frame", weight="n"
    )
    return top_k(frames, k, "frame").select("frame", percent("n", total(frames)).alias("percent"))
