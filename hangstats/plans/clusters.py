"""Which innermost frames cause most hangs, and which stacks dominate them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hangstats.constants import LAST_RANK, SKIPPED_RANKS, STACKS_PER_FRAME
from hangstats.functions.histograms import hang_weight
from hangstats.functions.stacks import last_frame, normalize_frames, stack_text
from hangstats.operators.ranking import rank_range, top_k, top_k_per_group, total, weighted_counts
from hangstats.operators.reports import hang_rows


def stack_counts(reports: DataFrame) -> DataFrame:
    """``(frame, stack, n)``: hangs per normalised, non-empty stack.

    Grouped by the whole stack, so the stacks of a hot frame spread over tasks.
    """
    hangs = hang_rows(reports).where(F.size("stack") > 0)
    rows = hangs.select(
        normalize_frames("stack").alias("stack"), hang_weight("bins").alias("weight")
    ).select(last_frame("stack").alias("frame"), "stack", "weight")
    # Weightless stacks go after the sums: a filter on the weight would be
    # pushed down and compute it twice.
    return weighted_counts(rows, "frame", "stack").where(F.col("n") > 0)


def frame_counts(stacks: DataFrame) -> DataFrame:
    return weighted_counts(stacks, "frame", weight="n")


def top_frames(reports: DataFrame, limit: int = LAST_RANK) -> DataFrame:
    """``(frame, n, share)`` of the hottest innermost frames."""
    frames = frame_counts(stack_counts(reports))
    return top_k(frames, limit, "frame").select(
        "frame", "n", F.try_divide(F.col("n").cast("double"), total(frames)).alias("share")
    )


def top_stacks_per_frame(reports: DataFrame, k: int = STACKS_PER_FRAME) -> DataFrame:
    """``(frame, stack_rank, stack, n, frequency)`` for all frames."""
    stacks = stack_counts(reports)
    sizes = frame_counts(stacks).select(F.col("frame").alias("_frame"), F.col("n").alias("_size"))
    top = top_k_per_group(stacks, "frame", k, "stack", rank="stack_rank")
    return top.join(sizes, F.col("frame").eqNullSafe(F.col("_frame"))).select(
        "frame",
        "stack_rank",
        stack_text("stack").alias("stack"),
        "n",
        F.try_divide("n", "_size").alias("frequency"),
    )


def hang_clusters(
    reports: DataFrame,
    skip: int = SKIPPED_RANKS,
    limit: int = LAST_RANK,
    per_frame: int = STACKS_PER_FRAME,
) -> DataFrame:
    """Frames of rank ``skip + 1`` to ``limit``, each with its top stacks.

    One row per frame and stack. The stack counts are shuffled once and serve
    the frame ranking, the total and the stacks.
    """
    return clusters_of(stack_counts(reports), skip, limit, per_frame)


def clusters_of(
    stacks: DataFrame, skip: int = SKIPPED_RANKS, limit: int = LAST_RANK, per_frame: int = STACKS_PER_FRAME
) -> DataFrame:
    """:func:`hang_clusters` from ``(frame, stack, n)``."""
    frames = frame_counts(stacks)
    ranked = rank_range(frames, skip, limit, "frame").select(
        F.col("rank"),
        F.col("frame").alias("_frame"),
        F.col("n").alias("_size"),
        F.try_divide(F.col("n").cast("double"), total(frames)).alias("share"),
    )
    listed = stacks.join(ranked, F.col("frame").eqNullSafe(F.col("_frame")))
    top = top_k_per_group(listed, "frame", per_frame, "stack", rank="stack_rank")
    return top.select(
        "rank",
        "frame",
        F.col("_size").alias("n"),
        "share",
        "stack_rank",
        stack_text("stack").alias("stack"),
        F.try_divide("n", "_size").alias("frequency"),
    )


def hang_clusters_nested(reports: DataFrame, **options: int) -> DataFrame:
    """``hang_clusters`` with one row per frame and an array of its stacks."""
    entry = F.struct("stack_rank", "stack", "frequency")
    return (
        hang_clusters(reports, **options)
        .groupBy("rank", "frame", "n", "share")
        .agg(F.sort_array(F.collect_list(entry)).alias("_stacks"))
        .select(
            "rank",
            "frame",
            "n",
            "share",
            F.transform(
                "_stacks", lambda s: F.struct(s["stack"].alias("stack"), s["frequency"].alias("frequency"))
            ).alias("stacks"),
        )
    )
