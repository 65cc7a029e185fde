"""All four analyses from one pass over the reports.

One aggregate holds what they need: hangs by stack and bin, sessions by hangs
and uptime, and the number of reports. It is shuffled once; every analysis reads
that shuffle. Running the analyses one by one parses the reports once for each,
or needs them cached.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hangstats.constants import PLUGIN_PREFIX
from hangstats.functions.histograms import bin_edge, weight_of
from hangstats.functions.stacks import frames_with_prefix, has_frame_prefix, last_frame, normalize_frames
from hangstats.operators.ranking import weighted_counts
from hangstats.plans import clusters, plugins
from hangstats.plans.sessions import session_total

HANG, SESSION, PING = 0, 1, 2
_ENTRY = """array<struct<kind:int,stack:array<string>,hangs:double,uptime:decimal(38,0),
    bins:array<struct<bin:bigint,weight:bigint>>>>"""
_RESULT = ("report", "rank", "stack_rank", "text", "metric", "value", "n")


def shared_counts(reports: DataFrame) -> DataFrame:
    """``(kind, stack, bin, hangs, uptime, weight)``: everything the analyses need, in one aggregate.

    Kind 0 is a hang: the weight of its stack in a bin, NULL for labels that are
    no number; every stack has a row of weight 0 too, so that one without a
    positive count is still known. Kind 1 is a session, kind 2 a well-formed report.
    """
    nothing = F.array(F.struct(F.lit(None).cast("bigint").alias("bin"), F.lit(0).cast("bigint").alias("weight")))
    one = F.array(F.struct(F.lit(None).cast("bigint").alias("bin"), F.lit(1).cast("bigint").alias("weight")))

    def entry(kind: int, bins: Column, stack: Column | None = None, hangs: Column | None = None) -> Column:
        none = F.lit(None)
        return F.struct(
            F.lit(kind).alias("kind"),
            (none.cast("array<string>") if stack is None else stack).alias("stack"),
            (none.cast("double") if hangs is None else hangs).alias("hangs"),
            (none.cast("decimal(38,0)") if hangs is None else F.col("uptime")).alias("uptime"),
            bins.alias("bins"),
        )

    def weights(hang: Column) -> Column:
        edges = F.transform(
            hang["bins"],
            lambda e: F.struct(bin_edge(e["label"]).alias("bin"), weight_of(e["count"]).alias("weight")),
        )
        return F.concat(F.filter(edges, lambda e: e["weight"].isNotNull()), nothing)

    hangs = F.filter(
        F.flatten(F.transform("threads", lambda thread: thread["hangs"])),
        lambda hang: hang["stack"].isNotNull() & hang["bins"].isNotNull(),
    )
    parts = [
        F.when(F.col("well_formed"), F.array(entry(PING, one))),
        F.transform(hangs, lambda hang: entry(HANG, weights(hang), stack=hang["stack"])),
        F.when(
            F.col("uptime").isNotNull(),
            F.transform("threads", lambda thread: entry(SESSION, one, hangs=session_total(thread["hangs"]))),
        ),
    ]
    entries = F.concat(*[F.coalesce(part.cast(_ENTRY), F.array().cast(_ENTRY)) for part in parts])
    rows = reports.select(F.explode_outer(entries).alias("e")).select(
        "e.kind", "e.stack", "e.hangs", "e.uptime", F.explode_outer("e.bins").alias("b")
    )
    counts = rows.groupBy("kind", "stack", F.col("b.bin").alias("bin"), "hangs", "uptime").agg(
        F.sum("b.weight").alias("weight")
    )
    # Packed once: a filter of one analysis would else move below the aggregate and make it another one.
    packed = counts.select(F.explode_outer(F.array(F.struct(*counts.columns))).alias("c"))
    return packed.select("c.*").where(F.col("kind").isNotNull())


def _long(frame: DataFrame, report: str, **columns: Column) -> DataFrame:
    """Rows of one report in the common columns; a missing one is NULL."""
    kinds = dict(zip(_RESULT, ("string", "int", "int", "string", "string", "double", "bigint")))
    given = {"report": F.lit(report)} | columns
    return frame.select(*[given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items()])


def _unpivoted(row: DataFrame, report: str) -> DataFrame:
    """One row to a row for each of its columns."""
    pairs = F.array(
        *[F.struct(F.lit(name).alias("metric"), F.col(name).cast("double").alias("value")) for name in row.columns]
    )
    return _long(row.select(F.explode(pairs).alias("p")).select("p.*"), report, metric=F.col("metric"), value=F.col("value"))


def analyses(reports: DataFrame, prefix: str = PLUGIN_PREFIX) -> dict[str, DataFrame]:
    """The results of all analyses, by name; sessions with ``n``, how many are equal."""
    counts = shared_counts(reports)
    hangs = counts.where(F.col("kind") == HANG)
    normal = hangs.select(normalize_frames("stack").alias("stack"), "weight").where(F.size("stack") > 0)
    stacks = weighted_counts(normal.select(last_frame("stack").alias("frame"), "stack", "weight"), "frame", "stack")
    timed = hangs.where(F.col("bin").isNotNull() & (F.col("weight") > 0))
    plugin_stacks = weighted_counts(timed.where(has_frame_prefix("stack", prefix)), "stack")
    kind = F.when(has_frame_prefix("stack", prefix), F.lit(plugins.PLUGIN)).otherwise(F.lit(plugins.OTHER))
    pings = counts.where(F.col("kind") == PING).select(
        F.lit(plugins.PING).alias("class"), F.lit(0).cast("bigint").alias("bin"), "weight"
    )
    durations = timed.select(kind.alias("class"), "bin", "weight").unionByName(pings)
    durations = durations.groupBy("class", "bin").agg(F.sum("weight").alias("weight"))
    frames = hangs.where(F.col("weight") >= 0).select(F.explode_outer(frames_with_prefix("stack", prefix)).alias("frame"))
    return {
        "hang_clusters": clusters.clusters_of(stacks.where(F.col("n") > 0)),
        "plugin_hang_stats": plugins.stats_of(durations),
        "plugin_frames": frames.where(F.col("frame").isNotNull()).distinct(),
        "plugin_hang_median": plugins.median_of(durations),
        "top_plugin_stacks": plugins.top_stacks_of(plugin_stacks),
        "top_plugin_frames": plugins.top_frames_of(plugin_stacks),
        "session_hangs": counts.where(F.col("kind") == SESSION).select("hangs", "uptime", F.col("weight").alias("n")),
    }


def all_reports(reports: DataFrame, prefix: str = PLUGIN_PREFIX) -> DataFrame:
    """Every figure of the four analyses as ``(report, rank, stack_rank, text, metric, value, n)``.

    Sessions come with their uptime as ``text`` and ``n``, how many are equal.
    """
    found = analyses(reports, prefix)
    top = found["hang_clusters"].withColumn("text", F.concat_ws(" | ", "frame", "stack"))
    place = {"rank": F.col("rank"), "stack_rank": F.col("stack_rank"), "text": F.col("text")}
    rows = [
        _long(top, "hang_clusters", **place, metric=F.lit("frequency"), value=F.col("frequency"), n=F.col("n")),
        _unpivoted(found["plugin_hang_stats"], "plugin_hang_stats"),
        _long(found["plugin_frames"], "plugin_frames", text=F.col("frame")),
        _unpivoted(found["plugin_hang_median"], "plugin_hang_median"),
    ]
    for name, column in (("top_plugin_stacks", "stack"), ("top_plugin_frames", "frame")):
        rows.append(_long(found[name], name, text=F.col(column), metric=F.lit("percent"), value=F.col("percent")))
    sessions = found["session_hangs"]
    uptime = F.col("uptime").cast("string")
    rows.append(_long(sessions, "session_hangs", text=uptime, metric=F.lit("hangs"), value=F.col("hangs"), n=F.col("n")))
    return reduce(DataFrame.unionByName, rows)
