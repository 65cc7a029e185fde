"""Hang report analytics on Spark DataFrames."""

from hangstats.operators.quarantine import counted, quarantine
from hangstats.operators.reports import (
    cached,
    hang_rows,
    histogram_rows,
    parse_pings,
    raw_contains,
    read_reports,
)
from hangstats.plans.clusters import hang_clusters, hang_clusters_nested
from hangstats.plans.combined import all_reports, analyses
from hangstats.plans.plugins import (
    plugin_frames,
    plugin_hang_median,
    plugin_hang_stats,
    top_plugin_frames,
    top_plugin_stacks,
)
from hangstats.plans.sessions import invalid_hangs, session_hangs
from hangstats.session import build_session
from hangstats.sinks import write_csv
from hangstats.sources.files import read_lines
from hangstats.sources.selection import PingFilter

__all__ = [
    "PingFilter",
    "all_reports",
    "analyses",
    "build_session",
    "cached",
    "counted",
    "hang_clusters",
    "hang_clusters_nested",
    "hang_rows",
    "histogram_rows",
    "invalid_hangs",
    "parse_pings",
    "plugin_frames",
    "plugin_hang_median",
    "plugin_hang_stats",
    "quarantine",
    "raw_contains",
    "read_lines",
    "read_reports",
    "session_hangs",
    "top_plugin_frames",
    "top_plugin_stacks",
    "write_csv",
]
