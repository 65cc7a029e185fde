"""Time the headline queries; prints one JSON line.

Reads $BENCH_SF_DIR on local[$BENCH_CPUS]. The report files are written first
and timed apart (``writing``); the report queries read all of them, so they are
timed from files to result. Every query writes all its rows to Spark's no-op
sink. The value is the sum over the queries of the faster of two runs.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from hangstats.catalog import queries  # noqa: E402
from hangstats.catalog.layouts import layout  # noqa: E402
from hangstats.session import build_session  # noqa: E402
from hangstats.sources.files import read_lines  # noqa: E402

HEADLINE = (
    "hang_clusters",
    "plugin_hang_stats",
    "plugin_frames",
    "plugin_hang_median",
    "top_plugin_stacks",
    "top_plugin_frames",
    "session_hangs",
    "top_stacks_per_frame",
    "hang_rows",
    "histogram_explode",
    "lzma_text_scan",
    "source_pruning",
    "prefix_fraction",
    "median_upper",
    "subtract_keep_dups",
    "file_fraction",
    "nightly_hang_clusters",
    "nightly_plugin_hang_stats",
    "nightly_plugin_hang_median",
    "nightly_session_hangs",
)
RUNS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__driver__memory="16g",
        spark__sql__shuffle__partitions=cpus,
    )
    spark.sparkContext.setLogLevel("ERROR")
    writing = {}
    for kind in ("lzma", "text"):
        start = time.perf_counter()
        layout(spark, sf_dir, kind)
        writing[kind] = round(time.perf_counter() - start, 3)
    queries.report_lines = lambda session, folder: read_lines(session, layout(session, folder, "lzma"))
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "writing": writing,
                "sf": sf_dir.rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
