"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(
    frame: DataFrame, path: str, single_file: bool = False, mode: str = "errorifexists"
) -> None:
    """CSV with a header line in each file, written by the executors.

    ``single_file`` puts a small result into one file below ``path``.
    """
    if single_file:
        frame = frame.coalesce(1)
    frame.write.mode(mode).option("header", True).csv(path)
