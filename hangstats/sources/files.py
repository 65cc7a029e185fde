"""Reading report files.

Layout: ``reason=/appName=/appUpdateChannel=/appVersion=/appBuildID=/
submission_date=`` directories of line files. Directories that a selection does
not hold are neither listed nor read.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession

from hangstats.sources.lines import SCHEMA, read_parts
from hangstats.sources.listing import (
    LZMA_ENDINGS,
    ReportFile,
    ReportTree,
    arrow_uri,
    head,
    plan_slices,
)
from hangstats.sources.selection import PingFilter


def selected_files(
    spark: SparkSession,
    root: str,
    selection: PingFilter | None = None,
    fraction: float = 1.0,
    compressed: bool = True,
) -> list[ReportFile]:
    """The selected files in (directory, name) order; no file is opened."""
    tree = ReportTree(arrow_uri(spark, root))
    contents = tree.contents(tree.directories(selection), LZMA_ENDINGS if compressed else ())
    return [file for files in head(contents, fraction) for file in sorted(files)]


def read_lines(
    spark: SparkSession,
    root: str,
    selection: PingFilter | None = None,
    fraction: float = 1.0,
    compressed: bool = True,
) -> DataFrame:
    """Lines of the selected report files in ``value``, plus the dimensions.

    ``compressed`` reads ``.lzma`` and ``.xz`` files as streams: one task for
    each 16 files but at least one for each core, each with about as many bytes;
    a large XZ file of several blocks is read by several tasks. Otherwise plain
    text or any codec Spark knows by file ending. ``fraction`` keeps the first
    files in (directory, name) order.

    The directories are listed once, when this is called. A selection without a
    match warns and is empty; errors while listing or reading are raised.
    """
    tree = ReportTree(arrow_uri(spark, root))
    directories = tree.directories(selection)
    if compressed:
        contents = tree.contents(directories, LZMA_ENDINGS)
        if not any(contents):
            warnings.warn("no report file matches the selection", stacklevel=2)
        files = [file for files in head(contents, fraction) for file in files]
        return read_parts(spark, tree.uri, plan_slices(tree, files, spark.sparkContext.defaultParallelism))
    if not directories:
        warnings.warn("no report file matches the selection", stacklevel=2)
    # Spark lists the last level itself; whole directories are given to it by name.
    paths = [directory.path for directory in directories]
    if fraction < 1.0:
        contents = tree.contents(directories)
        kept = head(contents, fraction)
        paths = paths[: max(len(kept) - 1, 0)] + sorted(file.path for files in kept[-1:] for file in files)
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    names = [root.rstrip("/") + path.removeprefix(tree.base) for path in paths]
    return spark.read.schema(SCHEMA).option("basePath", root).text(names)
