"""Report files written from numbered event lines, as input of the file scans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hangstats.catalog.event_lines import event_lines
from hangstats.constants import DIMENSIONS
from hangstats.session import scratch_dir
from hangstats.sources.listing import arrow_uri

_written: dict[tuple[str, str, str], str] = {}


def write_text_layout(lines: DataFrame, root: str) -> None:
    """Gzip text files below dimension directories."""
    _placed(lines).write.partitionBy(*DIMENSIONS).option("compression", "gzip").text(root)


def _placed(lines: DataFrame) -> DataFrame:
    """Few directories per task; ranges split a directory with many lines.

    The row number keeps copies of one line from being a single range.
    """
    ranged = lines.repartitionByRange(*DIMENSIONS, "row")
    return ranged.select("value", *DIMENSIONS)


def lzma_writer(root: str, columns: list[str], dimensions: list[str]) -> Callable:
    """Sorted lines to one LZMA file for each directory and ``block``; yields the names.

    A file gets its name when it is complete, so a repeated task replaces it.
    """

    def write(batches: Iterator) -> Iterator:
        import lzma

        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        files, base = fs.FileSystem.from_uri(root)
        current = stream = packer = folder = None

        def close() -> str:
            stream.write(packer.flush())
            stream.close()
            target = f"{folder}/part-{current[-1]:08d}.lzma"
            if files.get_file_info(target).type != fs.FileType.NotFound:
                files.delete_file(target)
            files.move(f"{folder}/_part-{attempt}", target)
            return target

        for batch in batches:
            frame = {name: batch.column(columns.index(name)).to_pylist() for name in columns}
            keys = zip(*[frame[name] for name in (*dimensions, "block")])
            done = []
            for line, key in zip(frame["value"], keys):
                if key != current:
                    if stream is not None:
                        done.append(close())
                    current = key
                    folder = "/".join([base, *[f"{n}={v}" for n, v in zip(dimensions, key)]])
                    files.create_dir(folder, recursive=True)
                    stream = files.open_output_stream(f"{folder}/_part-{attempt}")
                    packer = lzma.LZMACompressor(format=lzma.FORMAT_ALONE, preset=0)
                stream.write(packer.compress(line.encode() + b"\n"))
            yield pa.RecordBatch.from_pydict({"path": pa.array(done, pa.string())})
        if stream is not None:
            yield pa.RecordBatch.from_pydict({"path": pa.array([close()], pa.string())})

    return write


def write_lzma_layout(lines: DataFrame, root: str) -> int:
    """LZMA line files below dimension directories; returns how many.

    Ranges end between files, so a file is written by one task; a directory with
    many lines has many files.
    """
    columns = ["value", *DIMENSIONS, "block"]
    target = arrow_uri(lines.sparkSession, root)
    ranged = lines.select(columns).repartitionByRange(*DIMENSIONS, "block")
    ordered = ranged.sortWithinPartitions(*DIMENSIONS, "block")
    return ordered.mapInArrow(
        lzma_writer(target, columns, list(DIMENSIONS)), "path string"
    ).count()


def layout(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """The folder with this session's report files, written on first use."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _written:
        root = scratch_dir(spark, kind)
        lines = event_lines(spark, sf_dir, numbered=True)
        if kind == "lzma":
            write_lzma_layout(lines, root)
        else:
            write_text_layout(lines, root)
        _written[key] = root
    return _written[key]
