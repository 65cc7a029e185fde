"""Shared folders, intermediate tables and Arrow batches for the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step looks at together; a longer text is a step of its own.
STEP_BYTES = 1 << 21

#: The same where rows pass through with all their columns.
PASSING_BYTES = 1 << 18

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names, else the session's warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


@contextmanager
def _shuffle_files_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written is read from its table from then on, so its shuffle files may go at once."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def staged(frame: DataFrame, label: str) -> tuple[DataFrame, Callable[[], None]]:
    """Write a frame once to the shared folder and read it back; and a call that deletes what was written.

    Later jobs do not repeat its lineage. Delete it only when all that reads it has been written itself.
    """
    spark = frame.sparkSession
    path = scratch_folder(spark, label)
    with _shuffle_files_dropped(spark):
        frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path), lambda: drop_folder(spark, path)


def stage_table(frame: DataFrame, label: str) -> DataFrame:
    """A staged frame that stays: what is returned to the caller reads it."""
    return staged(frame, label)[0]


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/hangstats-llm-{label}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns the operators read; whatever else a table has stays out of their way."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encoded(texts: list[str | None]) -> list[bytes]:
    return [(text or "").encode() for text in texts]


def steps(sizes: list[int], most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of at most ``most`` bytes, or of one row."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def map_rows(
    frame: DataFrame,
    schema: str,
    work: Callable[[pa.Table], dict[str, list] | None],
) -> DataFrame:
    """``work`` on each bounded slice of ``frame`` (which has a text column); its columns make up the result."""
    target = frame.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            lengths = [n or 0 for n in pc.binary_length(table.column("text")).to_pylist()]
            for start, end in steps(lengths):
                columns = work(table.slice(start, end - start))
                if columns:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[field.name], type=field.type) for field in arrow], schema=arrow
                    )

    return frame.mapInArrow(run, target)


def text_slices(texts: pa.Array, most: int = PASSING_BYTES) -> Iterator[list[str | None]]:
    """The texts of a batch as Python strings, some at a time."""
    for start, end in steps([n or 0 for n in pc.binary_length(texts).to_pylist()], most):
        yield texts.slice(start, end - start).to_pylist()


def filter_rows(docs: DataFrame, keep: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """The rows of ``docs``, all columns, whose text ``keep`` accepts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: list[bool] = []
            for texts in text_slices(batch.column(batch.schema.get_field_index("text"))):
                kept += keep(texts)
            yield batch.filter(pa.array(kept, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
