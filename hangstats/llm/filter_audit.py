"""Which of several filters removes what, in every order: an incremental audit with retractions.

The files of the documents arrive as micro-batches of an available-now stream.
Whether a text was seen under a smaller id can change with every batch, so

* a keyed state holds, for each distinct text, the smallest id so far and what was counted for it;
* a smaller id that arrives later takes its place: what was counted for the
  earlier one is retracted and counted anew as a copy;
* each batch leaves a few counter changes by part and set of failed filters,
  whose sum over all batches is exact whatever order the files came in.

The counters, not the documents, are then put through all orders of the filters.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hangstats.llm.common import drop_folder, map_rows, scratch_folder

FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_CAPITAL_PERCENT = 10
_MARK = re.compile(r"[#$%&*|]")
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_COPY = 1 << FILTERS.index("E")

#: Files of a micro-batch for each core, so that a batch keeps the cluster busy and the number of batches stays low.
FILES_PER_CORE = 4
#: Bytes of the table for each bucket of texts. A call for each text would cost more than its work, so the texts of a
#: bucket (a range of digests, some thousand texts) share one state entry; every text in it has its own smallest id.
BUCKET_BYTES, MIN_BUCKETS = 16 << 20, 64
#: Distinct texts that a task combines in memory before it hands them on.
_COMBINED = 50_000

_READ = "doc_id bigint, text string, lang string"
_MEASURED = "doc_id bigint, part string, high bigint, low bigint, fails int"
_COMBINED_ROWS = "high bigint, low bigint, doc_id bigint, sure boolean, part string, fails int, good boolean, toxic boolean, n bigint"
_CHANGES = "part string, fails int, good boolean, toxic boolean, n bigint"
_GROUP = ["part", "fails", "good", "toxic"]
#: Of one bucket: for each text its digest, smallest id, group (an index of ``groups``) and number of rows.
_STATE = "high binary, low binary, least binary, at binary, n binary, groups string"
_SETTINGS = {
    # Available-now runs end with the data: no further batch is needed to move a watermark.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    # The state store is the session's choice. A text takes some 40 bytes in it; the default store has all of it in
    # memory, once for each version kept, so one earlier version has to do.
    "spark.sql.streaming.maxBatchesToRetainInMemory": "1",
}


def failed(text: str) -> int:
    """Bits of the filters A to D that a text fails; E depends on the other texts."""
    data = text.encode()
    words = data.split()  # splits at the six ASCII space characters
    conditions = (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words),
        100 * (len(data) - len(data.translate(None, _CAPITALS))) > MAX_CAPITAL_PERCENT * len(text),
        _MARK.search(text) is not None,
    )
    return sum(1 << i for i, failing in enumerate(conditions) if failing)


def _measure(table: pa.Table) -> dict[str, list]:
    texts = [text or "" for text in table.column("text").to_pylist()]
    digests = b"".join(hashlib.sha256(text.encode()).digest()[:16] for text in texts)
    halves = np.frombuffer(digests, dtype=np.int64).reshape(-1, 2)
    return {
        "doc_id": table.column("doc_id").to_pylist(),
        "part": [part or "" for part in table.column("lang").to_pylist()],
        "high": halves[:, 0],
        "low": halves[:, 1],
        "fails": [failed(text) for text in texts],
    }


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text and group: those of the smallest id seen here, and those sure to be copies.

    The latter come out as ``sure`` with the copy bit; they and rows without an
    id need no state. A text of a third of all rows thus leaves a
    task in a few rows.
    """
    names = [field.split()[0] for field in _COMBINED_ROWS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64()]
    least: dict[tuple[int, int], tuple[int, Counter]] = {}
    sure: Counter = Counter()

    def flush() -> pa.RecordBatch:
        rows = [(*digest, at, False, *group, n) for digest, (at, groups) in least.items() for group, n in groups.items()]
        rows += [(zlib.crc32(repr(group).encode()), 0, 0, True, *group, n) for group, n in sure.items()]
        least.clear()
        sure.clear()
        columns = zip(*rows) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("high", "low", "doc_id", *_GROUP)]
        for high, low, doc_id, *rest in zip(*columns):
            group = tuple(rest)
            if doc_id is None:
                sure[group] += 1
                continue
            at, groups = least.get((high, low), (None, None))
            if at is None or doc_id < at:
                for (part, fails, good, toxic), n in (groups or {}).items():
                    sure[part, fails | _COPY, good, toxic] += n
                least[high, low] = doc_id, Counter([group])
            elif doc_id == at:
                groups[group] += 1
            else:
                sure[group[0], group[1] | _COPY, *group[2:]] += 1
        if len(least) >= _COMBINED:
            yield flush()
    yield flush()


def _stored(state: GroupState) -> pd.DataFrame:
    """The entries of a bucket as rows like those that arrive."""
    *arrays, groups = state.get
    high, low, least, at, n = (np.frombuffer(a, dtype=np.int64) for a in arrays)
    known = pd.DataFrame(json.loads(groups), columns=_GROUP).iloc[at].reset_index(drop=True)
    return pd.DataFrame({"high": high, "low": low, "doc_id": least, **known, "n": n})


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Counter changes of one bucket; its state becomes the smallest id of each text and what is counted for it."""
    arrived = pd.concat(list(frames), ignore_index=True)
    sure = arrived[arrived["sure"]]
    rows = arrived[~arrived["sure"]][["high", "low", "doc_id", *_GROUP, "n"]].assign(old=False)
    if state.exists:  # (joining an empty frame would turn digests into floating point numbers)
        rows = pd.concat([_stored(state).assign(old=True), rows], ignore_index=True)
    first = rows["doc_id"] == rows.groupby(["high", "low"])["doc_id"].transform("min")
    copies = rows[~first].assign(fails=lambda r: r["fails"] | _COPY)
    changes = [
        sure[[*_GROUP, "n"]],
        rows[first & ~rows["old"]][[*_GROUP, "n"]],  # counted under the smallest id so far
        copies[[*_GROUP, "n"]],  # arrived under a larger id, or has just become a copy
        rows[~first & rows["old"]].assign(n=lambda r: -r["n"])[[*_GROUP, "n"]],  # what had been counted for the latter
    ]
    if len(rows):
        kept = rows[first].groupby(["high", "low", "doc_id", *_GROUP], as_index=False, sort=False)["n"].sum()
        groups = kept[_GROUP].drop_duplicates().reset_index(drop=True)
        at = kept[_GROUP].merge(groups.reset_index(), on=_GROUP, how="left")["index"]
        columns = [kept["high"], kept["low"], kept["doc_id"], at, kept["n"]]
        listed = [[p, int(f), bool(g), bool(t)] for p, f, g, t in groups.itertuples(index=False)]
        state.update((*(c.to_numpy(np.int64).tobytes() for c in columns), json.dumps(listed)))
    total = pd.concat(changes).astype({"good": bool, "toxic": bool, "n": "int64", "fails": "int32"})
    total = total.groupby(_GROUP, as_index=False, sort=False)["n"].sum()
    yield total[total["n"] != 0]


def documents_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """All files of a Parquet table as a stream of micro-batches; only the three columns that are needed are read.

    The table may be a folder or a single file: a stream takes the latter as a pattern only.
    """
    files = files_per_batch or FILES_PER_CORE * spark.sparkContext.defaultParallelism
    path = path.rstrip("/")
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(_READ).option("maxFilesPerTrigger", files).parquet(pattern)


def label_flags(labels: DataFrame) -> DataFrame:
    """One row for each labelled id: whether any of its rows calls it good, whether any calls it toxic."""
    flag = lambda name: F.coalesce(F.bool_or(F.col(name) == 1), F.lit(False))
    return (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("bigint").alias("_id"))
        .agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    )


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings while a query starts (it keeps a copy of its own)."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def bucket_count(spark: SparkSession, path: str) -> int:
    """How many buckets of texts a table of this size is dealt to; no file is opened for it."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    return max(MIN_BUCKETS, size // BUCKET_BYTES)


def failure_counters(stream: DataFrame, labels: DataFrame, buckets: int = MIN_BUCKETS) -> DataFrame:
    """``(part, fails, good, toxic, n)``: documents by part, failed filters and labels, once the stream has ended.

    ``stream`` has ``doc_id, text, lang``. A batch that is repeated after a
    failure overwrites its own changes, so each counts once.
    """
    spark = stream.sparkSession
    folder = scratch_folder(spark, "filter-audit")
    measured = map_rows(stream, _MEASURED, _measure)
    labelled = measured.join(label_flags(labels), F.col("doc_id") == F.col("_id"), "left").select(
        "high",
        "low",
        "doc_id",
        "part",
        "fails",
        F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )
    changes = (
        labelled.mapInArrow(_combine, _COMBINED_ROWS)
        .withColumn("bucket", F.pmod("high", F.lit(buckets)))
        .groupBy("bucket")
        .applyInPandasWithState(_update, _CHANGES, _STATE, "update", GroupStateTimeout.NoTimeout)
    )

    def keep(batch: DataFrame, number: int) -> None:
        summed = batch.groupBy("part", "fails", "good", "toxic").agg(F.sum("n").alias("n"))
        summed.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    with _settings(spark, _SETTINGS):
        query = (
            changes.writeStream.outputMode("update")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(keep)
            .start()
        )
    query.awaitTermination()
    spark.createDataFrame([], _CHANGES).coalesce(1).write.mode("overwrite").parquet(f"{folder}/changes/batch=-1")
    drop_folder(spark, f"{folder}/checkpoint")
    total = spark.read.schema(_CHANGES).parquet(f"{folder}/changes").groupBy("part", "fails", "good", "toxic")
    return total.agg(F.sum("n").alias("n")).where(F.col("n") != 0)


def _steps() -> str:
    """All orders of the filters, one entry for each step, as JSON."""
    bit = {name: 1 << i for i, name in enumerate(FILTERS)}
    return json.dumps(
        [
            {"filter_order": "".join(order), "step": i + 1, "before": sum(bit[f] for f in order[:i]), "bit": bit[name]}
            for order in itertools.permutations(FILTERS)
            for i, name in enumerate(order)
        ]
    )


def order_report(counters: DataFrame) -> DataFrame:
    """What each step of each order keeps and removes, from counters by set of failed filters."""
    steps = F.from_json(F.lit(_steps()), "array<struct<filter_order:string,step:int,before:int,bit:int>>")
    rows = counters.select("*", F.explode(steps).alias("s")).select("*", "s.*")
    fails, bit, before = F.col("fails"), F.col("bit"), F.col("before")
    hit, gone = fails.bitwiseAND(bit) != 0, fails.bitwiseAND(before) != 0
    count = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint")
    report = rows.groupBy("part", "filter_order", "step", "bit").agg(
        count(~hit & ~gone).alias("kept"),
        count(hit & ~gone).alias("removed"),
        count(hit & gone).alias("redundant"),
        count(fails == bit).alias("unique_fails"),
        count(hit & ~gone & F.col("good")).alias("good_lost"),
        count(hit & ~gone & F.col("toxic")).alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "bit")).cast("bigint")
    return report.withColumn("shapley", shapley).drop("bit")


def audit_filters(stream: DataFrame, labels: DataFrame, buckets: int = MIN_BUCKETS) -> DataFrame:
    """One row for each part (language), order of the five filters and step.

    NULL texts count as empty, a NULL language is the part ``""``. Repeated rows
    count as often as they stand there; rows of one id do not make each other
    copies, and a row without an id is no copy and makes none (it has no
    labels either). A document is good or toxic if any label row of its id
    says so. An empty table gives no rows.
    """
    return order_report(failure_counters(stream, labels, buckets))
