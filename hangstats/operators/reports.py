"""From report lines to typed reports, hang rows and histogram rows.

``reports`` is the frame all analyses start from, one row per line::

    ping_id STRING, well_formed BOOLEAN, uptime DECIMAL(38,0),
    threads ARRAY<STRUCT<thread_pos INT, hangs ARRAY<STRUCT<
        hang_pos INT, stack ARRAY<STRING>,
        bins ARRAY<STRUCT<label STRING, count BIGINT>>,
        large ARRAY<STRUCT<label STRING, count DECIMAL(38,0)>>>>>>

plus the other columns of the lines. A body of the usual shape is read
straight into arrays, skipping everything else in it; only numbers stay VARIANT
until their type is checked. Any other body is read step by step: the elements
of an array come out as texts, and each is read on its own, so that a wrong part
costs itself alone. Neither way depends on settings of the session or on the
size of a body, and both keep the last value of a repeated key but every entry
of a histogram. All happens inside the row.

Generators are ``explode_outer`` wherever their input is computed: for an inner
``explode`` Catalyst infers filters on the input, which would parse every line
again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hangstats.constants import PREFIX_LENGTH, THREAD_NAME
from hangstats.functions import variants
from hangstats.functions.histograms import bin_edge, bin_midpoint, weight_of

_TO_END = 2**31 - 1

_USUAL_SHAPE = """
    simpleMeasurements struct<uptime: variant>,
    threadHangStats array<struct<
        name: string,
        hangs: array<struct<
            stack: array<string>, histogram: struct<values: map<string, variant>>>>>>,
    _unusual string
"""
_USUAL_OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_unusual",
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
}
_STEP_OPTIONS = {name: value for name, value in _USUAL_OPTIONS.items() if name != "columnNameOfCorruptRecord"}
_ON_ERROR = ("keep", "drop", "fail")
_LONG_NUMBER = "[0-9]{19}"
_WHOLE_NUMBER = "^-?(0|[1-9][0-9]*)$"


def raw_contains(lines: DataFrame, needle: str, line: str = "value") -> DataFrame:
    """Keep lines with the given text, before any parsing."""
    return lines.where(F.contains(F.col(line), F.lit(needle)))


def parse_pings(lines: DataFrame, on_error: str = "keep", line: str = "value") -> DataFrame:
    """Split off the line prefix and parse the body into ``ping VARIANT``.

    A malformed line has a NULL ``ping``: ``keep`` leaves it in to be counted,
    ``drop`` removes it, ``fail`` stops the job at the first one. Of a repeated
    key the last value is kept; Spark does so only with the session setting that
    is made here, and would reject the line without it. Bodies beyond the size
    limit of VARIANT are malformed here, not in :func:`read_reports`.
    """
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    parse = _parser(on_error)
    kept = [F.col(name) for name in lines.columns if name != line]
    pings = lines.select(_ping_id(line), parse(_body(line)).alias("ping"), *kept)
    return _keep(pings, F.col("ping").isNotNull()) if on_error == "drop" else pings


def _ping_id(line: str) -> Column:
    return F.substring(F.col(line), 1, PREFIX_LENGTH - 1).alias("ping_id")


def _body(line: str) -> Column:
    return F.substring(F.col(line), PREFIX_LENGTH + 1, _TO_END)


def _parser(on_error: str) -> Callable[[Column], Column]:
    if on_error not in _ON_ERROR:
        raise ValueError(f"on_error must be one of {_ON_ERROR}, not {on_error!r}")
    return F.parse_json if on_error == "fail" else F.try_parse_json


def _keep(frame: DataFrame, condition: Column) -> DataFrame:
    """Filter by a parsed value without parsing for the filter once more.

    A plain filter would be pushed below the parse, taking a copy of it along.
    """
    packed = F.when(condition, F.array(F.struct(*frame.columns)))
    rows = frame.select(F.explode_outer(packed).alias("row")).where(F.col("row").isNotNull())
    return rows.select("row.*")


def _bins(values: Column) -> Column:
    """Labels and counts of the (key, VARIANT) pairs that hold an integer."""
    counted = F.filter(values, lambda entry: variants.is_integer(entry["value"]))
    return F.transform(
        counted,
        lambda entry: F.struct(
            entry["key"].alias("label"),
            F.try_variant_get(entry["value"], "$", "bigint").alias("count"),
        ),
    )


def _large(values: Column) -> Column:
    """The same for integers beyond 64 bits."""
    entries = F.transform(
        values,
        lambda entry: F.struct(entry["key"].alias("label"), variants.large_integer(entry["value"]).alias("count")),
    )
    return F.filter(entries, lambda entry: entry["count"].isNotNull())


def _hang(pos: Column, stack: Column, values: Column, long: Column) -> Column:
    return F.struct(
        pos.alias("hang_pos"),
        stack.alias("stack"),
        _bins(values).alias("bins"),
        # Looking at each value once more is worth it only where a line has a number of that many digits.
        F.when(long, _large(values)).alias("large"),
    )


def _step(text: Column, schema: str) -> Column:
    """What a JSON text has of ``schema``; NULL where it is of another shape."""
    return F.from_json(text, schema, _STEP_OPTIONS)


def _step_values(hang: Column) -> Column:
    """Labels and VARIANT counts of one hang.

    A count that is an object with a repeated key fails as a VARIANT in some
    sessions. Then the texts of the counts are taken, the whole numbers among
    them if they stand without quotes after a label.
    """
    entries = F.map_entries(_step(hang, "histogram struct<values: map<string, variant>>")["histogram"]["values"])
    texts = F.map_entries(_step(hang, "histogram struct<values: map<string, string>>")["histogram"]["values"])
    whole = _step(hang, "histogram struct<values: string>")["histogram"]["values"]

    def number(entry: Column) -> Column:
        unquoted = [F.contains(whole, F.concat(F.lit('":'), entry["value"], F.lit(end))) for end in ",}"]
        usable = F.rlike(entry["value"], F.lit(_WHOLE_NUMBER)) & (unquoted[0] | unquoted[1])
        value = F.coalesce(*[entry["value"].try_cast(kind).cast("variant") for kind in ("bigint", "decimal(38,0)")])
        return F.struct(entry["key"].alias("key"), F.when(usable, value).alias("value"))

    return F.coalesce(entries, F.transform(texts, number))


def _step_threads(threads: Column, thread: str, long: Column) -> Column:
    """Entries of a thread list, given as texts, that have a hang list; the others give NULL hangs."""

    def hangs(entry: Column) -> Column:
        return F.transform(
            _step(entry, "hangs array<string>")["hangs"],
            lambda hang, pos: _hang(pos, _step(hang, "stack array<string>")["stack"], _step_values(hang), long),
        )

    return F.transform(
        threads,
        lambda entry, pos: F.struct(
            pos.alias("thread_pos"),
            F.when(_step(entry, "name string")["name"] == thread, hangs(entry)).alias("hangs"),
        ),
    )


def _typed_threads(report: Column, thread: str, long: Column) -> Column:
    """The same from a body of the usual shape."""

    def hangs(entry: Column) -> Column:
        return F.transform(
            entry["hangs"],
            lambda hang, pos: _hang(pos, hang["stack"], F.map_entries(hang["histogram"]["values"]), long),
        )

    return F.transform(
        report["threadHangStats"],
        lambda entry, pos: F.struct(
            pos.alias("thread_pos"),
            F.when(entry["name"] == thread, hangs(entry)).alias("hangs"),
        ),
    )


def _is_json(body: Column) -> Column:
    """True for an object, whatever follows it, and for any other single JSON value."""
    checked = F.from_json(body, "_unusual string", _USUAL_OPTIONS)
    # Something else has to be valid as a member of an object and as the only element of an array.
    member = F.from_json(F.concat(F.lit('{"x":'), body, F.lit("}")), "x string, _unusual string", _USUAL_OPTIONS)
    element = F.size(_step(F.concat(F.lit("["), body, F.lit("]")), "array<string>")) == 1
    is_object = checked.isNotNull() & checked["_unusual"].isNull()
    return F.coalesce(is_object | (member["_unusual"].isNull() & element), F.lit(False))


def read_reports(
    lines: DataFrame, thread: str = THREAD_NAME, on_error: str = "keep", line: str = "value"
) -> DataFrame:
    """Lines to typed reports with the hangs of one thread.

    Threads with another name and threads without a hang list are left out.
    ``on_error`` is that of :func:`parse_pings`. An element of a list that is a
    text holding a JSON object is read as that object.
    """
    if on_error not in _ON_ERROR:
        raise ValueError(f"on_error must be one of {_ON_ERROR}, not {on_error!r}")
    kept = [name for name in lines.columns if name != line]
    read = lines.select(
        _ping_id(line),
        _body(line).alias("_body"),
        F.from_json(_body(line), _USUAL_SHAPE, _USUAL_OPTIONS).alias("_report"),
        *kept,
    )
    usual = F.col("_report").isNotNull() & F.col("_report._unusual").isNull()
    body, is_json = F.col("_body"), _is_json(F.col("_body"))
    if on_error == "fail":
        said = F.raise_error(F.concat(F.lit("malformed report line "), F.col("ping_id"))).cast("boolean")
        is_json = F.when(is_json, F.lit(True)).otherwise(said)
    parsed = read.select(
        "ping_id",
        "_report",
        usual.alias("_usual"),
        F.rlike(body, F.lit(_LONG_NUMBER)).alias("_long"),
        F.when(~usual, is_json).alias("_json"),
        F.when(~usual, _step(body, "threadHangStats array<string>")["threadHangStats"]).alias("_threads"),
        F.when(~usual, _step(body, "simpleMeasurements struct<uptime: variant>")).alias("_measured"),
        *kept,
    )
    report, long = F.col("_report"), F.col("_long")
    threads = F.when(F.col("_usual"), _typed_threads(report, thread, long)).otherwise(
        F.when(F.col("_json"), _step_threads(F.col("_threads"), thread, long))
    )
    uptime = F.when(F.col("_usual"), report["simpleMeasurements"]["uptime"]).otherwise(
        F.when(F.col("_json"), F.col("_measured")["simpleMeasurements"]["uptime"])
    )
    reports = parsed.select(
        "ping_id",
        (F.col("_usual") | F.col("_json")).alias("well_formed"),
        uptime.alias("_uptime"),
        F.filter(threads, lambda entry: entry["hangs"].isNotNull()).alias("threads"),
        *kept,
    ).select("ping_id", "well_formed", variants.any_integer(F.col("_uptime")).alias("uptime"), "threads", *kept)
    return _keep(reports, F.col("well_formed")) if on_error == "drop" else reports


@contextmanager
def cached(frame: DataFrame) -> Iterator[DataFrame]:
    """Keep a frame while several analyses read it; lost blocks are recomputed."""
    frame.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield frame
    finally:
        frame.unpersist()


def ping_counts(reports: DataFrame) -> DataFrame:
    """One row: well-formed and malformed lines."""
    return reports.agg(
        F.count_if(F.col("well_formed")).alias("pings_analyzed"),
        F.count_if(~F.col("well_formed")).alias("malformed"),
    )


def hang_rows(reports: DataFrame) -> DataFrame:
    """One row per hang that has both a stack and a histogram."""
    kept = [name for name in reports.columns if name not in ("well_formed", "threads")]
    threads = reports.select(*kept, F.explode_outer("threads").alias("thread"))
    hangs = threads.select(
        *kept,
        F.col("thread.thread_pos").alias("thread_pos"),
        F.explode("thread.hangs").alias("hang"),
    )
    return hangs.select(*kept, "thread_pos", "hang.hang_pos", "hang.stack", "hang.bins").where(
        F.col("stack").isNotNull() & F.col("bins").isNotNull()
    )


def histogram_rows(hangs: DataFrame) -> DataFrame:
    """One row per histogram bin with a positive count.

    ``bin`` and ``mid`` are NULL for a label that is no number.
    """
    kept = [name for name in hangs.columns if name != "bins"]
    entries = hangs.select(*kept, F.explode("bins").alias("entry"))
    edges = entries.select(
        *kept,
        F.col("entry.label").alias("label"),
        bin_edge(F.col("entry.label")).alias("bin"),
        weight_of(F.col("entry.count")).alias("weight"),
    ).where(F.col("weight").isNotNull())
    return edges.select(*kept, "label", "bin", bin_midpoint("bin").alias("mid"), "weight")


def replicate(frame: DataFrame, weight: str, chunk: int = 65536) -> DataFrame:
    """Repeat each row ``weight`` times; none for zero, negative or NULL.

    The analyses keep the weight instead. Two generators keep every array
    within ``chunk`` elements for all INT weights.
    """
    count = F.col(weight)
    starts = F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), count - 1, F.lit(chunk)))
    chunks = frame.select(*frame.columns, F.explode(starts).alias("_start"))
    copies = F.least(F.lit(chunk), F.col(weight) - F.col("_start")).cast("int")
    return chunks.select(
        *frame.columns, F.explode(F.array_repeat(F.lit(True), copies)).alias("_copy")
    ).select(*frame.columns)
