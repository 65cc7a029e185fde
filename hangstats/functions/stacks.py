"""Column functions on stacks: arrays of frame names, innermost frame last."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hangstats.constants import LINE_SUFFIX, PLUGIN_PREFIX


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def normalize_frame(frame: Column | str) -> Column:
    """Drop the last ``:<digit>...`` suffix of a frame name."""
    return F.regexp_replace(_column(frame), LINE_SUFFIX, "$1")


def normalize_frames(stack: Column | str) -> Column:
    return F.transform(_column(stack), normalize_frame)


def last_frame(stack: Column | str) -> Column:
    """The innermost frame, NULL for an empty stack."""
    return F.try_element_at(_column(stack), F.lit(-1))


def frames_with_prefix(stack: Column | str, prefix: str = PLUGIN_PREFIX) -> Column:
    return F.filter(_column(stack), lambda frame: F.startswith(frame, F.lit(prefix)))


def has_frame_prefix(stack: Column | str, prefix: str = PLUGIN_PREFIX) -> Column:
    """True when a frame starts with ``prefix``; NULL frames never do."""
    found = F.exists(_column(stack), lambda frame: F.startswith(frame, F.lit(prefix)))
    return F.coalesce(found, F.lit(False))


def stack_text(stack: Column | str, separator: str = " > ") -> Column:
    return F.array_join(_column(stack), separator)


def zip_arrays(**arrays: Column | str) -> Column:
    """Pair up arrays by position, as long as the shortest of them."""
    columns = {name: _column(value) for name, value in arrays.items()}
    sizes = [F.size(column) for column in columns.values()]
    length = F.least(*sizes) if len(sizes) > 1 else sizes[0]
    zipped = F.arrays_zip(*[column.alias(name) for name, column in columns.items()])
    return F.slice(zipped, F.lit(1), length)
