"""Field access on JSON values whose shape is only known at run time.

A value of the wrong shape gives NULL, so exploding it gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


_LARGE = r"^DECIMAL\((19|2[0-9]|3[0-8]),0\)$"


def text(value: Column | str, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def items(value: Column | str, path: str) -> Column:
    """The elements of a JSON array."""
    return F.try_variant_get(value, path, "array<variant>")


def texts(value: Column | str, path: str) -> Column:
    """The elements of a JSON array as strings."""
    return F.try_variant_get(value, path, "array<string>")


def fields(value: Column | str, path: str) -> Column:
    """The fields of a JSON object as an array of (key, value)."""
    return F.map_entries(F.try_variant_get(value, path, "map<string,variant>"))


def is_integer(value: Column) -> Column:
    """True for a JSON integer within 64 bits; 2.0 and "7" are none."""
    return F.schema_of_variant(value) == "BIGINT"


def large_integer(value: Column) -> Column:
    """An integer of up to 38 digits that is beyond 64 bits, NULL for anything else.

    A number of this size with a fraction of zeros counts as the integer it
    equals. Integers of more digits are no usable numbers.
    """
    found = F.try_variant_get(value, "$", "decimal(38,0)")
    beyond = (found > F.lit(2**63 - 1)) | (found < F.lit(-(2**63)))
    return F.when(F.schema_of_variant(value).rlike(_LARGE) & beyond, found)


def any_integer(value: Column) -> Column:
    """A JSON integer of up to 38 digits as DECIMAL(38,0), NULL for anything else."""
    small = F.when(is_integer(value), F.try_variant_get(value, "$", "bigint").cast("decimal(38,0)"))
    return F.coalesce(small, large_integer(value))


def integer(value: Column | str, path: str) -> Column:
    """A JSON integer, NULL for anything else."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(is_integer(found), F.try_variant_get(value, path, "bigint"))
