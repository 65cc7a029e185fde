"""Selection of reports by dimension."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hangstats.constants import REPORT_REASON, WILDCARD

Range = str | tuple[str, str]
_EQUAL = ("reason", "appName", "appUpdateChannel")  # never a range nor a wildcard


def _bounds(value: Range) -> tuple[str, str]:
    return (value, value) if isinstance(value, str) else value


def _within(name: str, value: Range) -> Column | None:
    """Closed range in text order; an end that is ``*`` is open."""
    low, high = _bounds(value)
    column = F.col(name)
    if low == high != WILDCARD:
        return column == low
    ends = []
    if low != WILDCARD:
        ends.append(column >= low)
    if high != WILDCARD:
        ends.append(column <= high)
    if not ends:
        return None
    return ends[0] if len(ends) == 1 else ends[0] & ends[1]


@dataclass(frozen=True)
class PingFilter:
    """Application, channel, and one value or a (min, max) pair for the rest."""

    app_name: str
    channel: str
    version: Range = WILDCARD
    build_id: Range = WILDCARD
    submission: Range = WILDCARD

    def to_column(self) -> Column:
        """The predicate on the dimension columns."""
        parts = [
            F.col("reason") == REPORT_REASON,
            F.col("appName") == self.app_name,
            F.col("appUpdateChannel") == self.channel,
            _within("appVersion", self.version),
            _within("appBuildID", self.build_id),
            _within("submission_date", self.submission),
        ]
        predicate = parts[0]
        for part in parts[1:]:
            if part is not None:
                predicate = predicate & part
        return predicate

    def accepts(self, dimension: str, value: str | None) -> bool:
        """The same for one dimension value of a directory; a missing value is never held."""
        wanted = {
            "reason": REPORT_REASON,
            "appName": self.app_name,
            "appUpdateChannel": self.channel,
            "appVersion": self.version,
            "appBuildID": self.build_id,
            "submission_date": self.submission,
        }[dimension]
        low, high = _bounds(wanted)
        if dimension in _EQUAL:
            return value == low
        if low == high == WILDCARD:
            return True
        return value is not None and (low == WILDCARD or low <= value) and (high == WILDCARD or value <= high)

    def apply(self, frame: DataFrame) -> DataFrame:
        return frame.where(self.to_column())
