"""Local calendar days, reporting periods and their presets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the time zone whose midnight separates two session days.
LOCAL_ZONE = "America/Argentina/Buenos_Aires"

SECONDS_PER_DAY = 86_400
SECONDS_TO_1970 = (date(1970, 1, 1) - date(1, 1, 1)).days * SECONDS_PER_DAY

# An inclusive range of days; None leaves that end open.
DayRange = tuple[date | None, date | None]


def to_local(frame: DataFrame, column: str, zone: str = LOCAL_ZONE) -> Column:
    """Wall-clock time in ``zone`` of an instant column.

    A zone-less column is read as UTC. Neither form depends on the session time zone.
    """
    if isinstance(frame.schema[column].dataType, T.TimestampNTZType):
        return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(column))
    return F.convert_timezone(None, F.lit(zone), F.col(column))


def local_day(frame: DataFrame, column: str, zone: str = LOCAL_ZONE) -> Column:
    """Calendar day in ``zone`` of an instant column.

    Computed for every fact row, so it stays with epoch arithmetic: shifting an instant
    by the zone's offset costs about a tenth of converting a wall-clock time, and does
    not depend on the session time zone either.
    """
    if isinstance(frame.schema[column].dataType, T.TimestampNTZType):
        since_year_one = F.col(column) - F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
        instant = F.timestamp_seconds(since_year_one.cast("long") - SECONDS_TO_1970)
    else:
        instant = F.col(column)
    seconds = F.unix_seconds(F.from_utc_timestamp(instant, zone))
    return F.date_from_unix_date(F.floor(seconds / SECONDS_PER_DAY).cast("int"))


def today_in(zone: str = LOCAL_ZONE) -> date:
    return datetime.now(ZoneInfo(zone)).date()


def within_days(column: Column, ranges: Sequence[DayRange]) -> Column:
    """True where a day column falls into any of ``ranges``. No ranges means all days."""
    return _any_of([_bounded(column, F.lit(lo), F.lit(hi), lo, hi) for lo, hi in ranges])


def within_instants(
    frame: DataFrame, column: str, ranges: Sequence[DayRange], zone: str = LOCAL_ZONE
) -> Column:
    """The same day ranges said in terms of the raw instant column.

    A comparison of the stored column with a constant reaches the file scan, which a
    comparison of the derived day cannot.
    """
    zoneless = isinstance(frame.schema[column].dataType, T.TimestampNTZType)

    def midnight(day: date) -> Column:
        instant = datetime.combine(day, time.min, ZoneInfo(zone)).astimezone(timezone.utc)
        if zoneless:
            return F.lit(instant.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
        return F.lit(instant)

    terms = []
    for lo, hi in ranges:
        term = F.lit(True)
        if lo is not None:
            term = term & (F.col(column) >= midnight(lo))
        if hi is not None:
            term = term & (F.col(column) < midnight(hi + timedelta(days=1)))
        terms.append(term)
    return _any_of(terms)


def _bounded(column: Column, low: Column, high: Column, lo: date | None, hi: date | None) -> Column:
    term = F.lit(True)
    if lo is not None:
        term = term & (column >= low)
    if hi is not None:
        term = term & (column <= high)
    return term


def _any_of(terms: list[Column]) -> Column:
    if not terms:
        return F.lit(True)
    joined = terms[0]
    for term in terms[1:]:
        joined = joined | term
    return joined


def fixed_offset(zone: str) -> timedelta | None:
    """UTC offset of a zone that has had one offset in all its history, else None."""
    months = (datetime(y, m, 1, tzinfo=ZoneInfo(zone)) for y in range(1900, 2101) for m in range(1, 13))
    offsets = {moment.utcoffset() for moment in months}
    return offsets.pop() if len(offsets) == 1 else None


@dataclass(frozen=True)
class Period:
    """A reporting period, both ends inclusive, and the equally long one before it."""

    start: date
    end: date

    # Fixed value: the default period reaches this many days back from its end.
    DEFAULT_REACH = 7

    @classmethod
    def resolve(cls, start: date | None, end: date | None, as_of: date) -> Period:
        """Fill absent bounds, each on its own: end is ``as_of``, start a week before end."""
        end = end or as_of
        return cls(start or end - timedelta(days=cls.DEFAULT_REACH), end)

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1

    def previous(self) -> Period:
        end = self.start - timedelta(days=1)
        return Period(end - timedelta(days=self.days - 1), end)

    def as_range(self) -> DayRange:
        return (self.start, self.end)


def preset_bounds(name: str, as_of: date) -> DayRange:
    """Bounds behind the period buttons of the usage screen.

    ``this_month`` is the whole calendar month, ``30d`` the last thirty days and today,
    ``reset`` clears both bounds so that the report default applies.
    """
    if name == "this_month":
        first = as_of.replace(day=1)
        following = (first + timedelta(days=32)).replace(day=1)
        return first, following - timedelta(days=1)
    if name == "30d":
        return as_of - timedelta(days=30), as_of
    if name == "reset":
        return None, None
    raise ValueError(f"unknown period preset: {name!r}")
