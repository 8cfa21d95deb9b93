"""The newest rows of day-partitioned facts, found by reading backwards."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardpulse.functions.calendar import DayRange
from boardpulse.session import pin
from boardpulse.sources.zones import Zone, ping_micros

NEVER = (date(2000, 1, 2), date(2000, 1, 1))


def as_ranges(days: Sequence[date]) -> list[DayRange]:
    """Neighbouring days as one range each."""
    ranges: list[list[date]] = []
    for day in sorted(days):
        if ranges and ranges[-1][1] + timedelta(days=1) == day:
            ranges[-1][1] = day
        else:
            ranges.append([day, day])
    return [(low, high) for low, high in ranges]


def newest_rows(
    read: Callable[[Sequence[DayRange]], DataFrame],
    zones: Sequence[Zone],
    limit: int,
    order_by: Sequence[Column],
    bounds: DayRange = (None, None),
    keep: Column | None = None,
) -> tuple[DataFrame, list[date]]:
    """The first ``limit`` rows by last ping descending, nulls first, and the days opened for them.

    ``order_by`` says that order, with ties broken. Days are opened from the one with the
    latest ping backwards, twice as many each time, until ``limit`` rows beat every ping of
    every day not opened. Rows without a ping come first, so days that hold any are searched
    for these alone; days of which nothing is known are always opened. ``keep`` filters rows.
    """
    low, high = bounds
    inside = [z for z in zones if (low is None or z.day >= low) and (high is None or z.day <= high)]
    unknown = [z.day for z in inside if z.facts is None]
    known = sorted((z for z in inside if z.high is not None), key=lambda z: z.high, reverse=True)
    with_nulls = [z.day for z in inside if z.facts is not None and z.nulls]

    def rows(days: Sequence[date]) -> DataFrame:
        # An empty range list would mean all days.
        found = read(as_ranges(days) or [NEVER])
        return found if keep is None else found.where(keep)

    at = 0
    found, opened = None, set(with_nulls) | set(unknown)
    step = 1
    while True:
        # Without a filter the counts say how many days it takes at least.
        wanted, end = 0, at
        while end < len(known) and (end - at < step or (keep is None and at == 0 and wanted < limit)):
            wanted += known[end].facts - known[end].nulls
            end += 1
        batch = rows([z.day for z in known[at:end]]).where(F.col("last_ping").isNotNull())
        opened.update(z.day for z in known[at:end])
        if found is None:
            nulls = rows(with_nulls).where(F.col("last_ping").isNull())
            batch = batch.unionByName(nulls).unionByName(rows(unknown))
        else:
            batch = batch.unionByName(found)
        found = pin(batch.orderBy(*order_by).limit(limit))
        at, step = end, 2 * max(step, end - at)
        if at == len(known):
            return found, sorted(opened)
        n, last = found.agg(F.count("*"), F.min(ping_micros())).first()
        if n == limit and (last is None or last > known[at].high):
            return found, sorted(opened)
