"""Several reporting periods side by side."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardpulse.functions.calendar import Period, within_days
from boardpulse.sources.tables import Tables


def period_overview(tables: Tables, periods: Mapping[str, Period]) -> DataFrame:
    """Bounds of each named period and of the one before it, and the sessions in both.

    All counts come from a single pass over the facts.
    """
    ranges = {
        (name, side): period.as_range()
        for name, chosen in periods.items()
        for side, period in (("in", chosen), ("before", chosen.previous()))
    }
    counts = [
        F.count(F.when(within_days(F.col("session_date"), [days]), F.col("id"))).alias(f"{name}_{side}")
        for (name, side), days in ranges.items()
    ]
    rows = [
        F.struct(
            F.lit(name).alias("period"),
            F.lit(chosen.start).alias("curr_start"),
            F.lit(chosen.end).alias("curr_end"),
            F.lit(chosen.previous().start).alias("prev_start"),
            F.lit(chosen.previous().end).alias("prev_end"),
            F.lit(chosen.days).cast("long").alias("days"),
            F.col(f"{name}_in").alias("sessions"),
            F.col(f"{name}_before").alias("sessions_before"),
        )
        for name, chosen in periods.items()
    ]
    return tables.sessions(*ranges.values()).agg(*counts).select(F.inline(F.array(*rows)))
