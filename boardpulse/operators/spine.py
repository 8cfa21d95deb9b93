"""Generated days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardpulse.functions.calendar import Period


def day_spine(spark: SparkSession, period: Period, column: str = "date") -> DataFrame:
    """One row per day of the period; none when it ends before it starts."""
    if period.days <= 0:
        return spark.range(0).select(F.lit(period.start).alias(column))
    days = F.sequence(F.lit(period.start), F.lit(period.end), F.expr("INTERVAL 1 DAY"))
    return spark.range(1).select(F.explode(days).alias(column))
