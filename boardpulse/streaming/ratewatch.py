"""Clients that ask more often than allowed."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from boardpulse.functions.calendar import DayRange
from boardpulse.sources.feeds import event_time
from boardpulse.streaming.parts import PartKind, compact_parts, read_parts, write_parts

# The observed window, and the requests allowed in it overall and for logins.
WINDOW = "15 minutes"
MAX_REQUESTS = 3000
MAX_LOGINS = 15


def request_counts(access_log: DataFrame, window: str = WINDOW, key: str = "key") -> DataFrame:
    """Requests of each key in each window."""
    counted = access_log.groupBy(key, F.window("ts", window)).agg(F.count("*").alias("requests"))
    return counted.select(
        key, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "requests"
    )


def over_limit(counts: DataFrame, limit: int) -> DataFrame:
    return counts.where(F.col("requests") > limit).withColumn("excess", F.col("requests") - limit)


def rate_breaches(
    access_log: DataFrame,
    limit: int = MAX_REQUESTS,
    window: str = WINDOW,
    key: str = "key",
    lateness: str | None = None,
) -> DataFrame:
    """Windows in which a key made more than ``limit`` requests, and by how many.

    A streaming log needs ``lateness``: it emits a window once it is closed, and loses
    what is later or still open. :func:`write_counts` has neither limit.
    """
    timed = access_log
    if access_log.isStreaming:
        if lateness is None:
            raise ValueError("a streaming log needs a lateness; to keep everything, write counts instead")
        timed = event_time(access_log).withWatermark("ts", lateness)
    return over_limit(request_counts(timed, window, key), limit)


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("key", "window_start", "window_end").agg(F.sum("requests").alias("requests"))


# Requests of each key in each window; a window belongs to the UTC day of its start.
COUNTS = PartKind(
    T.StructType()
    .add("key", T.LongType())
    .add("window_start", T.TimestampType())
    .add("window_end", T.TimestampType())
    .add("requests", T.LongType()),
    _summed,
    day_of="window_start",
)


def write_counts(access_log: DataFrame, path: str, window: str = WINDOW) -> DataStreamWriter:
    """Writer that stores each micro-batch as requests of each key in each window."""
    return write_parts(access_log, path, COUNTS, lambda batch: request_counts(batch, window))


def read_breaches(
    spark: SparkSession, path: str, limit: int = MAX_REQUESTS, ranges: Sequence[DayRange] = ()
) -> DataFrame:
    """Breaches among all stored requests, or in the windows that start on some UTC days."""
    return over_limit(read_parts(spark, path, COUNTS, ranges), limit)


def compact_counts(spark: SparkSession, path: str, closed: date | None = None) -> list[str | None]:
    return compact_parts(spark, path, COUNTS, closed=closed)
