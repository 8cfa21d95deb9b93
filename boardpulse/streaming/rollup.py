"""Pings to sessions: one row per user, dashboard and local day."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from boardpulse.functions.calendar import LOCAL_ZONE, DayRange, fixed_offset, local_day
from boardpulse.sources.feeds import accepted_pings, event_time
from boardpulse.streaming.parts import PartKind, compact_parts, read_parts, write_parts

# Fixed value: the page name under which a login is recorded.
LOGIN_PORTAL = "LOGIN_PORTAL"

KEY = ["user_id", "dashboard_url", "session_date"]


def _measures(has_id: bool) -> list[Column]:
    # A login marks the day once however often it happens; a ping adds one unit.
    length = F.when(F.col("dashboard_url") == LOGIN_PORTAL, F.lit(1).cast("long")).otherwise(
        F.count("*")
    )
    measures = [
        F.min("ts").alias("start_time"),
        F.max("ts").alias("last_ping"),
        length.alias("duration_minutes"),
    ]
    return ([F.min("id").alias("id")] if has_id else []) + measures


def roll_up(pings: DataFrame, zone: str = LOCAL_ZONE, counted: bool = False) -> DataFrame:
    """Sessions of a static ping frame, at any number of pings per key.

    Counts and extremes combine before the shuffle, so one user's flood of pings leaves
    every task as a single row per dashboard and day. An ``id`` column is kept as the
    lowest one. ``counted`` adds the number of ``pings``, which a login's length does not tell.
    """
    daily = pings.withColumn("session_date", local_day(pings, "ts", zone))
    number = [F.count("*").alias("pings")] if counted else []
    return daily.groupBy(*KEY).agg(*_measures("id" in pings.columns), *number)


def dashboard_sessions(pings: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    """Sessions on dashboards only, invalid pings left out."""
    return roll_up(accepted_pings(pings).where(F.col("dashboard_url") != LOGIN_PORTAL), zone)


def login_markers(logins: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    """One marker of length 1 per user and local day, last login kept."""
    marked = logins.withColumn("dashboard_url", F.lit(LOGIN_PORTAL))
    return roll_up(marked, zone)


def roll_up_stream(pings: DataFrame, lateness: str, zone: str = LOCAL_ZONE) -> DataFrame:
    """Streaming sessions, each emitted once when its day is over plus ``lateness``.

    Pings later than that are lost and days not over are not emitted; this is the form for
    a reader who wants each day once. :func:`write_partials` has neither limit. Days are
    event-time windows shifted to local midnight, which needs a zone with one offset.
    """
    offset = fixed_offset(zone)
    if offset is None:
        raise ValueError(f"{zone} changes its offset; write partial sessions instead")
    shift = int(-offset.total_seconds()) % 86_400
    timed = event_time(accepted_pings(pings)).withWatermark("ts", lateness)
    day = F.window("ts", "1 day", startTime=f"{shift} seconds")
    closed = timed.groupBy("user_id", "dashboard_url", day).agg(*_measures("id" in pings.columns))
    opened = closed.withColumn("opened", F.col("window.start"))
    return opened.withColumn("session_date", local_day(opened, "opened", zone)).drop("window", "opened")


def write_partials(pings: DataFrame, path: str, zone: str = LOCAL_ZONE) -> DataStreamWriter:
    """Writer that stores each micro-batch of accepted pings as partial sessions by day."""
    kind = partial_sessions("id" in pings.columns)
    return write_parts(pings, path, kind, lambda batch: roll_up(accepted_pings(batch), zone))


def part_schema(with_id: bool = False) -> T.StructType:
    instant = T.TimestampType()
    columns = [("user_id", T.LongType()), ("dashboard_url", T.StringType()), ("session_date", T.DateType())]
    columns += [("start_time", instant), ("last_ping", instant), ("duration_minutes", T.LongType())]
    columns = ([("id", T.LongType())] if with_id else []) + columns
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


def partial_sessions(with_id: bool = False) -> PartKind:
    """Sessions of a part of the pings; they add up to the sessions of all."""
    return PartKind(part_schema(with_id), merge_partials, day_column="session_date")


def read_partials(
    spark: SparkSession, path: str, ranges: Sequence[DayRange] = (), with_id: bool = False
) -> DataFrame:
    """Sessions as of now from the stored parts, of all days or of some; only those days are read.

    As a session source: ``lambda ranges: read_partials(spark, path, ranges)``.
    """
    return read_parts(spark, path, partial_sessions(with_id), ranges)


def compact_partials(spark: SparkSession, path: str, closed: date | None = None, with_id: bool = False) -> list[str | None]:
    """Merge the parts of days up to ``closed``, and of days with very many parts; returns those days.

    A day that is over becomes one part; a ping that comes still later becomes a new one and
    is merged with it the next time.
    """
    return compact_parts(spark, path, partial_sessions(with_id), closed=closed)


def merge_partials(partials: DataFrame) -> DataFrame:
    """Add up partial sessions; also joins newly rolled-up pings to stored sessions."""
    length = F.when(F.col("dashboard_url") == LOGIN_PORTAL, F.lit(1).cast("long")).otherwise(
        F.sum("duration_minutes")
    )
    ids = [F.min("id").alias("id")] if "id" in partials.columns else []
    numbers = [F.sum("pings").alias("pings")] if "pings" in partials.columns else []
    return partials.groupBy(*KEY).agg(
        *ids,
        *numbers,
        F.min("start_time").alias("start_time"),
        F.max("last_ping").alias("last_ping"),
        length.alias("duration_minutes"),
    )
