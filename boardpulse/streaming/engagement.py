"""Attention from raw activity: credited ticks and sessions cut at idle gaps."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.window import Window

from boardpulse.functions.calendar import LOCAL_ZONE, DayRange, local_day, within_days
from boardpulse.sources.feeds import event_time
from boardpulse.streaming.parts import PartKind, compact_parts, read_parts, write_parts
from boardpulse.streaming.rollup import merge_partials

# Seconds between two heartbeats, and seconds without activity that end credit.
TICK_SECONDS = 30
IDLE_SECONDS = 300
# A user's history is split into spans of this length before it is sorted; for sessions these
# are joined in spans 64 days, 4,096 days (11 years) and 718 years wide.
SPAN_SECONDS = 86_400
SPAN_FACTOR, SPAN_LEVELS = 64, 3
# A span this wide, with 1970 in its middle, holds every instant that 64-bit microseconds can tell.
ALL_SECONDS = 2**45


def _check(idle_seconds: int, tick_seconds: int) -> None:
    if tick_seconds <= 0 or idle_seconds % tick_seconds:
        raise ValueError("the idle limit must be a whole number of ticks")


def engaged_ticks(
    activity: DataFrame, idle_seconds: int = IDLE_SECONDS, tick_seconds: int = TICK_SECONDS
) -> DataFrame:
    """Heartbeats each user earns: one per grid tick while the last activity is recent.

    ``activity`` holds user_id, dashboard_url and ts. A row without a dashboard takes
    the user away from the open one and earns nothing. The tick at g belongs to the
    latest activity in [g - idle, g).

    Activity is first reduced to its last instant per user, page and grid cell, before
    the shuffle. What the window then sorts per user is bounded by the clock (2,880 cells
    a day) and the pages open in one cell, not by how much a user clicks.
    """
    tick = _interval(tick_seconds)
    ticks = F.sequence(F.col("cell") + tick, F.col("until"), tick)
    runs = _credited_runs(activity, idle_seconds, tick_seconds)
    return runs.select("user_id", "dashboard_url", F.explode(ticks).alias("ts"))


def engaged_sessions(
    activity: DataFrame,
    zone: str = LOCAL_ZONE,
    idle_seconds: int = IDLE_SECONDS,
    tick_seconds: int = TICK_SECONDS,
) -> DataFrame:
    """Sessions those ticks add up to, without listing every tick.

    A run of ticks within one local day is counted by its length; only the few runs that
    pass midnight are taken apart.
    """
    tick = _interval(tick_seconds)
    runs = _credited_runs(activity, idle_seconds, tick_seconds).withColumn("first", F.col("cell") + tick)
    whole = local_day(runs, "first", zone) == local_day(runs, "until", zone)
    starts = F.when(whole, F.array("first")).otherwise(F.sequence(F.col("first"), F.col("until"), tick))
    pieces = runs.select("*", whole.alias("whole"), F.explode(starts).alias("start_time"))
    length = (F.col("until") - F.col("cell")).cast("long") / tick_seconds
    return merge_partials(
        pieces.select(
            "user_id",
            "dashboard_url",
            local_day(pieces, "start_time", zone).alias("session_date"),
            "start_time",
            F.when(F.col("whole"), F.col("until")).otherwise(F.col("start_time")).alias("last_ping"),
            F.when(F.col("whole"), length.cast("long")).otherwise(1).alias("duration_minutes"),
        )
    )


def activity_cells(activity: DataFrame, tick_seconds: int = TICK_SECONDS) -> DataFrame:
    """Last instant of each user on each page in each grid cell."""
    return (
        activity.where(F.col("user_id").isNotNull())
        .select("*", F.window("ts", f"{tick_seconds} seconds")["start"].alias("cell"))
        .groupBy("user_id", "dashboard_url", "cell")
        .agg(F.max("ts").alias("last"))
    )


def _credited_runs(activity: DataFrame, idle_seconds: int, tick_seconds: int) -> DataFrame:
    return _runs_of_cells(activity_cells(activity, tick_seconds), idle_seconds, tick_seconds)


def _runs_of_cells(cells: DataFrame, idle_seconds: int, tick_seconds: int) -> DataFrame:
    """Grid cells with the page last used in them and how far its credit reaches.

    Credit ends after ``idle_seconds``, so only the next cells matter: a user's history is
    split into days, and the first cells of a day stand, as ghosts, also at the end of the
    day before. What one window sorts is one user's day, however long the history.
    """
    _check(idle_seconds, tick_seconds)
    if isinstance(cells.schema["cell"].dataType, T.TimestampNTZType):
        seconds = (F.col("cell") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).cast("long")
    else:
        seconds = F.unix_seconds("cell")
    day = F.floor(seconds / SPAN_SECONDS)
    border = seconds % SPAN_SECONDS <= idle_seconds + tick_seconds
    placed = cells.withColumn("span", F.explode(F.when(border, F.array(day, day - 1)).otherwise(F.array(day))))
    placed = placed.withColumn("ghost", F.col("span") != day)
    by_time = Window.partitionBy("user_id", "span").orderBy("last", F.asc_nulls_first("dashboard_url"))
    limit = F.col("cell") + _interval(idle_seconds)
    return (
        placed.withColumn("until", F.least(F.lead("cell").over(by_time), limit))
        .where(~F.col("ghost") & F.col("dashboard_url").isNotNull() & (F.col("until") > F.col("cell")))
        .drop("span", "ghost")
    )


def _last_of_cells(cells: DataFrame) -> DataFrame:
    return cells.groupBy("user_id", "dashboard_url", "cell").agg(F.max("last").alias("last"))


def _gaps_of_cells(cells: DataFrame) -> DataFrame:
    return cells.groupBy("user_id", "cell").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))


_USER, _INSTANT = [T.StructField("user_id", T.LongType())], T.TimestampType()
# What a stream of activity leaves behind for ticks, and for sessions cut at gaps; by UTC day.
TICK_CELLS = PartKind(
    T.StructType([*_USER, T.StructField("dashboard_url", T.StringType()), T.StructField("cell", _INSTANT), T.StructField("last", _INSTANT)]),
    _last_of_cells,
    day_of="cell",
)
GAP_CELLS = PartKind(
    T.StructType([*_USER, *[T.StructField(name, _INSTANT) for name in ("cell", "first", "last")], T.StructField("n", T.LongType())]),
    _gaps_of_cells,
    day_of="cell",
)


def write_ticks(activity: DataFrame, path: str, tick_seconds: int = TICK_SECONDS) -> DataStreamWriter:
    """Writer that stores each micro-batch of activity as grid cells."""
    return write_parts(activity, path, TICK_CELLS, lambda batch: activity_cells(batch, tick_seconds))


def read_ticks(
    spark: SparkSession,
    path: str,
    idle_seconds: int = IDLE_SECONDS,
    tick_seconds: int = TICK_SECONDS,
    ranges: Sequence[DayRange] = (),
) -> DataFrame:
    """The ticks all stored activity earns, by the batch rule; of all UTC days or of some.

    A tick is earned by activity at most ``idle_seconds`` before it, so a range opens the
    parts of its own days and of so many days before.
    """
    reach = timedelta(days=-(-(idle_seconds + tick_seconds) // SPAN_SECONDS))
    needed = [(lo and lo - reach, hi) for lo, hi in ranges]
    cells = read_parts(spark, path, TICK_CELLS, needed)
    tick = _interval(tick_seconds)
    runs = _runs_of_cells(cells, idle_seconds, tick_seconds)
    ticks = runs.select("user_id", "dashboard_url", F.explode(F.sequence(F.col("cell") + tick, F.col("until"), tick)).alias("ts"))
    return ticks.where(within_days(local_day(ticks, "ts", "UTC"), ranges)) if ranges else ticks


def compact_ticks(spark: SparkSession, path: str, closed: date | None = None) -> list[str | None]:
    return compact_parts(spark, path, TICK_CELLS, closed=closed)


def compact_idle_sessions(spark: SparkSession, path: str, closed: date | None = None) -> list[str | None]:
    return compact_parts(spark, path, GAP_CELLS, closed=closed)


def _interval(seconds: int) -> Column:
    return F.expr(f"INTERVAL {seconds} SECONDS")


def engaged_ticks_stream(
    activity: DataFrame,
    idle_seconds: int = IDLE_SECONDS,
    tick_seconds: int = TICK_SECONDS,
    *,
    lateness: str,
) -> DataFrame:
    """The same ticks emitted by a stream: a sliding window of the idle limit ends at each tick.

    Activity later than ``lateness`` is lost and open windows are not emitted;
    :func:`write_ticks` has neither limit.
    """
    _check(idle_seconds, tick_seconds)
    timed = event_time(activity).withWatermark("ts", lateness)
    span = F.window("ts", f"{idle_seconds} seconds", f"{tick_seconds} seconds")
    latest = F.max(F.struct("ts", "dashboard_url"))["dashboard_url"]
    return (
        timed.where(F.col("user_id").isNotNull())
        .groupBy("user_id", span)
        .agg(latest.alias("dashboard_url"))
        .where(F.col("dashboard_url").isNotNull())
        .select("user_id", "dashboard_url", F.col("window.end").alias("ts"))
    )


def idle_sessions(activity: DataFrame, gap_seconds: int = IDLE_SECONDS) -> DataFrame:
    """Activity per user cut wherever more than ``gap_seconds`` pass without any.

    Two activities in one grid cell as wide as the gap can never be cut apart, so cells
    are reduced to extremes and counts before the shuffle; cuts are then looked for
    between cells only.
    """
    return _stays(gap_cells(activity, gap_seconds), gap_seconds)


def gap_cells(activity: DataFrame, gap_seconds: int = IDLE_SECONDS) -> DataFrame:
    """First and last instant and number of activities of each user in each cell as wide as the gap."""
    return (
        activity.select("*", F.window("ts", f"{gap_seconds} seconds")["start"].alias("cell"))
        .groupBy("user_id", "cell")
        .agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
    )


def write_idle_sessions(activity: DataFrame, path: str, gap_seconds: int = IDLE_SECONDS) -> DataStreamWriter:
    """Writer that stores each micro-batch of activity as cells as wide as the gap."""
    return write_parts(activity, path, GAP_CELLS, lambda batch: gap_cells(batch, gap_seconds))


def read_idle_sessions(spark: SparkSession, path: str, gap_seconds: int = IDLE_SECONDS) -> DataFrame:
    """The sessions of all stored activity, by the batch rule."""
    return _stays(read_parts(spark, path, GAP_CELLS), gap_seconds)


def _stays(cells: DataFrame, gap_seconds: int) -> DataFrame:
    """Cells joined to sessions by a segmented scan: no window holds a whole user.

    A user's time is cut into spans. Within a span cells are joined where they are close
    enough; a session that touches neither end of its span's sessions is settled, for its
    neighbours are farther away than the gap. The first and the last one go on into spans
    ``SPAN_FACTOR`` times as wide, where there are at most two per narrower span, and so on
    until a span holds all time. A window thus sees one user's cells of one day, or
    2 * ``SPAN_FACTOR`` summaries, however long the user's history is.
    """
    zoneless = isinstance(cells.schema["first"].dataType, T.TimestampNTZType)
    since = F.col("first") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = since.cast("long") if zoneless else F.unix_seconds("first")
    widest = SPAN_SECONDS * SPAN_FACTOR**SPAN_LEVELS
    level = cells.select("user_id", "first", "last", "n")
    settled = []
    width = SPAN_SECONDS
    while width < widest:
        joined = _joined(level.withColumn("span", F.floor(seconds / width)), gap_seconds)
        inner = (F.col("session") > 1) & (F.col("session") < F.col("sessions"))
        settled.append(joined.where(inner).select("user_id", "first", "last", "n"))
        level = joined.where(~inner).select("user_id", "first", "last", "n")
        width *= SPAN_FACTOR
    every = _joined(level.withColumn("span", F.floor(seconds / ALL_SECONDS + 0.5)), gap_seconds).select("user_id", "first", "last", "n")
    for frame in settled:
        every = every.unionByName(frame)
    return every.select(
        "user_id", F.col("first").alias("session_start"), F.col("last").alias("last_activity"), F.col("n").alias("activities")
    )


def _joined(pieces: DataFrame, gap_seconds: int) -> DataFrame:
    """Pieces of a user and span joined where no gap parts them, numbered ``session`` of ``sessions``."""
    group = Window.partitionBy("user_id", "span")
    by_time = group.orderBy("first")
    so_far = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    since = F.col("first") - F.lag("last").over(by_time)
    opens = F.when(since <= _interval(gap_seconds), 0).otherwise(1)
    numbered = pieces.withColumn("opens", opens).withColumn("session", F.sum("opens").over(so_far))
    return (
        numbered.withColumn("sessions", F.sum("opens").over(group))
        .groupBy("user_id", "span", "session", "sessions")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    )


def idle_sessions_stream(
    activity: DataFrame, gap_seconds: int = IDLE_SECONDS, *, lateness: str
) -> DataFrame:
    """The same sessions emitted by a stream, each once its gap and ``lateness`` have passed.

    What is later or still open is not emitted; :func:`write_idle_sessions` has neither limit.
    """
    timed = event_time(activity).withWatermark("ts", lateness)
    return (
        timed.groupBy("user_id", F.session_window("ts", f"{gap_seconds} seconds"))
        .agg(F.max("ts").alias("last_activity"), F.count("*").alias("activities"))
        .select(
            "user_id",
            F.col("session_window.start").alias("session_start"),
            "last_activity",
            "activities",
        )
    )
