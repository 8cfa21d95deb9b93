"""Raw ping lines taken in whole: what is accepted adds up, what is refused is kept with its reason.

Each micro-batch has two outputs under one identity, partial sessions and dead letters, entered
together: a line is in exactly one of them, and a repeated batch is in neither twice. Dead
letters hold the line as it came, so they can be mended and taken in again; the same entry
that adds the outcome retires the letters it was made from.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from boardpulse.functions.calendar import LOCAL_ZONE, DayRange
from boardpulse.functions.text import is_blank
from boardpulse.sources import schemas
from boardpulse.streaming.parts import QUERY_ID, PartKind, compact_parts, live_parts, read_parts, rows_of, take_in_all
from boardpulse.streaming.rollup import merge_partials, part_schema, roll_up

# Why a line is refused; the first that applies.
MALFORMED, NO_USER, NO_PAGE, NO_TIME = "malformed", "no user", "no page", "no time"
BROKEN = "_broken"


ACCEPTED = PartKind(part_schema().add("pings", T.LongType()), merge_partials, "session_date", output="accepted")
REFUSED = PartKind(
    T.StructType().add("line", T.StringType()).add("reason", T.StringType()).add("ts", T.TimestampType()),
    lambda letters: letters,
    day_of="ts",
    output="refused",
)


def judge(lines: DataFrame, column: str = "value") -> DataFrame:
    """Each raw line with its ping fields and the ``reason`` it is refused for, null if it is not.

    A line that is no JSON object, or has a field of another type, is malformed; a null line is too.
    """
    schema = T.StructType([*schemas.PINGS.fields, T.StructField(BROKEN, T.StringType())])
    parsed = lines.select(
        F.col(column).alias("line"),
        F.from_json(F.col(column), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}).alias("ping"),
    ).select("line", "ping.*")
    blank_line = F.col("line").isNull() | ~F.trim("line").startswith("{")
    reason = (
        F.when(blank_line | F.col(BROKEN).isNotNull(), MALFORMED)
        .when(F.col("user_id").isNull(), NO_USER)
        .when(is_blank(F.col("dashboard_url")), NO_PAGE)
        .when(F.col("ts").isNull(), NO_TIME)
    )
    return parsed.withColumn("reason", reason).drop(BROKEN)


def _outputs(lines: DataFrame, zone: str) -> list[tuple[PartKind, DataFrame]]:
    judged = judge(lines)
    pings = judged.where(F.col("reason").isNull()).select(*schemas.PINGS.names)
    accepted = roll_up(pings, zone, counted=True).select(*ACCEPTED.schema.names)
    return [(ACCEPTED, accepted), (REFUSED, judged.where(F.col("reason").isNotNull()).select("line", "reason", "ts"))]


def write_intake(lines: DataFrame, path: str, zone: str = LOCAL_ZONE) -> DataStreamWriter:
    """Writer that stores each micro-batch of raw lines (``value``) as accepted cells and dead letters."""

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = spark.sparkContext.getLocalProperty(QUERY_ID)
        if not run:
            raise RuntimeError("the stream does not tell its identity")
        take_in_all(spark, path, _outputs(batch, zone), run, batch_id)

    return lines.writeStream.foreachBatch(store)


def read_accepted(spark: SparkSession, path: str, ranges: Sequence[DayRange] = ()) -> DataFrame:
    """Sessions of all accepted lines, with the number of ``pings`` behind each."""
    return read_parts(spark, path, ACCEPTED, ranges)


def read_refused(spark: SparkSession, path: str, ranges: Sequence[DayRange] = ()) -> DataFrame:
    """Dead letters: line, reason, and the time if it could be read; ranges are UTC days of that time."""
    return read_parts(spark, path, REFUSED, ranges)


def replay_refused(
    spark: SparkSession, path: str, mend: Callable[[DataFrame], DataFrame], name: str, zone: str = LOCAL_ZONE
) -> bool:
    """Take the dead letters in again after ``mend`` changed their ``line``; whether anything was entered.

    What is still refused is kept under its new reason. ``name`` is the identity of the
    replay: repeating it changes nothing. Letters that arrive meanwhile wait for the next one.
    """
    old = live_parts(spark, path, kind=REFUSED)
    if not old:
        return False
    mended = mend(rows_of(spark, path, REFUSED, old)).select(F.col("line").alias("value"))
    return take_in_all(spark, path, _outputs(mended, zone), f"replay:{name}", 0, old)


def compact_intake(spark: SparkSession, path: str, closed: date | None = None) -> list[str | None]:
    """Merge parts of both outputs where that is due."""
    return compact_parts(spark, path, ACCEPTED, closed=closed) + compact_parts(spark, path, REFUSED, closed=closed)
